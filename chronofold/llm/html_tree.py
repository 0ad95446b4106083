"""HTML to a tree of block elements and text blocks, in one regular-expression pass."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names by role.
BLOCK = frozenset(
    "html body main article section div nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre form fieldset legend figure figcaption address details summary hgroup center dialog menu search".split()
)
#: Raw text, to the end tag or else the end of the page; of the others a balanced subtree is skipped, or else only the tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SUBTREES = frozenset("noscript template select button svg math canvas object datalist".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
STOPS = frozenset("table ul ol dl".split())
RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}


class Node:
    """An element (``text`` is None) or a text block below one."""

    __slots__ = ("depth", "label", "links", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, depth: int, names=(), text: str | None = None, links: float = 0.0, label: int | None = None):
        self.tag, self.parent, self.depth, self.names, self.text, self.links, self.label = tag, parent, depth, names, text, links, label


def _subtree_ends(source: str) -> dict[int, int]:
    """Where each balanced element of SUBTREES ends, by the place of its start tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at = 0
    while match := TOKEN.search(source, at):
        at, name = match.end(), (match[2] or "").lower()
        if match[1] == "/":
            if opened.get(name):
                ends[opened[name].pop()] = at
        elif not (match[3] or "").endswith("/"):
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            elif name in SUBTREES:
                opened.setdefault(name, []).append(match.start())
    return ends


def parse(source: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the root."""
    nodes = [Node("root", -1, 0)]
    stack = [0]
    parts: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(source)
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = nodes[stack[-1]]
                nodes.append(Node("#text", stack[-1], top.depth + 1, (), text, min(1.0, linked / len(text)), None))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def close(tag: str, within: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = nodes[stack[k]].tag
            if name == tag:
                del stack[k:]
                return
            if name in within:
                return

    while at < size:
        match = TOKEN.search(source, at)
        if match is None:
            add(source[at:])
            break
        if match.start() > at:
            add(source[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        closing = match[1] == "/"
        if name in RAW:
            if not closing and not match[3].endswith("/"):
                end = RAW_END[name].search(source, at)
                at = end.end() if end else size
                parts.append(" ")
        elif name in SUBTREES:
            if not closing and not match[3].endswith("/"):
                if ends is None:
                    ends = _subtree_ends(source)
                at = ends.get(match.start(), at)
                parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in ("br", "wbr", "hr"):
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
        elif name == "head":
            flush()
        elif name == "body" or name == "html":
            flush()
            if not closing and len(stack) == 1:
                nodes.append(Node(name, 0, 1))
                stack.append(len(nodes) - 1)
        elif name in BLOCK:
            flush()
            in_link = 0
            if closing:
                close(name)
                continue
            if nodes[stack[-1]].tag == "p" or any(nodes[k].tag == "p" for k in stack[-2:]):
                close("p")
            for other in CLOSES.get(name, ()):
                close(other, STOPS - {name})
            names, label = (), None
            if "=" in match[3]:
                found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(match[3])}
                names = tuple(dict.fromkeys(w.lower() for k in ("class", "id", "role") for w in NAME.findall(found.get(k, ""))))
                label = {"1": 1, "0": 0}.get(found.get("data-y", ""))
            nodes.append(Node(name, stack[-1], nodes[stack[-1]].depth + 1, names, label=label))
            stack.append(len(nodes) - 1)
    flush()
    return nodes
