"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element and text block of a page is a binary variable: content or not.  Node potentials come from tag, class
and id words, length, punctuation and links; parent-child potentials depend on the child's kind.  Sum-product message passing,
upward and then downward, gives exact content marginals, for all pages of a batch at once, level by level.  Text blocks whose
marginal is at least a half are the main text.

The weights are the maximum-likelihood fit to labelled pages, by gradient steps on exact marginals.  ``labelled_pages`` makes
such pages: random layouts of articles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import random
import re
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronofold.llm.common import append_columns, bounded_batches
from chronofold.llm.html_tree import Node, parse

PAGES, STEPS, RATE, RIDGE, SEED = 900, 120, 0.3, 0.02, 7
ENDS = re.compile(r"[.!?…。]")


def features(node: Node, parent: Node | None) -> list[str]:
    if node.text is None:
        return ["tag " + node.tag, f"tag {node.tag} in {parent.tag if parent else ''}", *("name " + n for n in node.names)]
    n = len(node.text)
    return [
        "length " + str(min(8, n.bit_length())),
        "links " + str(round(node.links * 4)),
        "ends " + str(sum(1 for _ in islice(ENDS.finditer(node.text), 2))),
        "under " + parent.tag,
        *(["sign"] if node.text[0] in "©" else []),
    ]


def kind(node: Node) -> str:
    return node.tag


class Forest:
    """Pages' trees as arrays: parents, levels, features and edge kinds."""

    def __init__(self, trees: list[list[Node]], names: dict[str, int], kinds: dict[str, int], grow: bool = False):
        parent, depth, rows, cols, kind_of = [], [], [], [], []
        for tree in trees:
            base = len(parent)
            for k, node in enumerate(tree):
                parent.append(base + node.parent if node.parent >= 0 else -1)
                depth.append(node.depth)
                found = features(node, tree[node.parent] if node.parent >= 0 else None)
                for f in found:
                    i = names.setdefault(f, len(names)) if grow else names.get(f)
                    if i is not None:
                        rows.append(base + k)
                        cols.append(i)
                kind_of.append(kinds.setdefault(kind(node), len(kinds)) if grow else kinds.get(kind(node), 0))
        self.parent, self.kind = np.array(parent, np.int64), np.array(kind_of, np.int64)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1))) if len(depth) else []

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginals of the nodes, and edge marginals (node, parent's label, own label).

        ``unary``: score of being content.  ``edge``: (kind, 2, 2) scores.
        """
        n = len(self.parent)
        phi = np.stack([np.zeros(n), unary], axis=1)
        psi = edge[self.kind]
        up, sent, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            own = (phi[level] + up[level])[:, None, :] + psi[level]
            sent[level] = np.logaddexp(own[:, :, 0], own[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        for level in self.levels[1:]:
            p = self.parent[level]
            outer = (phi[p] + up[p] + down[p] - sent[level])[:, :, None] + psi[level]
            down[level] = np.logaddexp(outer[:, 0], outer[:, 1])
        belief = phi + up + down
        top = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        p = np.maximum(self.parent, 0)
        joint = (belief[p] - sent)[:, :, None] + psi + (phi + up)[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return top, joint / joint.sum(axis=(1, 2), keepdims=True)


class ContentModel:
    def __init__(self, names: dict[str, int], kinds: dict[str, int], weight: np.ndarray, edge: np.ndarray):
        self.names, self.kinds, self.weight, self.edge = names, kinds, weight, edge

    @classmethod
    def fit(cls, trees: list[list[Node]], steps: int = STEPS) -> ContentModel:
        """Labels: a node's own label, else its parent's; the root is not content."""
        names, kinds = {}, {"other": 0}
        forest = Forest(trees, names, kinds, grow=True)
        y = []
        for tree in trees:
            base = len(y)
            for node in tree:
                y.append(node.label if node.label is not None else (y[base + node.parent] if node.parent >= 0 else 0))
        y = np.array(y, np.int64)
        weight, edge = np.zeros(len(names)), np.zeros((len(kinds), 2, 2))
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros_like(edge)
        np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
        square_w, square_e = np.full(len(names), 1e-6), np.full_like(edge, 1e-6)
        for _ in range(steps):
            unary = np.bincount(forest.rows, weights=weight[forest.cols], minlength=len(y))
            node_p, edge_p = forest.marginals(unary, edge)
            grad_w = np.bincount(forest.cols, weights=(y - node_p)[forest.rows], minlength=len(names)) - RIDGE * weight
            expected = np.zeros_like(edge)
            np.add.at(expected, forest.kind[child], edge_p[child])
            grad_e = seen - expected - RIDGE * edge
            square_w += grad_w**2
            square_e += grad_e**2
            weight += RATE * grad_w / np.sqrt(square_w)
            edge += RATE * grad_e / np.sqrt(square_e)
        return cls(names, kinds, weight, edge)

    def texts(self, sources: list[str]) -> list[str]:
        trees = [parse(s) for s in sources]
        forest = Forest(trees, self.names, self.kinds)
        unary = np.bincount(forest.rows, weights=self.weight[forest.cols], minlength=len(forest.parent))
        p, _ = forest.marginals(unary, self.edge)
        out, base = [], 0
        for tree in trees:
            out.append("\n".join(node.text for k, node in enumerate(tree) if node.text is not None and p[base + k] >= 0.5))
            base += len(tree)
        return out


# --- labelled pages ---------------------------------------------------------------------------------------------
# Class words of page furniture and of articles.
FURNITURE = {
    "nav": ["nav menu", "navbar", "main-navigation", "breadcrumb breadcrumbs", "topnav", "menu-list"],
    "header": ["header", "site-header", "masthead banner", "topbar", "logo branding", "page-header"],
    "footer": ["footer", "site-footer", "copyright legal", "bottom", "footer-links", "credits"],
    "aside": ["sidebar", "sidebar-right widget", "related related-posts", "recommended", "popular trending", "widget tags", "toc", "read-more more"],
    "ad": ["ad", "ads advert", "advertisement", "sponsored sponsor", "promo promotion", "banner-ad", "adsense", "outbrain"],
    "notice": ["notice", "cookie cookie-banner", "consent gdpr", "alert warning", "popup modal", "paywall subscribe", "newsletter signup", "message info"],
    "form": ["form", "search search-form", "login", "contact-form", "subscribe-form", "signup"],
    "comments": ["comments", "comment-list", "disqus thread", "reader-comments", "responses replies", "discussion", "reviews feedback"],
    "share": ["share", "social social-share", "share-buttons", "follow", "pagination pager", "author-bio byline", "meta post-meta"],
}
ARTICLES = ["article", "content", "post", "entry", "story", "article-body", "entry-content", "post-content", "main-content", "body text", "page-content", "blog-post", "prose"]


def _words(rng: random.Random, low: int, high: int) -> str:
    syllables = "an er th in on re ti es or he st nd ed en ou le de la que ung sch ció ra é ü".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    text = " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in words)
    return text.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])


def _links(rng: random.Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/x">{_words(rng, 1, 4)}</a></{item}>' for _ in range(n))


def _furniture(rng: random.Random, role: str) -> str:
    cls = rng.choice(FURNITURE[role])
    attr = f' {rng.choice(["class", "class", "id"])}="{cls}"' if role in ("ad", "notice", "comments", "share") or rng.random() < 0.6 else ""
    if role == "nav":
        tag = "nav" if not attr or rng.random() < 0.6 else "div"
        return f'<{tag}{attr} data-y="0"><ul>{_links(rng, rng.randint(2, 9))}</ul></{tag}>'
    if role == "header":
        tag = "header" if not attr or rng.random() < 0.6 else "div"
        inner = rng.choice([f"<p>{_words(rng, 1, 8)}</p>", f"<h1>{_words(rng, 1, 4)}</h1><p>{_words(rng, 3, 9)}</p>", _words(rng, 1, 5), f"<ul>{_links(rng, 4)}</ul>"])
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'
    if role == "footer":
        tag = "footer" if not attr or rng.random() < 0.6 else "div"
        inner = rng.choice([f"&copy; {_words(rng, 1, 5)} &middot; {_words(rng, 2, 20)}", f"<p>&copy; 2020 {_words(rng, 2, 12)}</p>", f"<ul>{_links(rng, 5)}</ul>", f"<p>{_words(rng, 2, 30)}</p>", _words(rng, 2, 25)])
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'
    if role == "aside":
        tag = "aside" if not attr or rng.random() < 0.5 else rng.choice(["div", "section"])
        inner = rng.choice([f"<h3>{_words(rng, 1, 4)}</h3><ul>{_links(rng, rng.randint(2, 8))}</ul>", f"<p>{_words(rng, 5, 40)}</p>", f"<h2>{_words(rng, 1, 3)}</h2><p>{_words(rng, 5, 30)}</p>", _words(rng, 3, 30)])
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'
    if role == "form":
        return f'<form{attr} data-y="0"><p>{_words(rng, 1, 8)}</p><label>{_words(rng, 1, 3)}</label><input name="q"><button>{_words(rng, 1, 2)}</button></form>'
    if role == "comments":
        tag = rng.choice(["div", "section", "ol", "ul"])
        item = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
        item_class = rng.choice([' class="comment"', ' class="reply"', ""])
        inner = "".join(f"<{item}{item_class}>{_words(rng, 3, 60) if item == 'p' or rng.random() < 0.4 else f'<p>{_words(rng, 1, 3)}</p><p>{_words(rng, 4, 60)}</p>'}</{item}>" for _ in range(rng.randint(1, 5)))
        return f'<{tag}{attr} data-y="0">{"" if item == "li" else f"<h3>{_words(rng, 1, 3)}</h3>"}{inner}</{tag}>'
    tag = rng.choice(["div", "div", "section", "aside", "p"] if role != "share" else ["div", "ul", "p"])
    inner = rng.choice([_words(rng, 2, 35), f'<a href="/x">{_words(rng, 2, 10)}</a>']) if tag == "p" else rng.choice([_words(rng, 2, 45), f"<p>{_words(rng, 3, 45)}</p>", f'<p>{_words(rng, 3, 12)} <a href="/x">{_words(rng, 1, 3)}</a></p>'])
    if tag == "ul":
        inner = _links(rng, rng.randint(2, 5))
    return f'<{tag}{attr} data-y="0">{inner}</{tag}>'


def _article(rng: random.Random) -> str:
    if rng.random() < 0.08:  # running text without any sentence end
        return "".join(f"<p>{re.sub('[.,!?]', '', _words(rng, 3, 150))}</p>" for _ in range(rng.randint(1, 3)))
    if rng.random() < 0.08:  # many short paragraphs
        short = rng.randint(1, 3)
        return f"<h1>{_words(rng, 1, 12)}</h1>" + "".join(f"<p>{_words(rng, 1, short)}</p>" for _ in range(rng.randint(5, 30)))
    out = []
    if rng.random() < 0.85:
        heading = f"<h{rng.choice([1, 1, 2])}>{_words(rng, 1, 12)}</h1>"
        out.append(f"<header>{heading}</header>" if rng.random() < 0.2 else heading)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 10])):
        u = rng.random()
        if u < 0.62:
            out.append(f"<p>{_words(rng, 1, rng.choice([5, 30, 120]))}" + rng.choice(["</p>", "</p>", "</p>", "<br>", ""]))
        elif u < 0.68:
            out.append(f"<p><b>{_words(rng, 1, 60)}<br>")
        elif u < 0.74:
            out.append(f"<h{rng.randint(2, 4)}>{_words(rng, 1, 8)}</h2>")
        elif u < 0.80:
            out.append(f"<ul>{''.join(f'<li>{_words(rng, 1, 20)}</li>' for _ in range(rng.randint(1, 6)))}</ul>")
        elif u < 0.84:
            out.append(f"<blockquote><p>{_words(rng, 3, 40)}</p></blockquote>")
        elif u < 0.88:
            out.append(f"<table><tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr></table>")
        elif u < 0.92:
            out.append(f'<div>{_words(rng, 5, 60)}</div>')
        elif u < 0.95:
            out.append(f'<p>{_words(rng, 3, 20)} <a href="/y">{_words(rng, 1, 6)}</a> {_words(rng, 2, 20)}</p>')
        else:
            out.append(f"<pre>{_words(rng, 2, 30)}</pre><figure><figcaption>{_words(rng, 2, 10)}</figcaption></figure>")
        if rng.random() < 0.08:
            out.append(_furniture(rng, rng.choice(["ad", "share", "aside", "notice", "form"])))
    return "".join(out)


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages whose block elements carry their label in data-y; elements without one have their parent's."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        style = rng.random()
        attr = f' {rng.choice(["class", "id"])}="{rng.choice(ARTICLES)}"'
        if style < 0.45:
            main = f'<article{attr if rng.random() < 0.4 else ""} data-y="1">{_article(rng)}</article>'
        elif style < 0.6:
            main = f'<main{attr if rng.random() < 0.4 else ""} data-y="1">{_article(rng)}</main>'
        elif style < 0.9:
            main = f'<{(t := rng.choice(["div", "div", "section"]))}{attr} data-y="1">{_article(rng)}</{t}>'
        elif style < 0.94:
            main = f'<main><article{attr} data-y="1">{_article(rng)}</article></main>'
        else:  # no container that tells: a bare division, or the body itself
            main = f'<div data-y="1">{_article(rng)}</div>' if style < 0.97 else _article(rng)
        before = [_furniture(rng, r) for r in rng.sample(["nav", "header", "ad", "notice", "form", "aside", "share"], rng.randint(1, 4))]
        after = [_furniture(rng, r) for r in rng.sample(["footer", "ad", "notice", "form", "aside", "comments", "share", "nav"], rng.randint(1, 4))]
        if style >= 0.97 and rng.random() < 0.5:
            before, after = [], []
        body = "".join(before) + main + "".join(after)
        if style >= 0.97:
            out.append(f'<html><body data-y="1">{body}</body></html>' if rng.random() < 0.7 else body.replace("<p>", '<p data-y="1">'))
            continue
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = f'<div{rng.choice(["", " class=wrapper", " id=page", " class=container"])}>{body}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 5)}</title></head><body>{body}" + rng.choice(["</body></html>", ""]))
    return out


@cache
def trained() -> ContentModel:
    return ContentModel.fit([parse(p) for p in labelled_pages()])


def extract(pages: DataFrame, html_col: str = "html", model: ContentModel | None = None) -> DataFrame:
    """All columns of ``pages`` plus main_text: content blocks in page order, joined by one newline.

    Character references are decoded, white space inside a block becomes one space, ends are trimmed; nothing else is dropped or
    cut.  Null or empty html, and pages without content, give the empty text; repeated rows come as they are; an empty table
    gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def compute():
        return lambda sources: [sent.value.texts(sources)]

    return append_columns(pages, [T.StructField("main_text", T.StringType())], compute, html_col)
