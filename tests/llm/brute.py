"""Plain re-computations of the operators' results, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import regex
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from chronofold.llm.tokenizing import BYTE_BPE, PIECE_BPE, WORD_BPE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[sha((t or "").translate(LOWER))].append(i)
    return {i: (max(g), len(g), i == max(g), h) for h, g in groups.items() for i in g}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(docs, limit=3):
    fps = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= limit):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs)}


def token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    out = {}
    for i, t in docs:
        n = len(model.encode(t or ""))
        out[i] = (len((t or "").encode()), n, n > 4096)
    return out


def byte_ids(docs):
    lib = Tokenizer.from_file(BYTE_BPE)
    return {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}


def word_round_trip(docs):
    lib = Tokenizer.from_file(WORD_BPE)
    out = {}
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    return out


def token_store(docs):
    lib = Tokenizer.from_file(WORD_BPE)
    out, start = {}, 0
    for i, t in sorted(docs):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def line_dedup(docs, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)

    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def edited(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        out[i] = (len(t), sha(t[: len(t) - k] + n[:k]))
    return out


def murmur3(text):
    """The engine's 32-bit hash of a string: Murmur3 x86 with seed 42, the last bytes mixed one by one as signed numbers."""
    data, h, mask = text.encode(), 42, 0xFFFFFFFF
    whole = len(data) // 4 * 4
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [b - 256 if b > 127 else b for b in data[whole:]]
    for k in blocks:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) * 0x1B873593 & mask
        h ^= k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def spot_set(text, anchors, chain=3):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    content = [i for i, w in enumerate(words) if w not in anchors]
    if not content:
        return {murmur3(text)} if text else set()
    starts = [k for k, i in enumerate(content) if i == 0 or words[i - 1] in anchors or (i >= chain and not any(w in anchors for w in words[i - chain : i]))]
    return {murmur3(" ".join(words[i] for i in content[k : k + chain])) for k in starts}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def spots(docs, anchors):
    """doc_id -> (fingerprint, edited_fingerprint, near_edited, near_next, copy_edited, copy_next)."""
    order = sorted(docs, reverse=True)
    as_hex = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in sorted(s))
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        own, edited, following = (spot_set(x, anchors) for x in (t, t[: len(t) - k] + n[:k], n))
        e, f = likeness(own, edited), likeness(own, following)
        out[i] = (as_hex(own), as_hex(edited), e, f, e >= 0.8, f >= 0.8)
    return out
