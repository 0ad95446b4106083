"""Whole-text encoding as the public tokenizer libraries do it, through worker-wide caches of pre-tokens.

A text is cut into pre-tokens exactly as the library cuts it, and each distinct pre-token is encoded once per worker.
Texts whose characters are all below U+0180 are cut with ``re`` (there Unicode normalisation form C changes nothing,
and the classes are listed below); any other text is normalised and cut by the library itself.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE, WORD_BPE, PIECE_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
#: A worker's cache holds so many pre-tokens; later ones are encoded each time.  Long ones are never held.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48

# The letters, other numbers and white space below U+0180.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \u0085 "
BEYOND = re.compile("[^\u0000-ſ]")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
BYTES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PreTokens(dict):
    """pre-token -> encoded form; ``encode`` fills it until it is full."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        self.encode, self.entries = encode, entries

    def __missing__(self, word: str):
        out = self.encode(word)
        if len(self) < self.entries and len(word) <= CACHE_CHARS:
            self[word] = out
        return out


class CachedTokenizer:
    """ids of whole texts as ``tokenizers`` gives them with add_special_tokens=False.

    Special strings inside a text become their ids, as the library does by default.  ``encode_word`` maps a pre-token
    in the byte alphabet to its ids; by default the library's own model.
    """

    def __init__(self, path: str, encode_word=None, entries: int = CACHE_ENTRIES):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = self.library.normalizer is not None
        self.pattern = WORDS if self.lower else BYTES
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {k: np.array([i], self.dtype).tobytes() for k, i in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = tuple(special)
        if encode_word is None:
            model = self.library.model
            encode_word = lambda word: [t.id for t in model.tokenize(word)]
        alphabet = byte_alphabet()
        self.mapped = PreTokens(lambda word: np.array(encode_word(word), self.dtype).tobytes(), entries)
        direct = lambda word: np.array(encode_word("".join(map(alphabet.__getitem__, word.encode()))), self.dtype).tobytes()
        self.words = PreTokens(direct, entries)

    def _segment(self, text: str) -> bytes:
        if BEYOND.search(text) is None:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return b"".join([self.mapped[word] for word, _ in pieces])

    def packed(self, text: str) -> bytes:
        """The ids of ``text``, little-endian, in ``dtype``."""
        if any(m in text for m in self.marks):
            parts = self.specials.split(text)
            return b"".join(self.special[p] if p in self.special else self._segment(p) for p in parts if p)
        return self._segment(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


_HELD: dict[tuple, tuple[object, object]] = {}


def held(key: tuple, make, version: object = None):
    """One object per worker process and key: caches stay warm from task to task.  Another ``version`` replaces it."""
    if key not in _HELD or _HELD[key][0] != version:
        _HELD[key] = (version, make())
    return _HELD[key][1]


def cached_tokenizer(path: str) -> CachedTokenizer:
    return held(("tokenizer", path), lambda: CachedTokenizer(path))
