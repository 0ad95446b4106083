"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

Leaf i of the tree holds the rank of the pair that starts at symbol i (none: infinity).  The root's minimum of (rank, position)
is the leftmost lowest-rank merge; a merge changes at most three leaves, each update costs a logarithm of the
length, and the encoding ends when the root is infinite.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import bounded_batches
from chronofold.llm.tokenizing import WORD_BPE, CachedTokenizer, byte_alphabet, held

NONE = 1 << 62


class PairTree:
    """Minimum of (rank, position) over the pairs of a symbol list, with point updates."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        tree = [NONE] * self.size + [r if r == NONE else (r << 32) | i for i, r in enumerate(ranks)]
        tree += [NONE] * (2 * self.size - len(tree))
        for k in range(self.size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        self.tree = tree

    def least(self) -> int:
        return self.tree[1]

    def set(self, i: int, rank: int) -> None:
        tree, k = self.tree, i + self.size
        tree[k] = rank if rank == NONE else (rank << 32) | i
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1


class SegmentTreeBPE:
    """Encodes pre-tokens in the byte alphabet with a vocabulary file's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        v = self.vocab
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}

    def encode_word(self, word: str) -> list[int]:
        if not word:
            return []
        symbols = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]
        n, merges = len(symbols), self.merges
        if n == 1:
            return symbols
        none = (NONE, 0)
        tree = PairTree([merges.get(pair, none)[0] for pair in zip(symbols, symbols[1:], strict=False)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree.least()) < NONE:
            i = least & 0xFFFFFFFF
            j = after[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, NONE)
            if k < n:
                before[k] = i
                tree.set(i, merges.get((symbols[i], symbols[k]), none)[0])
            else:
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                tree.set(h, merges.get((symbols[h], symbols[i]), none)[0])
        return [s for s in symbols if s >= 0]


class Codec:
    """Encoder (segment tree behind a worker cache) and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.encoder = CachedTokenizer(path, SegmentTreeBPE(path).encode_word)
        library = self.encoder.library
        self.tokens = [library.id_to_token(i) for i in range(library.get_vocab_size())]
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.joined = library.decoder is None
        self.bytes_of = {c: b for b, c in byte_alphabet().items()}

    def encode(self, text: str) -> list[int]:
        return self.encoder.ids(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): tokens joined by a space, or through the byte decoder where the file has one."""
        if self.joined:
            return " ".join(map(self.tokens.__getitem__, ids))
        out = bytearray()
        for token in map(self.tokens.__getitem__, ids):
            if all(c in self.bytes_of for c in token):
                out += bytes(map(self.bytes_of.__getitem__, token))
            else:
                out += token.encode()
        return out.decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def bpe_encode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int).  Null or empty text has no ids; repeated rows come as they are."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path).encoder
        for batch in batches:
            packed = [encoder.packed(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // encoder.dtype.itemsize for p in packed], dtype=np.int64)
            flat = np.frombuffer(b"".join(packed), encoder.dtype).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text.  Null or empty ids give the empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256.

    The same encoder and decoder as above; only digests leave the worker.  Null or empty text: 0 tokens and digests of nothing.
    Repeated rows and null doc_ids come as they are; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
