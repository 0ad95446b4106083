"""Token counts by a two-tier map-side lookup.

Tier one is a table of frequent pre-tokens and their lengths: every partition of the corpus counts its pre-tokens in
a bounded summary, the summaries are merged, and the ``table_words`` largest (at most ``CACHE_CHARS`` characters
each, so of bounded size) are encoded once and broadcast.  Tier two is the cache of each worker for everything else.  Pre-tokens
themselves are never shuffled; the summaries are a few thousand rows a partition.

The library's model joins no piece across the start of a run of spaces, so a text's count is the sum over its
units: a run of spaces with the other characters that follow it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import bounded_batches
from chronofold.llm.tokenizing import CACHE_CHARS, PIECE_BPE, PreTokens, held

TABLE_WORDS, SUMMARY_WORDS, SUMMARY_LIMIT, LIMIT = 20_000, 2_000, 200_000, 4096
UNITS = re.compile(" +[^ ]*")
SPACE_MARK = "▁"


def units(text: str) -> list[str]:
    """The text's units, each without its first space (the model adds it again)."""
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return [u[1:] for u in UNITS.findall(" " + text)]


def unit_length(model: sentencepiece.SentencePieceProcessor, unit: str) -> int:
    return len(model.encode(unit)) if unit else 1  # a space at the end of a text: one piece


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text.split(" "))
        if len(counts) > SUMMARY_LIMIT:  # Misra-Gries: the median count is taken from all
            least = int(np.median(np.fromiter(counts.values(), np.int64)))
            counts = Counter({k: v - least for k, v in counts.items() if v > least})
    top = [(k, v) for k, v in counts.most_common(SUMMARY_WORDS) if k and len(k) <= CACHE_CHARS]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], names=["word", "n"])


def frequent_lengths(docs: DataFrame, path: str, text_col: str, table_words: int) -> tuple[str, bytes]:
    """The compact table: the frequent pre-tokens, joined by spaces, and their lengths as bytes pairs."""
    merged = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_summaries, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in merged.orderBy(F.desc("n"), "word").limit(table_words).collect()]  # at most table_words
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    lengths = np.array([unit_length(model, w) for w in words], "<u2")
    return " ".join(words), lengths.tobytes()


def token_counts(docs: DataFrame, path: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    Counts are those of the library for the whole text, without begin, end or added tokens.  Null or empty text has 0 bytes and 0
    tokens.  Repeated rows and null doc_ids are returned as they come.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, table_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            out = PreTokens(lambda unit: unit_length(model, unit))
            words, lengths = table.value
            if words:
                out.update(zip(words.split(" "), np.frombuffer(lengths, "<u2").tolist(), strict=True))
            return out

        lengths = held(("pieces", path), make, hash(table.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([sum(map(lengths.__getitem__, units(t))) for t in texts], np.int64)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
