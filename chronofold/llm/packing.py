"""Best-two-fit packing of token sequences.

A bin is filled greedily, always with the longest unpacked piece that fits.  Then its smallest piece is
replaced by two unpacked pieces if they fit the gap so expanded more tightly: once for each bin, because a chain of replacements
spends the small pieces that later bins need.  Only lengths matter, so a packer works on counts by length, and each bin costs a few vector operations over the capacity.

Pieces of a full sequence are bins of their own.  The others are dealt by hash to groups of about ``group_pieces`` rows, each
packed by one task that holds only its lengths: the last, partly filled bins of the groups are the only loss against one
packing of everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import bounded_batches, discard, materialise
from chronofold.llm.tokenizing import BYTE_BPE, cached_tokenizer

CAPACITY, END_ID, GROUP_PIECES = 2048, 0, 100_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of lengths.  ``counts[n]`` pieces of length n, 1 to ``capacity``, are packed; counts is used up."""
    bins, sizes = [], np.arange(capacity + 1)
    total = int(counts.sum())
    longest = np.maximum.accumulate(np.where(counts > 0, sizes, 0))  # the longest unpacked piece of at most n

    def take(n: int) -> None:
        nonlocal longest
        counts[n] -= 1
        if not counts[n]:
            longest = np.maximum.accumulate(np.where(counts > 0, sizes, 0))

    def put_back(n: int) -> None:
        nonlocal longest
        counts[n] += 1
        if counts[n] == 1:
            longest = np.maximum.accumulate(np.where(counts > 0, sizes, 0))

    while total:
        content, gap = [], capacity
        while n := int(longest[gap]):
            content.append(n)
            take(n)
            gap -= n
        if gap:
            small = min(content)
            room = gap + small
            first = np.flatnonzero(counts[: room + 1])
            first = first[first > 0]
            second = longest[np.minimum(room - first, first)]
            # a pair of one length needs two pieces of it
            alone = (second == first) & (counts[first] < 2)
            second = np.where(alone, longest[np.maximum(np.minimum(room - first, first - 1), 0)], second)
            both = np.where(second > 0, first + second, 0)
            best = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[best] > small:
                content.remove(small)
                put_back(small)
                for n in (int(first[best]), int(second[best])):
                    content.append(n)
                    take(n)
        total -= len(content)
        bins.append(content)
    return bins


def pieces(docs: DataFrame, path: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (array of int).

    A document's ids end with ``end_id``.  Only longer ones than ``capacity`` are cut, into full pieces after a first
    one that may be shorter.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cached_tokenizer(path)
        for batch in batches:
            rows, ids_out = [], []
            for doc_id, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                ids = np.append(tokenizer.ids(text or ""), tokenizer.dtype.type(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        ids_out.append(ids[a:b].astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def _assign(capacity: int):
    """Rows (row, piece, length) of one group, sorted: adds sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lengths = table["length"].to_numpy()
        by_length = np.argsort(lengths, kind="stable")
        next_of = np.searchsorted(lengths[by_length], np.arange(capacity + 1))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        group = (TaskContext.get().partitionId() + 1) << 36
        for number, content in enumerate(best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)):
            at = 0
            for n in content:
                row = by_length[next_of[n]]
                next_of[n] += 1
                sequence[row], offset[row] = group | number, at
                at += n
        out = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=65536)

    return run


def pack(pieces_of: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of ``pieces`` (all their columns) plus sequence_id and offset.

    A sequence's pieces lie from offset 0 without gaps and total at most ``capacity``.  Written once: an assignment
    never changes between reads.
    """
    held = materialise(pieces_of, "pieces")
    keys = ["row", "piece"]
    open_ = held.filter(F.col("length") < capacity).select("row", "piece", "length")
    groups = max(1, -(-open_.count() // group_pieces))
    placed = open_.repartition(groups, *keys).sortWithinPartitions(*keys).mapInArrow(_assign(capacity), "row long, piece int, length long, sequence_id long, offset long")
    placed = placed.select("row", "piece", "sequence_id", "offset")
    full = held.filter(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    # ids of full pieces are negative, those of packed ones positive
    full = full.withColumn("sequence_id", -1 - F.col("sequence_id"))
    rest = held.filter(F.col("length") < capacity).join(placed, keys)
    out = materialise(full.unionByName(rest), "packed")
    discard(held)
    return out


def pack_documents(docs: DataFrame, path: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null or empty text is the one id ``end_id``.  Repeated rows and null doc_ids are packed as they come.
    An empty table gives an empty result.
    """
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), capacity, group_pieces).drop("row")
