"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into a ring of 4 segments of 16 bits.  If two fingerprints differ in at most 3
bits then, by the pigeonring principle, the ring has a start from which *every* chain of l segments differs in
at most floor(3 l / 4) bits: 0 for one segment, 1 for two, 2 for three.  The first two links of
that chain make the bucket key: segment i equal, and one half of segment i+1 equal (one differing bit leaves
one half untouched).  Inside a bucket the whole chain is checked, and only pairs that pass every chain
budget reach the full Hamming check.

A bucket yields a forest, never its pairs: for each fingerprint one edge to the first member of
its part.  Buckets above ``bucket_limit`` fingerprints leave the bucket step and are linked exactly through hubs: all
words within one bit of a member, and all within two, inside the free bits of the bucket.  A member within one bit of a hub and one within
two bits of it differ in at most three, and every pair at distance three or less has such a hub.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm import chunks
from chronofold.llm.common import Sweep, append_columns, bounded_batches, materialise
from chronofold.llm.components import connected_components

SHINGLE, MAX_DISTANCE, SEGMENTS, SEED, BUCKET_LIMIT = 3, 3, 4, 42, 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every word shingle in order, repeats included; a text shorter than a shingle has one, a text without words none."""
    words = (text or "").encode().lower().split()  # bytes: splits at \x20 \x09-\x0D and lowers A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k : k + n] for k in range(shingle)], strict=True))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def _keys(fps: np.ndarray) -> list[np.ndarray]:
    """The eight bucket keys of each fingerprint: (start i, half h, segment i, half h of segment i+1)."""
    width = np.uint64(16)
    segment = [(fps >> (width * np.uint64(i))) & np.uint64(0xFFFF) for i in range(SEGMENTS)]
    out = []
    for i in range(SEGMENTS):
        following = segment[(i + 1) % SEGMENTS]
        for h in range(2):
            half = (following >> np.uint64(8 * h)) & np.uint64(0xFF)
            out.append((np.uint64(i * 2 + h) << np.uint64(24)) | (segment[i] << np.uint64(8)) | half)
    return out


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        keys = np.concatenate(_keys(fps.view(np.uint64))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fps, 8))], names=["key", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked(one: np.uint64, many: np.ndarray, start: int, limit: int = MAX_DISTANCE) -> np.ndarray:
    """Which of ``many`` are within ``limit`` bits of ``one``: chain budgets from segment ``start`` first, then all bits."""
    diff = many ^ one
    at = np.arange(len(many))
    total = np.zeros(len(many), np.int64)
    for chain in range(1, SEGMENTS + 1):
        i = np.uint64(16 * ((start + chain - 1) % SEGMENTS))
        total = total + _popcount((diff >> i) & np.uint64(0xFFFF))
        live = total <= limit * chain // SEGMENTS
        if chain < SEGMENTS:
            at, diff, total = at[live], diff[live], total[live]
    out = np.zeros(len(many), bool)
    out[at[_popcount(diff) <= limit]] = True
    return out


def bucket_forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges (first member, member) that join what the bucket links; at most len(fps) - 1 of them."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            hit = linked(fps[frontier.pop()], fps[left], start)
            found = left[hit]
            edges += [(int(fps[root].view(np.int64)), int(fps[x].view(np.int64))) for x in found]
            frontier += list(found)
            left = left[~hit]
    return edges


def _link_buckets(limit: int):
    """Over rows sorted by key: (a, b, null) for forest edges, (a, null, key) for members of oversized buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot = None, [], False

        def close():
            if hot or key is None or len(held) < 2:
                return []
            return bucket_forest(np.array(held, np.int64).view(np.uint64), int(key >> 25) & 3)

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key"])

        for batch in batches:
            out = []
            for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    out += [(a, b, None) for a, b in close()]
                    key, held, hot = k, [], False
                if hot:
                    out.append((f, None, k))
                    continue
                held.append(f)
                if len(held) > limit:
                    out += [(x, None, k) for x in held]
                    held, hot = [], True
            if out:
                yield batch_of(out)
        if rest := [(a, b, None) for a, b in close()]:
            yield batch_of(rest)

    return run


def _free_masks(key: int) -> tuple[np.ndarray, np.ndarray]:
    """Flip masks of up to one, and of exactly two, among the 40 bits that a bucket key leaves free."""
    i, h = (key >> 25) & 3, (key >> 24) & 1
    fixed = set(range(16 * i, 16 * i + 16)) | set(range(16 * ((i + 1) % 4) + 8 * h, 16 * ((i + 1) % 4) + 8 * h + 8))
    free = [b for b in range(64) if b not in fixed]
    one = [0] + [1 << b for b in free]
    two = [(1 << a) | (1 << b) for a, b in combinations(free, 2)]
    return np.array(one, np.uint64), np.array(two, np.uint64)


def _emit_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), strict=True):
            one, two = masks.setdefault(key >> 24, _free_masks(key))
            hubs = np.concatenate([one, two]) ^ fp
            near = np.arange(len(hubs)) < len(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hubs), key)), pa.array(hubs.view(np.int64)), pa.array(np.full(len(hubs), fp.view(np.int64))), pa.array(near)],
                names=["key", "hub", "fp", "near"],
            )


def hub_edges(hot: DataFrame) -> DataFrame:
    """Exact links inside oversized buckets (key, fp): each member of a hub joins the hub's smallest near member.

    A hub is reached by few members, because the fingerprints are distinct; nothing is kept per pair.
    """
    rows = hot.mapInArrow(_emit_hubs, "key long, hub long, fp long, near boolean")
    first = rows.groupBy("key", "hub").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count("*").alias("n")
    ).filter("a is not null and n > 1")
    return rows.join(first, ["key", "hub"]).select("a", F.col("fp").alias("b"))


def simhash_links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all links within 3 bits."""
    keys = fps.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(sorted_keys.mapInArrow(_link_buckets(bucket_limit), "a long, b long, key long"), "simhash-links")
    edges = found.filter("b is not null").select("a", "b")
    hot = found.filter("b is null").select("key", F.col("a").alias("fp"))
    return edges if hot.isEmpty() else edges.unionByName(hub_edges(hot))


def fingerprint_classes(rows: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, root, component_id) for every distinct fp of ``rows`` (doc_id, fp): written, so that joins on fp can split hot ones."""
    sweep = Sweep(rows.sparkSession)
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(simhash_links(distinct, bucket_limit))
    labelled = materialise(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    smallest = materialise(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    classes = materialise(labelled.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")
    sweep(classes)
    return classes


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, group (a label of the component).

    Null and empty texts, and texts of white space only, have fingerprint zero and link like any other.  component_id is the smallest
    non-null doc_id that links reach (null if there is none); repeated rows share it.  An empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(source.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    return rows.join(fingerprint_classes(rows, bucket_limit), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("group")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The columns of ``docs``, one row for each component: the longest text, then the largest doc_id, then any one of repeated rows.

    Nulls as in ``simhash_dedup``; a null doc_id is the smallest.  Columns of any name pass through.  An empty table gives an empty result.
    The texts are written once and not shuffled: the rows to go are bitmaps of their chunks (``chunks``).
    """
    bounded_batches(docs.sparkSession)

    def compute():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    fp, number, chunk = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("fp", "number", "chunk"))
    marked = append_columns(docs, [T.StructField(fp, T.LongType())], compute, text_col).withColumn(number, F.monotonically_increasing_id())
    held = chunks.write(marked.withColumn(chunk, F.shiftright(number, chunks.CHUNK_BITS)), chunk, "simhash-docs")
    narrow = held.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(number).alias("row"), F.coalesce(F.char_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).alias("n"),
    )
    classes = fingerprint_classes(narrow.select("doc_id", "fp"), bucket_limit).select("fp", "root")
    return drop_all_but_best(held, narrow.join(classes, "fp").select("root", "n", "doc_id", "row"), number, chunk, docs.columns)


def drop_all_but_best(held: DataFrame, labelled: DataFrame, number: str, chunk: str, columns: list[str]) -> DataFrame:
    """Of each root's rows (root, n, doc_id, row) the greatest (n, doc_id, row) stays in ``held``, a table of ``chunks.write`` numbered by ``number``."""
    labelled = materialise(labelled, "labelled-rows")
    best = labelled.groupBy("root").agg(F.max(F.struct("n", "doc_id", "row")).alias("w"), F.count("*").alias("rows")).filter("rows > 1")
    losers = labelled.join(best.select("root", F.col("w.row").alias("winner")), "root").filter("row <> winner")
    gone = chunks.bitmaps(losers.select(F.shiftright("row", chunks.CHUNK_BITS).alias("chunk"), F.pmod("row", F.lit(chunks.CHUNK)).alias("at")))
    told, words = chunks.with_words(held, chunk, materialise(gone, "dropped-rows"))
    return told.filter(~chunks.marked(words, F.pmod(number, F.lit(chunks.CHUNK)))).select(*[F.col(f"`{c}`") for c in columns])
