"""Near copies by exact Jaccard similarity of word-shingle sets, one kept of each component.

A class is all rows with one set of shingle hashes, named by one of these rows.  Pairs of classes are tested exactly, in two rounds.  The first takes few pairs
a class: the SimHash links of ``simhash`` (pigeonring, 3 bits) on fingerprints of these shingles, and for each shingle of the index below the
smallest class that holds it with every other.  A large group of near copies becomes one component here.  64 bits cannot
be searched at the radius that 0.8 asks for (about 10 bits on average, up to 20), so the second round makes the result whole by prefixes: sets of
similarity t or more share one of the first n - ceil(t n) + 1 hashes of each set, in any order that all sets share.  All pairs in the index
that are still in different components, and whose lengths and places leave t possible, are tested.  The order is by hash, but shingles that
are common in a sample of the texts come last, the commonest at the end; the sample and its bound change the work, never the result.

A test moves the sets of few pairs.  Each class has a bitmap of 2 to 4 bits a shingle, in which every shingle flips one bit: two bitmaps differ in no
more bits than their sets in shingles, so a pair whose bitmaps differ in more than t allows is out.  Only the pairs left are tested on whole sets.  Texts
are never shuffled: the rows wanted are bitmaps over the written chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm import chunks
from chronofold.llm.common import append_columns, bounded_batches, materialise
from chronofold.llm.components import connected_components
from chronofold.llm.simhash import drop_all_but_best, majority, shingle_hashes, simhash_links

SHINGLE, SIMILARITY, EPSILON, PAIRS_AT_ONCE = 5, 0.8, 1e-9, 65536
#: One text in so many is sampled for common shingles; a common one is held by so many sampled texts; so many are kept.
SAMPLED, COMMON, MOST_COMMON = 16, 3, 200_000
#: Rows of the index that a task is meant to sort, and those of a batch: they are six numbers.
POSTINGS_AT_ONCE, BATCH = 1 << 20, 1 << 15


def _least(n: int) -> int:
    return int(np.ceil(SIMILARITY * n - EPSILON))


def _class(each: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(each.tobytes())).view(np.int64))


def parity(each: np.ndarray) -> np.ndarray:
    """The bitmap of a set of distinct hashes, bytes: each flips one bit of 2 to 4 bits a hash, 64 at least."""
    bits = max(64, 1 << (2 * max(1, len(each)) - 1).bit_length())
    return np.packbits(np.bincount((each & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def may_be_alike(n: int, one: np.ndarray, m: int, other: np.ndarray) -> bool:
    """False only for sets of n and m hashes that cannot have the similarity, by their lengths or bitmaps."""
    if min(n, m) < SIMILARITY * max(n, m) - EPSILON:
        return False
    while len(one) != len(other):  # half the bits: the upper half flips the lower one
        if len(one) < len(other):
            one, other = other, one
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ other).sum()) <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + 1e-6


def _marks(common: np.ndarray, counts: np.ndarray):
    """Class, SimHash, number of distinct shingles, the prefix of the set and its bitmap; ``common`` shingles are sorted, with their counts."""

    def describe(text):
        hashes = shingle_hashes(text, SHINGLE)
        each = np.unique(hashes)
        n, order = len(each), each
        if len(common):
            at = np.minimum(np.searchsorted(common, each), len(common) - 1)
            order = each[np.argsort(np.where(common[at] == each, counts[at], 0), kind="stable")]
        prefix = order[: n - _least(n) + 1].view(np.int64)
        return _class(each), int(np.uint64(majority(hashes)).view(np.int64)), n, prefix, parity(each).tobytes()

    def compute():
        return lambda texts: [list(c) for c in zip(*map(describe, texts), strict=True)] or [[], [], [], [], []]

    return compute


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, SHINGLE)).view(np.int64))], names=["s"])


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles with the number of different sampled texts that hold each."""
    text = F.col(text_col).cast("string")
    sampled = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    held = sampled.mapInArrow(_explode_sets, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    top = held.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    s, n = (top.column(c).to_numpy() for c in ("s", "n"))
    s = s.astype(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], n[order].astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "shingles"])


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, na, ba, nb, bb) the pairs that lengths and bitmaps leave possible."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
        yield batch.select([0, 1]).filter(pa.array([may_be_alike(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8)) for n, x, m, y in rows], pa.bool_()))


class Held:
    """The written rows with their marks; ``of`` takes those of given numbers and moves only bitmaps of these."""

    def __init__(self, written: DataFrame, own: dict[str, str], text_col: str):
        self.written, self.own = written, own
        self.columns = {"cls": F.col(own["near_row"]), "n": F.col(own["near_n"]), "prefix": F.col(own["near_prefix"]), "bits": F.col(own["near_bits"]), "text": F.col(f"`{text_col}`").cast("string")}

    def of(self, rows: DataFrame, *columns: str) -> DataFrame:
        number = rows.columns[0]
        maps = chunks.bitmaps(rows.select(F.shiftright(number, chunks.CHUNK_BITS).alias("chunk"), F.pmod(number, F.lit(chunks.CHUNK)).alias("at")))
        told, words = chunks.with_words(self.written, self.own["chunk"], materialise(maps, "near-wanted"))
        return told.filter(chunks.marked(words, F.pmod(self.own["near_row"], F.lit(chunks.CHUNK)))).select(*[self.columns[c].alias(c) for c in columns])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def alike(pairs: DataFrame, held: Held) -> DataFrame:
    """The written pairs (a, b) of classes whose sets have the similarity: by bitmaps first, those left by the sets."""
    bits = materialise(held.of(_ends(pairs), "cls", "n", "bits"), "near-bits")
    told = pairs.join(bits.toDF("a", "na", "ba"), "a").join(bits.toDF("b", "nb", "bb"), "b").select("a", "b", "na", "ba", "nb", "bb")
    left = materialise(told.mapInArrow(_possible_pairs, "a long, b long"), "near-possible")
    sets = materialise(held.of(_ends(left), "cls", "text").mapInArrow(_sets, "cls long, shingles array<long>"), "near-sets")
    both = left.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    enough = common >= F.lit(SIMILARITY) * (F.size("sa") + F.size("sb") - common) - F.lit(EPSILON)
    return materialise(both.filter(enough).select("a", "b"), "near-alike")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Over rows sorted by their first column: columns of whole groups, and the places where groups begin and the last one ends."""
    rest: list[np.ndarray] | None = None

    def cut(columns, last):
        s = columns[0]
        return np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)] if last else []]).astype(np.int64)

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = new if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, new, strict=True)]
        if not len(columns[0]):
            continue
        cuts = cut(columns, False)
        if len(cuts) > 1:
            yield [c[: cuts[-1]] for c in columns], cuts
        rest = [c[cuts[-1] :] for c in columns]
    if rest is not None:
        yield rest, cut(rest, True)


def _shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (s, cls, n, pos) sorted by s, n and cls: those of shingles that several classes hold, with their number k and, where it leaves the similarity possible, the group's first class as ``lead``."""
    for columns, cuts in _whole_groups(batches):
        size = np.diff(cuts)
        k, first = np.repeat(size, size), np.repeat(cuts[:-1], size)
        at = np.flatnonzero(k > 1)
        s, cls, n, pos = (c[at] for c in columns)
        first = first[at]
        lead, lead_n, lead_pos = (c[first] for c in columns[1:])
        need = SIMILARITY / (1 + SIMILARITY) * (n + lead_n) - EPSILON
        fits = (at != first) & (lead_n >= SIMILARITY * n - EPSILON) & (np.minimum(n - pos, lead_n - lead_pos) >= need)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(cls), pa.array(n), pa.array(pos), pa.array(k[at]), pa.array(lead, mask=~fits)], names=["s", "cls", "n", "pos", "k", "lead"])


def _group_pairs(cls, comp, n, pos) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one shingle's classes, rising in n, of different components and within the length and place bounds."""
    for i in range(1, len(cls)):
        low = np.searchsorted(n[:i], SIMILARITY * n[i] - EPSILON)
        j = np.arange(low, i)
        possible = np.minimum(n[j] - pos[j], n[i] - pos[i])  # this shingle and all behind it
        need = SIMILARITY / (1 + SIMILARITY) * (n[j] + n[i]) - EPSILON
        j = j[(comp[j] != comp[i]) & (possible >= need)]
        if len(j):
            yield np.minimum(cls[j], cls[i]), np.maximum(cls[j], cls[i])


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (s, cls, comp, n, pos) sorted by s and n: pairs (a, b); a shingle's rows are held together."""
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = np.unique(np.stack([a, b]), axis=1)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for columns, cuts in _whole_groups(batches):
        held = 0
        comp = columns[2]
        mixed = np.minimum.reduceat(comp, cuts[:-1]) != np.maximum.reduceat(comp, cuts[:-1])
        for low, high in zip(cuts[:-1][mixed].tolist(), cuts[1:][mixed].tolist(), strict=True):
            for pair in _group_pairs(*(c[low:high] for c in columns[1:])):
                out.append(pair)
                held += len(pair[0])
                if held >= PAIRS_AT_ONCE:
                    held = 0
                    yield flush()
        if out:
            yield flush()


@contextmanager
def _number_batches(spark):
    """Larger Arrow batches for the writes made inside: ``bounded_batches`` is for rows with texts, and its limit of bytes stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def similar_edges(held: Held, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (cls, fp, n) that have the similarity; their components are those of all such pairs."""
    spark = classes.sparkSession
    rows = classes.select(F.sum((1 - SIMILARITY) * F.col("n") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows) // POSTINGS_AT_ONCE)
    long = [F.col(c).cast("long").alias(c) for c in ("n", "pos")]
    postings = held.of(classes.select("cls"), "cls", "n", "prefix").select("cls", "n", F.posexplode("prefix").alias("pos", "s")).repartition(parts, "s").sortWithinPartitions("s", "n", "cls")
    shared = postings.select("s", "cls", *long).mapInArrow(_shared_postings, "s long, cls long, n long, pos long, k long, lead long")
    with _number_batches(spark):
        posts = materialise(shared, "near-postings")
    star = posts.filter("lead is not null").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    by_fp = materialise(classes.groupBy("fp").agg(F.min("cls").alias("first")), "near-fps")
    same = classes.join(by_fp, "fp").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    links = simhash_links(by_fp.select("fp"))
    near = links.join(by_fp.toDF("a", "x"), "a").join(by_fp.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    every = star.unionByName(same).unionByName(near).filter("a <> b")
    tested = materialise(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-tested")
    edges = alike(tested, held)
    roots = connected_components(edges)
    placed = posts.filter("k > 2").join(roots, posts.cls == roots.node, "left").select("s", "cls", F.coalesce("root", "cls").alias("comp"), "n", "pos")
    found = placed.repartition("s").sortWithinPartitions("s", "n", "cls").mapInArrow(_cross_pairs, "a long, b long").distinct()
    with _number_batches(spark):
        more = materialise(found.join(tested, ["a", "b"], "left_anti"), "near-more")
    return edges.unionByName(alike(more, held))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, one row for each component: the longest text, then the largest doc_id, then any one of repeated rows.

    Texts without words (null, empty, white space) have one empty set and are alike; a null doc_id is the smallest.  Columns of any name pass
    through; an empty table gives an empty result.  As in ``simhash.keep_one`` the texts are written once and only bitmaps of their chunks are shuffled.
    """
    bounded_batches(docs.sparkSession)
    kinds = {"near_class": T.LongType(), "near_fp": T.LongType(), "near_n": T.IntegerType(), "near_prefix": T.ArrayType(T.LongType()), "near_bits": T.BinaryType()}
    own = {x: f"{x}_{uuid.uuid4().hex[:8]}" for x in (*kinds, "near_row", "chunk")}
    marked = append_columns(docs, [T.StructField(own[k], t) for k, t in kinds.items()], _marks(*common_shingles(docs, text_col)), text_col)
    marked = marked.withColumn(own["near_row"], F.monotonically_increasing_id())
    written = chunks.write(marked.withColumn(own["chunk"], F.shiftright(own["near_row"], chunks.CHUNK_BITS)), own["chunk"], "near-docs")
    narrow = written.select(
        F.col(own["near_class"]).alias("cls"), F.col(own["near_fp"]).alias("fp"), F.col(own["near_n"]).alias("shingles"), F.col(own["near_row"]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).alias("n"),
    )
    # a class has one set, but repeats may tip a bit of its SimHash: any of them will do
    named = materialise(narrow.groupBy("cls").agg(F.min("fp").alias("fp"), F.max("row").alias("first_row"), F.first("shingles").alias("n")), "near-classes")
    classes = named.select(F.col("first_row").alias("cls"), "fp", "n")
    roots = connected_components(similar_edges(Held(written, own, text_col), classes))
    labelled = materialise(named.join(roots, named.first_row == roots.node, "left").select("cls", F.coalesce("root", "first_row").alias("root")), "near-labels")
    return drop_all_but_best(written, narrow.join(labelled, "cls").select("root", "n", "doc_id", "row"), own["near_row"], own["chunk"], docs.columns)
