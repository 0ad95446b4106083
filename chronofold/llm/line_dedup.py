"""Line deduplication against a sharded minimal perfect hash.

1. Each document gives the distinct 128-bit hashes of its eligible lines; they are counted with map-side combination, so a line
   that a third of all documents hold moves as a few partial sums.  Documents are counted, not rows: where a doc_id repeats, the
   pairs of key and doc_id are made distinct first, dealt by both.
2. Keys in at least ``min_docs`` documents (others can lose no line) go to shards by hash.  Each shard becomes a
   minimal perfect hash that indexes compact arrays: a 64-bit fingerprint, a saturating count, and the
   doc_id that keeps its lines.
3. Documents probe the arrays map-side; no line is joined.  The arrays are broadcast when their measured
   size is within ``broadcast_limit``; beyond it, each document's hashes go to the shards in salted groups of
   bounded size (``probe_by_shard``), again as hashes, never as lines.  What they find comes back as bitmaps over the line numbers of a chunk of the
   written documents (``chunks``), so no text is shuffled.

Keys are equal when their 128-bit hashes are: 64 bits place a key, the other 64 are its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm import chunks
from chronofold.llm.common import bounded_batches, discard, materialise, without
from chronofold.llm.mphash import MinimalPerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, BROADCAST_LIMIT, PROBES = 1 << 18, 64 << 20, 1 << 18
STRIP = b" \t\n\v\f\r"
SATURATED = 255
NO_ID = -(1 << 63)  # stands for a null doc_id, which is smaller than any other


def line_keys(text: str, min_chars: int) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """The lines, the positions of the eligible ones, and their hashes as (lo, hi)."""
    lines, at, keys = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.encode().strip(STRIP).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                h = xxhash.xxh3_128_intdigest(key)
                at.append(i)
                keys.append((h & 0xFFFFFFFFFFFFFFFF, h >> 64))
    return lines, at, keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _emit_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(line_keys(text or "", min_chars)[2])
                keys += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
            k = np.array(keys, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([_signed(k[:, 0]), _signed(k[:, 1]), pa.array(ids, pa.int64())], names=["lo", "hi", "doc_id"])

    return run


def _build_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    lo = table["lo"].to_numpy().view(np.uint64)
    hi = table["hi"].to_numpy().view(np.uint64)
    mph = MinimalPerfectHash.build(lo, hi)
    at = mph.index(lo, hi)
    fingerprint, count, keeper = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint8), np.zeros(len(lo), np.int64)
    fingerprint[at], count[at], keeper[at] = hi, np.minimum(table["n"].to_numpy(), SATURATED), table["keeper"].to_numpy()
    blob = mph.dump(fingerprint=fingerprint, count=count, keeper=keeper)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "probes": pa.array([int(table["rows"].to_numpy().sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})


class LineIndex:
    """Shards of (perfect hash, fingerprints, counts, keepers)."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.shards, self.parts = shards, {k: MinimalPerfectHash.load(b) for k, b in blobs.items()}

    def shard_of(self, lo: np.ndarray) -> np.ndarray:
        return (lo % np.uint64(self.shards)).astype(np.int64)

    def drops(self, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, min_docs: int = MIN_DOCS) -> np.ndarray:
        """Whether each line is to go: its key is indexed, its count suffices, and another document keeps it."""
        out = np.zeros(len(lo), bool)
        shard = self.shard_of(lo)
        for s in np.unique(shard):
            if int(s) not in self.parts:
                continue
            mph, arrays = self.parts[int(s)]
            rows = np.flatnonzero(shard == s)
            at = mph.index(lo[rows], hi[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            known = (arrays["fingerprint"][at] == hi[rows]) & (arrays["count"][at] >= min(min_docs, SATURATED))
            out[rows] = known & (arrays["keeper"][at] != doc[rows])
        return out


def build_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, shard_keys: int) -> tuple[DataFrame, int]:
    """The shards (shard, probes, blob) as a written table, and their number."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = source.mapInArrow(_emit_keys(min_chars), "lo long, hi long, doc_id long")
    repeated = not source.groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty()
    held_by = F.count_distinct("doc_id") if repeated else F.count("*")
    counted = materialise(
        keys.groupBy("lo", "hi").agg(held_by.alias("n"), F.count("*").alias("rows"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs), "line-counts"
    )
    shards = max(1, -(-counted.count() // shard_keys))
    # lo as unsigned, modulo the shards, so that documents can compute it in NumPy
    shard = (F.expr(f"pmod(cast(shiftrightunsigned(lo, 1) as decimal(20,0)) * 2 + (lo & 1), {shards})")).cast("long")
    built = counted.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard, "shard long, probes long, blob binary")
    index = materialise(built, "line-index")
    discard(counted)
    return index, shards


def _ids(values: list) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in values], np.int64)


def _apply_drops(texts: list[str], min_chars: int, decide) -> tuple[list[str], list[int], list[int]]:
    split = [line_keys(t, min_chars) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s[1]) for s in split])
    keys = np.array([k for s in split for k in s[2]], np.uint64).reshape(-1, 2)
    drop = decide(keys[:, 0], keys[:, 1], owner)
    at = np.array([i for s in split for i in s[1]], np.int64)
    gone: dict[int, set[int]] = {}
    for o, i in zip(owner[drop].tolist(), at[drop].tolist(), strict=True):
        gone.setdefault(o, set()).add(i)
    kept = [t if k not in gone else "\n".join(x for i, x in enumerate(split[k][0]) if i not in gone[k]) for k, t in enumerate(texts)]
    return kept, [len(s[0]) for s in split], [len(gone.get(k, ())) for k in range(len(texts))]


RESULT = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def probe_broadcast(docs: DataFrame, index: DataFrame, shards: int, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.select("shard", "blob").toLocalIterator()})
    base = without(docs, [f.name for f in RESULT])
    names = [f"c{i}" for i in range(len(base.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = LineIndex(sent.value, shards)
        for batch in batches:
            doc = _ids(batch.column(len(names)).to_pylist())
            texts = [t or "" for t in batch.column(len(names) + 1).to_pylist()]
            kept, n, gone = _apply_drops(texts, min_chars, lambda lo, hi, owner, doc=doc: lines.drops(lo, hi, doc[owner], min_docs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                names=[*names, "n0", "n1", "n2"],
            )

    source = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(base.columns, names, strict=True)],
        F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"),
    )
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, base.schema.fields, strict=True)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(RESULT)])
    return source.mapInArrow(run, schema).toDF(*base.columns, *[f.name for f in RESULT])


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row its chunk and the number of its first line there; a chunk ends with the row that fills it."""
    part, chunk, at = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        chunks_out, starts = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            n = 1 + (text or "").count("\n")
            if at and at + n > chunks.CHUNK:
                chunk, at = chunk + 1, 0
            chunks_out.append(part | chunk)
            starts.append(at)
            at += n
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(chunks_out, pa.int64()), pa.array(starts, pa.int64())], names=[f"c{i}" for i in range(len(columns))] + ["chunk", "start"])


def probe_by_shard(docs: DataFrame, index: DataFrame, shards: int, id_col: str, text_col: str, min_chars: int, min_docs: int, probes: int = PROBES) -> DataFrame:
    """The same result for an index of any size: hashes go to (shard, salt) groups of about ``probes`` rows.

    The number of salts of a shard follows from the counts in its array, so a line held by a third of all documents is dealt
    over as many groups as its shard needs.
    """
    columns = [*docs.columns]
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [T.StructField("chunk", T.LongType()), T.StructField("start", T.LongType())])
    held = chunks.write(numbered.mapInArrow(_number_lines, schema), "chunk", "line-docs")
    place = {c.lower(): f"c{i}" for i, c in enumerate(columns)}
    ident, text = F.col(place[id_col.lower()]).cast("long"), F.col(place[text_col.lower()]).cast("string")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, ids, at, los, his = [], [], [], [], []
            for c, start, d, t in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                _, where, keys = line_keys(t or "", min_chars)
                chunk += [c] * len(where)
                ids += [NO_ID if d is None else d] * len(where)
                at += [start + x for x in where]
                los += [k[0] for k in keys]
                his += [k[1] for k in keys]
            lo = np.array(los, np.uint64)
            shard = (lo % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), _signed(lo), _signed(np.array(his, np.uint64)), pa.array(shard)], names=["chunk", "doc", "at", "lo", "hi", "shard"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "at": pa.array([], pa.int64())})
        shard = right["shard"][0].as_py()
        lines = LineIndex({shard: right["blob"][0].as_py()}, shards)
        drop = lines.drops(left["lo"].to_numpy().view(np.uint64), left["hi"].to_numpy().view(np.uint64), left["doc"].to_numpy(), min_docs)
        return pa.table({"chunk": left["chunk"].to_numpy()[drop], "at": left["at"].to_numpy()[drop]})

    hashes = held.select("chunk", "start", ident.alias("doc"), text.alias("text")).mapInArrow(emit, "chunk long, doc long, at long, lo long, hi long, shard long")
    salts = index.select("shard", F.greatest(F.lit(1), F.ceil(F.col("probes") / probes)).cast("long").alias("salts"))
    dealt = hashes.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("chunk", "at"), F.col("salts")))
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("shard", "salt", "blob")
    gone = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "chunk long, at long")
    marked, words = chunks.with_words(held, "chunk", materialise(chunks.bitmaps(gone), "dropped-lines"))
    pieces = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.filter(pieces, lambda x, i: ~chunks.marked(words, F.col("start") + i.cast("long")))
    names = {f.name for f in RESULT}
    base = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in names]
    out = marked.select(*base, kept.alias("own_kept"), F.size(pieces).cast("long").alias("n_lines"))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in ("own_kept", "n_lines")], F.array_join("own_kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("own_kept")).alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """All columns of ``docs`` plus kept_text, n_lines (before dropping) and n_dropped.

    Lines split at ``\\n``; null or empty text is one empty line.  A key held by at least ``min_docs`` documents loses its lines
    everywhere but in the document with the largest doc_id holding it.  Rows with one doc_id are one document: they count once and all keep
    their lines where it is the largest; null is a doc_id of its own, smaller than any other.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    index, shards = build_index(docs, id_col, text_col, min_chars, min_docs, shard_keys)
    size = index.agg(F.sum(F.length("blob"))).first()[0] or 0
    probe = probe_broadcast if size <= broadcast_limit else probe_by_shard
    return probe(docs, index, shards, id_col, text_col, min_chars, min_docs)


ORACLE = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.pos, d.line, h.k IS NOT NULL AND h.keeper <> d.doc_id AS gone FROM keyed d LEFT JOIN hot h ON d.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
