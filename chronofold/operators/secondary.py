"""Caps, ranks, lineage and delivery rules that larger operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recency_rank(df: DataFrame, scope: list[str], time: str) -> DataFrame:
    """Dense rank of distinct times scaled to [0, 1] per scope; a single time is 1, a null time 0."""
    times = df.filter(F.col(time).isNotNull()).select(*scope, time).distinct()
    r = F.row_number().over(Window.partitionBy(*scope).orderBy(time))
    n = F.count("*").over(Window.partitionBy(*scope))
    ranked = times.select(*scope, time, F.when(n == 1, 1.0).otherwise((r - 1) / (n - 1)).alias("recency"))
    return df.join(ranked, [*scope, time], "left").withColumn("recency", F.coalesce("recency", F.lit(0.0)))


def ordinals(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """0..n-1 among the rows of a group."""
    return df.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def scan_caps(files: DataFrame, scope: str, path: str, size: Column, max_files: int, max_file: int, max_bytes: int) -> DataFrame:
    """Path-ordered admission per scope: too_large, then file_cap, then byte_cap; admitted rows have no reason."""
    w = Window.partitionBy(scope).orderBy(path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = files.withColumn("size", size).withColumn("fits", F.col("size") <= max_file)
    f = f.withColumn("n", F.sum(F.col("fits").cast("long")).over(w)).withColumn("total", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(w))
    reason = F.when(~F.col("fits"), "too_large").when(F.col("n") > max_files, "file_cap").when(F.col("total") > max_bytes, "byte_cap")
    return f.withColumn("reason", reason)


def cap_whole_groups(df: DataFrame, order: list[Column], group: str, cap: int) -> DataFrame:
    """The first ``cap`` rows in order, without the group that the cut goes through.  A cap is part of the feature here."""
    first = df.orderBy(*order).limit(cap + 1)
    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most cap + 1 rows
    split = numbered.filter(F.col("_n") == cap + 1).select(group)
    return numbered.filter(F.col("_n") <= cap).join(F.broadcast(split), group, "left_anti").drop("_n")


def checkpoint_advance(outbox: DataFrame, group: list[str]) -> DataFrame:
    """Greatest delivered outbox id with its event, and the number of events."""
    return outbox.filter("status = 'delivered'").groupBy(*group).agg(F.max("outbox_id").alias("last_outbox_id"), F.max_by("event_id", "outbox_id").alias("last_event_id"), F.count("*").alias("processed"))


def delivery_outcome(attempts: DataFrame, most: int, base: int, ceiling: int) -> DataFrame:
    """After a failed attempt: dead-lettered at ``most`` attempts, else pending again after a doubling delay."""
    from chronofold.functions.scalars import backoff_ms

    dead = F.col("attempt") >= most
    return attempts.withColumn("status", F.when(dead, "dead_lettered").otherwise("pending")).withColumn("delay_ms", F.when(~dead, backoff_ms(F.col("attempt"), base, ceiling)))


def run_outcome(flags: DataFrame) -> DataFrame:
    """The first loss by priority: scan_incomplete, snapshot_incomplete, files_skipped, files_degraded, else null."""
    names = ["scan_incomplete", "snapshot_incomplete", "files_skipped", "files_degraded"]
    return flags.withColumn("outcome", F.coalesce(*[F.when(F.col(n), n) for n in names]))


def resolve_renames(removed: DataFrame, added: DataFrame, scope: str) -> DataFrame:
    """Files of a commit: an exact blob with one removed and one added path keeps its id (1.0); an ambiguous blob is superseded (0.5); other added ones are new.

    ``removed``: scope, path, blob, file_id.  ``added``: scope, path, blob.
    """
    gone = removed.groupBy(scope, "blob").agg(F.count("*").alias("n_removed"), F.min("file_id").alias("old_id"))
    came = added.groupBy(scope, "blob").agg(F.count("*").alias("n_added"))
    out = added.join(came, [scope, "blob"]).join(gone, [scope, "blob"], "left")
    unique = (F.col("n_removed") == 1) & (F.col("n_added") == 1)
    basis = F.when(unique, "moved").when(F.col("n_removed").isNotNull(), "ambiguous").otherwise("new")
    confidence = F.when(basis == "moved", 1.0).when(basis == "ambiguous", 0.5)
    return out.select(scope, "path", basis.alias("basis"), F.when(unique, F.col("old_id")).alias("file_id"), confidence.alias("confidence"))


def hash_chain(events: DataFrame, stream: str, order: str, body: str) -> DataFrame:
    """digest = sha256(previous digest or '' + body), in order: the one rule here that is sequential by nature.

    Streams are sorted, not gathered: a task holds one batch and one digest, however long a stream is.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), ""
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last = hashlib.sha256((("" if own != at else last) + text).encode()).hexdigest()
                at = own
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[stream, order, "digest"])

    kinds = dict(events.dtypes)
    rows = events.select(stream, order, F.coalesce(body, F.lit("")).alias(body)).repartition(stream).sortWithinPartitions(stream, order)
    return rows.mapInArrow(fold, f"{stream} {kinds[stream]}, {order} {kinds[order]}, digest string")


def resolve_kind(ids: DataFrame, kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first kind, in the given order, whose table (column id) holds an id."""
    from functools import reduce

    named = reduce(DataFrame.unionByName, [t.select("id", F.lit(i).alias("k"), F.lit(n).alias("kind")) for i, (n, t) in enumerate(kinds)])
    return ids.join(named, "id").groupBy("id").agg(F.min_by("kind", "k").alias("kind"))


def latest_before(df: DataFrame, scope: list[str], order: list[str], binds: str, ident: str) -> DataFrame:
    """Backward as-of: the latest row of the scope that binds, strictly before each row."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("bound_to", F.last(F.when(F.col(binds), F.col(ident)), ignorenulls=True).over(w))


def set_digest(rows: DataFrame, scope: list[str], line: Column, name: str) -> DataFrame:
    """Per scope the number of its rows and an order-independent digest: row hashes in 4,096 buckets by their first digits, then the buckets' digests.

    A bucket's hashes are sorted and run through the hash one by one, so a task holds a batch of them however large the bucket is; no row
    holds more than the 4,096 bucket digests of a scope.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    h = F.sha2(line, 256)
    each = rows.select(F.to_json(F.struct(*scope)).alias("key"), F.substring(h, 1, 3).alias("b"), h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n = None, None, 0
        for batch in batches:
            out = []
            for own, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if own != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest(), n))
                    at, digest, n = own, hashlib.sha256(), 0
                digest.update(text.encode())
                n += 1
            if out:
                yield _bucket_rows(out)
        if at is not None:
            yield _bucket_rows([(*at, digest.hexdigest(), n)])

    buckets = each.repartition("key", "b").sortWithinPartitions("key", "b", "h").mapInArrow(run, "key string, b string, bh string, n long")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda x: x["bh"]), "")
    out = buckets.groupBy("key").agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias(name))
    kinds = rows.select(*scope).schema
    return out.select(F.from_json("key", kinds).alias("s"), "n", name).select("s.*", "n", name)


def _bucket_rows(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "b", "bh", "n"])


def snapshot_id(entries: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """Per scope the digest of its dirty entries, whatever their order."""
    return set_digest(entries, scope, F.concat_ws("|", *columns), "snapshot_id")
