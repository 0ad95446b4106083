"""Small rules that larger reads are made of: scopes, citations, properties, leaves of a checkout, sealed rows, references of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import identities
from chronofold.functions.scalars import git_blob_id
from chronofold.operators.contents import media_kind
from chronofold.operators.secondary import set_digest

# Properties that a digest leaves out, kinds of evidence from weak to strong, bytes that are looked at for a NUL, references that an item shows, runs that a view reads.
VOLATILE = ["_lock", "embedding"]
PRECEDENCE = ["llm_inference", "agent", "tree_sitter", "scip"]
SNIFFED, SHOWN, MOST_RUNS = 8000, 8, 1000
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def in_scope(project: str | None, repository: str | None) -> Column:
    """Rows of a project, a repository or both; a parameter that is None does not bind, a null column never matches."""
    every = F.lit(True)
    for want, name in ((project, "project_id"), (repository, "repository_id")):
        if want is not None:
            every &= F.coalesce(F.col(name) == want, F.lit(False))
    return every


def catalog_upsert(old: DataFrame, new: DataFrame, identity: list[str], time: str) -> DataFrame:
    """Each identity once, with the greatest time that either side has."""
    return old.select(*identity, time).unionByName(new.select(*identity, time)).groupBy(*identity).agg(F.max(time).alias(time))


def citable(refs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Per event the first content, by id, that is sanitized and not purged."""
    live = refs.filter("disposition = 'sanitized'").join(tombstones.select("content_id"), "content_id", "left_anti")
    return live.groupBy("event_id").agg(F.min("content_id").alias("content_id"))


def without_dirty_runs(failures: DataFrame, snapshot) -> DataFrame:
    """Runs (array of struct run_id, snapshot_id) of another snapshot go, and with any of them the resolution."""
    clean = F.filter("runs", lambda r: r["snapshot_id"].isNull() | r["snapshot_id"].eqNullSafe(F.lit(snapshot)))
    return failures.withColumn("_c", clean).withColumn("resolution", F.when(F.size("_c") == F.size("runs"), F.col("resolution"))).withColumn("runs", F.col("_c")).drop("_c")


def stable(props: Column) -> Column:
    """Properties without the volatile ones, in order of their names."""
    kept = F.map_filter(props, lambda k, v: ~k.isin(VOLATILE))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def property_graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n, digest, n_unnamed) of all nodes (label, id, props) and edges (type, src, dst, props), whatever their order.

    A node without an id is known by its content.  Any change of a lasting property changes its label's digest.
    """
    text = lambda p: F.coalesce(F.to_json(stable(F.col(p))), F.lit("{}"))
    n = nodes.select("label", F.concat_ws("\u0001", F.lit("n"), F.coalesce("id", F.sha2(text("props"), 256)), text("props")).alias("line"), F.col("id").isNull().alias("unnamed"))
    e = edges.select(F.col("type").alias("label"), F.concat_ws("\u0001", F.lit("r"), "src", "dst", text("props")).alias("line"), F.lit(False).alias("unnamed"))
    both = n.unionByName(e)
    count = both.groupBy("label").agg(F.count_if("unnamed").alias("n_unnamed"))
    return set_digest(both, ["label"], F.col("line"), "digest").join(count, "label")


def named_sources(items: DataFrame, columns: list[str]) -> DataFrame:
    """Every source id that an item's columns (strings or arrays) name, a row each: item_id, source_id, well_formed."""
    kinds = dict(items.dtypes)
    each = F.flatten(F.array(*[F.coalesce(F.col(c), F.array()) if kinds[c].startswith("array") else F.array(c) for c in columns]))
    out = items.select("item_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("source_id")).distinct()
    return out.withColumn("well_formed", F.col("source_id").rlike(UUID))


def outranks(kind: Column, confidence: Column, other_kind: Column, other_confidence: Column) -> Column:
    """Whether evidence is of a stronger kind, or of the same with more confidence; a tie is no outranking, an unknown kind is the weakest."""
    place = lambda k: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), k), F.lit(0))
    return (place(kind) > place(other_kind)) | ((place(kind) == place(other_kind)) & (confidence > other_confidence))


def newest_runs(runs: DataFrame, cap: int = MOST_RUNS) -> DataFrame:
    """Each scope's newest ``cap`` runs; a cap is part of the read."""
    w = Window.partitionBy("scope").orderBy(F.desc("at"), F.desc("run"))
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def leaves(entries: DataFrame, root: Column, most_bytes: int) -> DataFrame:
    """Entries (path, kind, data, target) as a scan sees them: size, digest, blob id, whether a NUL is among the first bytes; or why one is skipped."""
    size = F.octet_length("data").cast("long")
    escapes = (F.col("kind") == "link") & (F.col("target").startswith("/") | F.concat(F.lit("/"), "target", F.lit("/")).contains("/../"))
    skip = F.when((F.col("kind") == "file") & F.col("data").isNull(), "missing").when(escapes, "escapes").when((F.col("kind") == "file") & (size > most_bytes), "too_large")
    read = skip.isNull() & (F.col("kind") == "file")
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring(F.col("data"), 1, SNIFFED)), "(..)", "$1 ")) > 0
    return entries.select(
        F.concat(root, F.lit("/"), "path").alias("path"), "kind", skip.alias("skip"), F.when(read, size).alias("size"), F.when(read, F.sha2("data", 256)).alias("digest"), F.when(read, git_blob_id(F.col("data"))).alias("blob"), F.when(read, binary).alias("binary"),
    )


def gitlink_changes(head: DataFrame, index: DataFrame) -> DataFrame:
    """Submodule pointers (path, oid) that differ between HEAD and the index: path, head_oid, index_oid, null where one has none."""
    h, i = head.select("path", F.col("oid").alias("head_oid")), index.select("path", F.col("oid").alias("index_oid"))
    return h.join(i, "path", "full_outer").filter(~F.col("head_oid").eqNullSafe(F.col("index_oid")))


def sealed_rows(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(event rows, content references, outbox rows) of sealed events with content_refs (array of struct content_id, storage)."""
    refs = events.select("event_id", F.posexplode("content_refs").alias("place", "ref")).select("event_id", F.col("place").cast("long").alias("place"), "ref.*")
    return events.drop("content_refs"), refs, events.select("event_id", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def references(citations: DataFrame, scheme: str) -> DataFrame:
    """Citations (item_id, event_id, content_id, media_type, valid_from, valid_to, confidence) as references: an interval that is empty is open, a confidence outside 0 to 1 is dropped."""
    good = citations.filter(F.col("confidence").between(0, 1))
    until = F.when(F.col("valid_to") > F.col("valid_from"), F.col("valid_to"))
    return good.select("item_id", "event_id", "valid_from", until.alias("valid_to"), "confidence", F.coalesce(media_kind(F.col("media_type")), F.lit("metadata")).alias("form"), identities.resource_uri(scheme, F.col("event_id"), F.col("content_id")).alias("uri"))


def shown_references(refs: DataFrame, cap: int = SHOWN) -> DataFrame:
    """Each item's distinct references in order of their uri, the first ``cap`` joined by blanks, and how many it has."""
    each = refs.select("item_id", "uri").distinct()
    w = Window.partitionBy("item_id")
    placed = each.withColumn("r", F.row_number().over(w.orderBy("uri"))).withColumn("n", F.count("*").over(w)).filter(F.col("r") <= cap)
    return placed.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("uri")), " ").alias("uris"), F.max("n").alias("n"))  # at most ``cap`` each


def retry_batches(outcomes: DataFrame) -> DataFrame:
    """What an ingest sends again after a refused batch: its events but the offenders; nothing of a batch without one."""
    bad = outcomes.filter("outcome = 'conflict'").select("batch").distinct()
    return outcomes.filter("outcome = 'batch_rejected'").join(bad, "batch", "left_semi").select("batch", "event_id")


def report_key(projector: Column, version: Column, digest: Column, outcome: Column) -> Column:
    """Key of a verification report: the same outcome of the same state is one event."""
    return F.concat(F.lit("report-"), F.substring(F.sha2(identities.framed(projector, version, digest, outcome), 256), 1, 40))


def proximity(reached: DataFrame, members: DataFrame, latest: Column) -> DataFrame:
    """(id, distance) of the current walk for members of a revision that is the latest; others have none."""
    return members.withColumn("_l", latest).join(reached.groupBy("id").agg(F.min("distance").alias("distance")), "id", "left").select("id", F.when(F.col("_l"), F.col("distance")).alias("distance"))
