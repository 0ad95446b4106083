"""From scanned and parsed files to claims: admission, symbols, relations, dependencies, coverage, drafts.

spans        file_id, symbol_id, name, kind, start, end (bytes, half open)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.scratch import parts

# What a relation or reference of a file claims, and how surely; how many references one source may have.
CLAIMS = {"calls": ("CALLS", 0.5), "imports": ("IMPORTS", 0.9), "inherits": ("REFERENCES", 0.9), "references": ("REFERENCES", 0.5), "contains": ("DEFINES", 0.9)}
SITE_ORDER = ["imports", "inherits", "calls", "references"]
MOST_SITES = 64


def admission(wanted: DataFrame, scanned: DataFrame, sources: DataFrame, identities: DataFrame) -> DataFrame:
    """Each wanted path with the first reason against it: no_source, not_scanned, changed (the digests differ), no_identity; null if it is admitted.

    ``scanned``: path, digest.  ``sources``: path, digest of the bytes read.  ``identities``: path, file_id.
    """
    out = wanted.join(scanned.select("path", F.col("digest").alias("_scan")), "path", "left").join(sources.select("path", F.col("digest").alias("_read")), "path", "left").join(identities.select("path", "file_id"), "path", "left")
    reason = F.when(F.col("_read").isNull(), "no_source").when(F.col("_scan").isNull(), "not_scanned").when(F.col("_scan") != F.col("_read"), "changed").when(F.col("file_id").isNull(), "no_identity")
    return out.withColumn("reason", reason).drop("_scan", "_read")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (file_id, start, end, and their own columns) with ``enclosing``: the smallest span that contains them, the later start among equals; null if none does.

    A file's spans, which a parse bounds, are gathered once and each of its points looks among them: files are dealt once, over parts that grow with the input.
    """
    n = parts(points, spans)
    size = F.col("end") - F.col("start")
    inside = spans.repartition(n, "file_id").groupBy("file_id").agg(F.collect_list(F.struct(size.alias("size"), (-F.col("start")).alias("from"), F.col("symbol_id").alias("id"), F.col("end").alias("to"))).alias("_spans"))
    wide = points.repartition(n, "file_id").join(inside, "file_id", "left")
    held = F.filter("_spans", lambda x: (-x["from"] <= F.col("start")) & (F.col("end") <= x["to"]))
    return wide.withColumn("enclosing", F.array_min(held)["id"]).drop("_spans")


def index_matches(definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """Index definitions (file_id, scip, name, start, end) matched to the parsed symbol of that name whose bytes hold them; each index symbol and each parsed one is used once a file."""
    s = spans.select("file_id", "name", "symbol_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = definitions.join(s, ["file_id", "name"]).filter((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")))
    tight = Window.partitionBy("file_id", "scip").orderBy(F.col("_e") - F.col("_s"), "symbol_id", "start")
    once = Window.partitionBy("file_id", "symbol_id").orderBy("start", "scip")
    best = held.withColumn("_r", F.row_number().over(tight)).filter("_r = 1").withColumn("_r", F.row_number().over(once)).filter("_r = 1")
    return best.select("file_id", "scip", "symbol_id")


def subject(enclosing: Column, module_symbol: Column, file: Column) -> Column:
    return F.coalesce(enclosing, module_symbol, file)


def relation_claims(sites: DataFrame) -> DataFrame:
    """Sites (subject, kind, object, revision_id, start) as claims: subject, predicate, object, revision_id, confidence; no self edges, one a key with the surest kind."""
    table = F.create_map(*[x for k, (p, c) in CLAIMS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("predicate"), F.lit(c).alias("confidence")))])
    named = sites.filter(~F.col("subject").eqNullSafe(F.col("object"))).withColumn("_c", table[F.col("kind")]).filter("_c is not null")
    return named.groupBy("subject", F.col("_c.predicate").alias("predicate"), "object", "revision_id").agg(F.max("_c.confidence").alias("confidence"), F.min("start").alias("first_site"))


def reference_sites(sites: DataFrame, cap: int = MOST_SITES) -> DataFrame:
    """The first site of each (source, kind, target, alias), imports before bases before calls; at most ``cap`` a source, and ``cut`` tells of more."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(SITE_ORDER)], F.lit(len(SITE_ORDER)))
    key = ["source", "kind", "target", "alias"]
    first = sites.groupBy(*key).agg(F.min("start").alias("start"))
    w = Window.partitionBy("source").orderBy(kind, "start", "target", "alias")
    placed = first.withColumn("place", F.row_number().over(w).cast("long"))
    total = F.count("*").over(Window.partitionBy("source"))
    return placed.withColumn("cut", total > cap).filter(F.col("place") <= cap)


def dependency_claims(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """External top-level names of imports (module_id, target, revision_id), one a (module, name, revision): those that are no module (name) of the repository."""
    named = imports.filter("target is not null and target <> ''").select("module_id", F.substring_index("target", ".", 1).alias("name"), "revision_id").distinct()
    own = modules.select(F.substring_index("name", ".", 1).alias("name")).distinct()
    return named.join(own, "name", "left_anti")


def coverage(files: DataFrame, losses: DataFrame, tracked: DataFrame) -> DataFrame:
    """Per file complete and its sorted losses (joined by commas): ``files`` admitted, ``losses`` (file_id, code), and not_indexed for clean tracked files never admitted."""
    lost = losses.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("losses"))  # a closed set of codes
    got = files.select("file_id").join(lost, "file_id", "left").select("file_id", F.col("losses").isNull().alias("complete"), F.coalesce("losses", F.lit("")).alias("losses"))
    missed = tracked.filter("clean").select("file_id").join(files.select("file_id"), "file_id", "left_anti")
    return got.unionByName(missed.select("file_id", F.lit(False).alias("complete"), F.lit("not_indexed").alias("losses")))


def invalid_symbols(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed symbols that break the rules of an extractor's answer: range outside the file's bytes or reversed, a key (file, name, kind, start) twice, a name out of bounds."""
    n = parts(spans, files)
    wide = spans.repartition(n, "file_id").join(files.select("file_id", "n_bytes").repartition(n, "file_id"), "file_id", "left")
    twice = F.count("*").over(Window.partitionBy("file_id", "name", "kind", "start")) > 1
    fault = (
        F.when(F.col("n_bytes").isNull(), "unknown_file").when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("n_bytes")), "range")
        .when((F.octet_length("name") < 1) | (F.octet_length("name") > 512), "name").when(twice, "duplicate")
    )
    return wide.withColumn("fault", fault).filter("fault is not null").drop("n_bytes")


def keyed_drafts(drafts: DataFrame, view: Column) -> DataFrame:
    """Drafts with ``claim``, the digest of their view (what they say, without how it was observed); of equal claims in a run the first stays."""
    # dealt by run before the digest is made, so no digest is moved
    keyed = drafts.repartition(parts(drafts), "run").withColumn("claim", F.sha2(view, 256))
    w = Window.partitionBy("run", "claim").orderBy("at", "draft_id")
    return keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def submit(drafts: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts to send with their batch of 500, conflicts): a draft whose key (key, claim) the ledger has is skipped if the claim is equal, refused if not."""
    said = F.unhex(F.sha2("claim", 256))  # claims are compared by 32 bytes; the text of one moves only if the caller reads it
    held = drafts.withColumn("_own", said).join(ledger.select("key", said.alias("_c")), "key", "left")
    fresh = held.filter("_c is null").drop("_c", "_own")
    place = F.row_number().over(Window.partitionBy("run").orderBy("at", "draft_id")) - 1
    return fresh.withColumn("batch", F.floor(place / 500)), held.filter("_c <> _own").drop("_c", "_own")


def configuration_digest(parts: DataFrame, scope: str) -> DataFrame:
    """Per scope the digest of its sorted distinct configuration parts (name, version), of which a run has a few."""
    return parts.groupBy(scope).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", "name", "version"))), ";"), 256).alias("configuration"))


def owner_chain(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses (use_id, file_id, name, chain) resolved to the one symbol of that file and name whose owners (array) equal the chain; several or none leave it open."""
    key = ["file_id", "name", "chain"]
    # grouped before the join: the symbols of one key are one row however many they are
    named = symbols.groupBy("file_id", "name", F.col("owners").alias("chain")).agg(F.min("symbol_id").alias("_low"), F.max("symbol_id").alias("_high"))
    held = uses.select("use_id", *key).join(named, key).groupBy("use_id").agg(F.min("_low").alias("symbol_id"), F.max("_high").alias("_high"))
    return held.filter(F.col("symbol_id") == F.col("_high")).drop("_high")


def package_lookup(uses: DataFrame, tops: DataFrame) -> DataFrame:
    """Uses (use_id, directory, is_test, name) resolved to the only top-level name of their package, test files apart."""
    only = tops.groupBy("directory", "is_test", "name").agg(F.min("symbol_id").alias("symbol_id"), F.max("symbol_id").alias("_high")).filter("symbol_id = _high").drop("_high")
    return uses.join(only, ["directory", "is_test", "name"]).select("use_id", "symbol_id")


def supersessions(removed: DataFrame, added: DataFrame, similar: DataFrame, scope: str) -> DataFrame:
    """Claims of new files to old ones where no unique move keeps the id: scope, path, old_id, basis, confidence.

    ``removed``: scope, path, blob, file_id.  ``added``: scope, path, blob.  ``similar``: scope, path (added), old_path, score.  The same blob gives 0.5, similarity its score
    up to 0.9, the same path 0.25; where one old id is reached several ways the last of these says which.
    """
    r = removed.select(scope, F.col("path").alias("old_path"), "blob", F.col("file_id").alias("old_id"))
    pairs = added.groupBy(scope, "blob").agg(F.count("*").alias("_a")).join(r.groupBy(scope, "blob").agg(F.count("*").alias("_r")), [scope, "blob"]).filter("_a = 1 and _r = 1").select(scope, "blob")
    moved = added.join(pairs, [scope, "blob"]).join(r, [scope, "blob"]).filter("path <> old_path").select(scope, "path")
    new = added.join(moved, [scope, "path"], "left_anti")
    blob = new.join(r, [scope, "blob"]).select(scope, "path", "old_id", F.lit(0).alias("rule"), F.lit("blob").alias("basis"), F.lit(0.5).alias("confidence"))
    alike = new.join(similar.groupBy(scope, "path", "old_path").agg(F.max("score").alias("score")), [scope, "path"]).join(r.drop("blob"), [scope, "old_path"])
    alike = alike.select(scope, "path", "old_id", F.lit(1).alias("rule"), F.lit("similar").alias("basis"), F.least("score", F.lit(0.9)).alias("confidence"))
    same = new.join(r.select(scope, F.col("old_path").alias("path"), "old_id"), [scope, "path"]).select(scope, "path", "old_id", F.lit(2).alias("rule"), F.lit("path").alias("basis"), F.lit(0.25).alias("confidence"))
    every = blob.unionByName(alike).unionByName(same)
    return every.groupBy(scope, "path", "old_id").agg(F.max_by(F.struct("basis", "confidence"), "rule").alias("c")).select(scope, "path", "old_id", "c.basis", "c.confidence")


def emitted_supersessions(claims: DataFrame) -> DataFrame:
    """Only what version control itself says for certain becomes an event."""
    return claims.filter("confidence = 1.0 and evidence = 'git'")
