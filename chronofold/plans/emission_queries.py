"""Emission of claims over the driver's tables, with their SQL.

An order is a file; its lines are nested spans named by their part, and references at places that follow from their quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import emission as em
from chronofold.operators import lineage
from chronofold.sources.scratch import PART_BYTES, parts
from chronofold.sources.tables import table


def _spans(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_orderkey") * 10 + n).alias("symbol_id"), F.concat(F.lit("n"), (F.col("l_partkey") % 20).cast("string")).alias("name"), F.col("l_returnflag").alias("kind"),
        (n * 10).cast("long").alias("start"), (F.lit(200) - n * 10).cast("long").alias("end"),
    )


def _points(spark, d):
    at = (F.col("l_quantity") * 4).cast("long")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("l_orderkey").alias("file_id"), at.alias("start"), (at + 2).alias("end"), (F.col("l_partkey") % 20).alias("p"), "l_returnflag", "l_suppkey")


SPANS = """sp AS (SELECT l_orderkey AS file_id, l_orderkey * 10 + l_linenumber AS symbol_id, 'n' || (l_partkey % 20) AS name, l_returnflag AS kind, l_linenumber * 10 AS s, 200 - l_linenumber * 10 AS e FROM lineitem),
pt AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_orderkey AS file_id, CAST(l_quantity * 4 AS BIGINT) AS s, CAST(l_quantity * 4 AS BIGINT) + 2 AS e, l_partkey % 20 AS p, l_returnflag, l_suppkey FROM lineitem)"""


def enclosing_symbols(spark, d):
    return em.innermost(_points(spark, d), _spans(spark, d)).select("ref_id", "enclosing")


ENCLOSING = """di AS (SELECT pt.file_id, pt.s, pt.e, arg_min(sp.symbol_id, (sp.e - sp.s, -sp.s, sp.symbol_id)) AS enclosing FROM (SELECT DISTINCT file_id, s, e FROM pt) pt JOIN sp ON sp.file_id = pt.file_id AND sp.s <= pt.s AND pt.e <= sp.e GROUP BY ALL),
en AS (SELECT pt.*, di.enclosing FROM pt LEFT JOIN di USING (file_id, s, e))"""
ENCLOSING_SQL = f"WITH {SPANS}, {ENCLOSING} SELECT ref_id, enclosing FROM en"


def index_symbol_matches(spark, d):
    p = _points(spark, d)
    defs = p.select("file_id", F.concat(F.lit("scip "), (F.col("ref_id") % 3).cast("string"), F.lit(" "), F.col("p").cast("string")).alias("scip"), F.concat(F.lit("n"), F.col("p").cast("string")).alias("name"), "start", "end")
    return em.index_matches(defs, _spans(spark, d))


MATCHES_SQL = f"""WITH {SPANS}, m AS (SELECT pt.file_id, 'scip ' || (pt.ref_id % 3) || ' ' || pt.p AS scip, sp.symbol_id, sp.e - sp.s AS size, pt.s FROM pt JOIN sp ON sp.file_id = pt.file_id AND sp.name = 'n' || pt.p AND sp.s <= pt.s AND pt.e <= sp.e),
a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY file_id, scip ORDER BY size, symbol_id, s) = 1) SELECT file_id, scip, symbol_id FROM a QUALIFY row_number() OVER (PARTITION BY file_id, symbol_id ORDER BY s, scip) = 1"""


def relation_claims(spark, d):
    """References to supplier's symbols from the enclosing symbol, else from the file."""
    r = em.innermost(_points(spark, d), _spans(spark, d))
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "inherits").otherwise("references")
    who = em.subject(F.concat(F.lit("s"), F.col("enclosing").cast("string")), F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("m"), F.col("file_id").cast("string"))), F.concat(F.lit("f"), F.col("file_id").cast("string")))
    return em.relation_claims(r.select(who.alias("subject"), kind.alias("kind"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("object"), (F.col("file_id") % 7).alias("revision_id"), "start"))


RELATIONS_SQL = f"""WITH {SPANS}, {ENCLOSING}, x AS (SELECT coalesce('s' || enclosing, CASE WHEN file_id % 3 = 0 THEN 'm' || file_id END, 'f' || file_id) AS subject, CASE l_returnflag WHEN 'A' THEN 'CALLS' ELSE 'REFERENCES' END AS predicate, 'f' || l_suppkey AS object, file_id % 7 AS revision_id,
  CASE l_returnflag WHEN 'R' THEN 0.9 ELSE 0.5 END::DOUBLE AS c, s FROM en) SELECT subject, predicate, object, revision_id, max(c) AS confidence, min(s) AS first_site FROM x WHERE subject <> object GROUP BY ALL"""


def reference_sites(spark, d):
    """A supplier's references, at most sixteen."""
    line = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "imports").when(F.col("l_linenumber") == 2, "inherits").otherwise("calls")
    sites = line.select(F.col("l_suppkey").alias("source"), kind.alias("kind"), (F.col("l_partkey") % 50).alias("target"), F.when(F.col("l_returnflag") == "A", "a").otherwise("-").alias("alias"), F.col("l_orderkey").alias("start"))
    return em.reference_sites(sites, 16)


SITES_SQL = """WITH x AS (SELECT l_suppkey AS source, CASE l_linenumber WHEN 1 THEN 'imports' WHEN 2 THEN 'inherits' ELSE 'calls' END AS kind, l_partkey % 50 AS target, CASE l_returnflag WHEN 'A' THEN 'a' ELSE '-' END AS alias, min(l_orderkey) AS start FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE kind WHEN 'imports' THEN 0 WHEN 'inherits' THEN 1 ELSE 2 END, start, target, alias) AS place, count(*) OVER (PARTITION BY source) > 16 AS cut FROM x) SELECT * FROM p WHERE place <= 16"""


def dependency_claims(spark, d):
    line = table(spark, d, "lineitem")
    imports = line.select(F.col("l_suppkey").alias("module_id"), F.concat(F.lit("pkg"), (F.col("l_partkey") % 40).cast("string"), F.lit(".x")).alias("target"), (F.col("l_orderkey") % 3).alias("revision_id"))
    modules = table(spark, d, "nation").select(F.concat(F.lit("pkg"), F.col("n_nationkey").cast("string"), F.lit(".y")).alias("name"))
    return em.dependency_claims(imports, modules)


DEPENDENCY_SQL = "SELECT DISTINCT l_suppkey AS module_id, 'pkg' || (l_partkey % 40) AS name, l_orderkey % 3 AS revision_id FROM lineitem WHERE l_partkey % 40 NOT IN (SELECT n_nationkey FROM nation)"


def coverage_reports(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    losses = table(spark, d, "lineitem").filter("l_returnflag <> 'N' and l_linenumber > 2").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("lost_"), F.lower("l_returnflag")).alias("code"))
    return em.coverage(o.filter("file_id % 5 <> 0"), losses, o.withColumn("clean", F.col("file_id") % 10 == 0))


COVERAGE_SQL = """WITH l AS (SELECT l_orderkey AS file_id, array_to_string(list_sort(list(DISTINCT 'lost_' || lower(l_returnflag))), ',') AS losses FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber > 2 GROUP BY 1)
SELECT o_orderkey AS file_id, losses IS NULL AS complete, coalesce(losses, '') AS losses FROM orders LEFT JOIN l ON file_id = o_orderkey WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, false, 'not_indexed' FROM orders WHERE o_orderkey % 10 = 0"""


def file_admission(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.sha2("p_name", 256).alias("digest"))
    changed = F.when(F.col("path") % 7 == 0, F.lit("other")).otherwise(F.col("digest"))
    return em.admission(p.select("path"), p.filter("path % 5 <> 0"), p.filter("path % 3 <> 0").select("path", changed.alias("digest")), p.filter("path % 11 <> 0").select("path", F.col("path").alias("file_id"))).select("path", "file_id", "reason")


ADMISSION_SQL = """SELECT p_partkey AS path, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS file_id, CASE WHEN p_partkey % 3 = 0 THEN 'no_source' WHEN p_partkey % 5 = 0 THEN 'not_scanned' WHEN p_partkey % 7 = 0 THEN 'changed' WHEN p_partkey % 11 = 0 THEN 'no_identity' END AS reason FROM part"""


def symbol_validation(spark, d):
    spans = _spans(spark, d).withColumn("end", F.when(F.col("symbol_id") % 13 == 0, F.col("start") - 1).otherwise(F.col("end"))).withColumn("name", F.when(F.col("symbol_id") % 17 == 0, "").otherwise(F.col("name"))).withColumn("start", F.when(F.col("symbol_id") % 5 == 0, 0).otherwise(F.col("start")))
    files = table(spark, d, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("file_id"), (F.lit(160) + F.col("o_orderkey") % 40).alias("n_bytes"))
    return em.invalid_symbols(spans, files).select("file_id", "symbol_id", "fault")


VALIDATION_SQL = f"""WITH {SPANS}, x AS (SELECT file_id, symbol_id, kind, CASE WHEN symbol_id % 17 = 0 THEN '' ELSE name END AS name, CASE WHEN symbol_id % 5 = 0 THEN 0 ELSE s END AS b, CASE WHEN symbol_id % 13 = 0 THEN s - 1 ELSE e END AS e FROM sp),
y AS (SELECT *, count(*) OVER (PARTITION BY file_id, name, kind, b) > 1 AS twice FROM x) SELECT * FROM (SELECT file_id, symbol_id, CASE WHEN file_id % 9 = 0 THEN 'unknown_file' WHEN e < b OR e > 160 + file_id % 40 THEN 'range' WHEN name = '' THEN 'name' WHEN twice THEN 'duplicate' END AS fault FROM y) WHERE fault IS NOT NULL"""


def draft_submission(spark, d):
    """Drafts of orders' lines: equal claims once a run, those in the ledger skipped, conflicting ones refused."""
    line = table(spark, d, "lineitem")
    drafts = line.select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("draft_id"), F.col("l_partkey").alias("p"))
    keyed = em.keyed_drafts(drafts, F.concat_ws("|", F.col("p").cast("string"), F.lit("v1"))).withColumn("key", F.concat_ws(":", "run", "p"))
    ledger = keyed.filter("draft_id % 4 = 0").select("key", F.when(F.col("draft_id") % 8 == 0, F.lit("other")).otherwise(F.col("claim")).alias("claim"))
    fresh, conflict = em.submit(keyed, ledger)
    return fresh.select("draft_id", "batch", F.lit("sent").alias("outcome")).unionByName(conflict.select("draft_id", F.lit(None).cast("long").alias("batch"), F.lit("conflict").alias("outcome")))


SUBMISSION_SQL = """WITH k AS (SELECT l_suppkey AS run, l_orderkey AS ord, l_orderkey * 10 + l_linenumber AS draft_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, draft_id) = 1)
SELECT draft_id, (row_number() OVER (PARTITION BY run ORDER BY ord, draft_id) - 1) // 500 AS batch, 'sent' AS outcome FROM k WHERE draft_id % 4 <> 0 UNION ALL SELECT draft_id, NULL, 'conflict' FROM k WHERE draft_id % 8 = 0"""


def file_supersessions(spark, d):
    """A brand is a commit; parts of even keys are removed, odd ones added; a path is the size, a blob the type; neighbours in key are similar."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_size").alias("path"), F.col("p_type").alias("blob"), F.col("p_partkey").alias("id"))
    removed = p.filter("id % 2 = 0").groupBy("scope", "path").agg(F.min_by("blob", "id").alias("blob"), F.min("id").alias("file_id"))
    added = p.filter("id % 2 = 1").groupBy("scope", "path").agg(F.min_by("blob", "id").alias("blob"))
    similar = added.select("scope", "path", (F.col("path") + 1).alias("old_path"), (F.col("path") % 10 / 10 + 0.05).alias("score"))
    return em.supersessions(removed, added, similar, "scope")


SUPERSESSIONS_SQL = """WITH r AS (SELECT p_brand AS scope, p_size AS path, arg_min(p_type, p_partkey) AS blob, min(p_partkey) AS old_id FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), a AS (SELECT p_brand AS scope, p_size AS path, arg_min(p_type, p_partkey) AS blob FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
u AS (SELECT scope, blob FROM (SELECT scope, blob, count(*) AS n FROM a GROUP BY ALL) JOIN (SELECT scope, blob, count(*) AS m FROM r GROUP BY ALL) USING (scope, blob) WHERE n = 1 AND m = 1),
mv AS (SELECT a.scope, a.path FROM a JOIN u USING (scope, blob) JOIN r USING (scope, blob) WHERE a.path <> r.path), nw AS (SELECT * FROM a WHERE (scope, path) NOT IN (SELECT (scope, path) FROM mv)),
c AS (SELECT nw.scope, nw.path, old_id, 0 AS rule, 'blob' AS basis, 0.5::DOUBLE AS confidence FROM nw JOIN r USING (scope, blob) UNION ALL SELECT nw.scope, nw.path, old_id, 1, 'similar', least(nw.path % 10 / 10 + 0.05::DOUBLE, 0.9) FROM nw JOIN r ON r.scope = nw.scope AND r.path = nw.path + 1
  UNION ALL SELECT nw.scope, nw.path, old_id, 2, 'path', 0.25 FROM nw JOIN r USING (scope, path))
SELECT scope, path, old_id, arg_max(basis, rule) AS basis, arg_max(confidence, rule) AS confidence FROM c GROUP BY ALL"""


def name_resolution(spark, d):
    """Uses of a part's name by the chain of its brand, and by the only top-level name of its directory."""
    p = table(spark, d, "part")
    owners = F.split(F.lower("p_brand"), "#")
    symbols = p.select((F.col("p_partkey") % 40).alias("file_id"), F.col("p_type").alias("name"), owners.alias("owners"), F.col("p_partkey").alias("symbol_id"))
    uses = p.select(F.col("p_partkey").alias("use_id"), (F.col("p_partkey") % 40).alias("file_id"), F.col("p_type").alias("name"), owners.alias("chain"))
    chain = em.owner_chain(uses, symbols).withColumn("by", F.lit("chain"))
    tops = p.select((F.col("p_partkey") % 60).alias("directory"), (F.col("p_size") > 40).alias("is_test"), F.col("p_type").alias("name"), F.col("p_partkey").alias("symbol_id"))
    asked = p.select(F.col("p_partkey").alias("use_id"), ((F.col("p_partkey") + 1) % 60).alias("directory"), F.lit(False).alias("is_test"), F.col("p_type").alias("name"))
    return chain.unionByName(em.package_lookup(asked, tops).withColumn("by", F.lit("package")))


RESOLUTION_SQL = """WITH s AS (SELECT p_partkey % 40 AS f, p_type AS name, p_brand AS b, min(p_partkey) AS symbol_id, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_partkey % 60 AS dir, p_type AS name, min(p_partkey) AS symbol_id, count(*) AS n FROM part WHERE p_size <= 40 GROUP BY ALL)
SELECT p_partkey AS use_id, symbol_id, 'chain' AS "by" FROM part JOIN s ON f = p_partkey % 40 AND name = p_type AND b = p_brand WHERE n = 1 UNION ALL SELECT p_partkey, symbol_id, 'package' FROM part JOIN t ON dir = (p_partkey + 1) % 60 AND name = p_type WHERE n = 1"""


def configuration_digests(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("version"))
    return em.configuration_digest(line, "run")


CONFIGURATION_SQL = "SELECT l_orderkey AS run, sha256(array_to_string(list_sort(list(DISTINCT l_returnflag || '@' || l_linestatus)), ';')) AS configuration FROM lineitem GROUP BY 1"


def file_lineage(spark, d):
    """A customer is a repository, its orders are commits, their lines changes of eight paths: the first to name a path adds it, every fourth line deletes."""
    o = table(spark, d, "orders")
    line = table(spark, d, "lineitem")
    n, by_order = parts(o, line), parts(o, line, each=4 * PART_BYTES)
    path = F.concat(F.lit("p"), (F.col("l_partkey") % 8).cast("string"))
    orders = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("repository"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at")).repartition(by_order, "o_orderkey")
    changed = line.select(F.col("l_orderkey").alias("order"), (F.col("l_partkey") % 8).alias("l_partkey"), "l_suppkey").repartition(by_order, "order").join(orders, F.col("order") == F.col("o_orderkey"))
    one = changed.repartition(n, "repository").groupBy("repository", "at", "order", path.alias("path")).agg(F.min("l_suppkey").alias("s"))
    status = F.when(F.col("s") % 4 == 0, "D").when(F.col("s") % 4 == 1, "A").otherwise("M")
    from pyspark.sql import Window

    seq = F.dense_rank().over(Window.partitionBy("repository").orderBy("at", "order")).cast("long")
    return lineage.walk(one.select("repository", seq.alias("seq"), F.col("order").cast("string").alias("commit"), status.alias("status"), "path", (F.col("s") % 6).cast("string").alias("blob")))


QUERIES = {f.__name__: f for f in (enclosing_symbols, index_symbol_matches, relation_claims, reference_sites, dependency_claims, coverage_reports, file_admission, symbol_validation, draft_submission, file_supersessions, name_resolution, configuration_digests, file_lineage)}
ORACLE_SQL = {
    "enclosing_symbols": ENCLOSING_SQL, "index_symbol_matches": MATCHES_SQL, "relation_claims": RELATIONS_SQL, "reference_sites": SITES_SQL, "dependency_claims": DEPENDENCY_SQL, "coverage_reports": COVERAGE_SQL, "file_admission": ADMISSION_SQL, "symbol_validation": VALIDATION_SQL,
    "draft_submission": SUBMISSION_SQL, "file_supersessions": SUPERSESSIONS_SQL, "name_resolution": RESOLUTION_SQL, "configuration_digests": CONFIGURATION_SQL,
}
