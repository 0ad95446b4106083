"""Symbol and assertion timelines, the recorded axis and revision views over the driver's tables, with their SQL.

Orders are runs of a customer's repository, lines its files (part modulo 8) with the supplier as revision.  An order of status P never completed, every fourth of
status O did with an incomplete scan.  Lines returned R also cover the next file; a file with a line returned A is covered incompletely.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import bitemporal as bt
from chronofold.operators import timelines as tl
from chronofold.sources.scratch import PART_BYTES, bucketed, folded, parts
from chronofold.sources.tables import table

KNOWN, VIEW = "1996-06-01 00:00:00", "1997-01-01 00:00:00"


def _facts(spark, d, known=None):
    """(runs, lines, number of buckets) of the facts observed by ``known``, each written once in buckets of its scopes; an order's are up to 60 days after its date."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    n, by_run = parts(o, line), parts(o, line, each=4 * PART_BYTES)
    k = F.col("o_orderkey")
    o = o.withColumn("observed", F.col("o_orderdate") + F.make_dt_interval(days=(k % 4 * 20).cast("int")))
    if known is not None:
        o = o.filter(F.col("observed") <= F.lit(known).cast("timestamp_ntz"))
    outcomes = o.filter("o_orderstatus <> 'P'").select(k.alias("run"), F.col("observed").alias("event_order"), F.when((F.col("o_orderstatus") == "O") & (k % 4 == 0), "scan_incomplete").alias("error_class"))
    runs = bucketed(tl.permissions(o.select(F.col("o_custkey").alias("scope"), k.alias("run"), F.col("o_orderdate").alias("at")), outcomes), "scope", n)
    lines = line.select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 8).alias("file_id"), F.col("l_suppkey").alias("revision"), "l_returnflag").repartition(by_run, "run")
    return runs, bucketed(lines.join(runs.select("scope", "run", "at").repartition(by_run, "run"), "run"), "scope", n), n


def _seen(lines):
    own = F.struct("file_id", "revision", (F.col("l_returnflag") != "A").alias("complete"))
    beside = F.struct(((F.col("file_id") + 1) % 8).alias("file_id"), F.lit(None).cast(dict(lines.dtypes)["revision"]).alias("revision"), F.lit(True).alias("complete"))
    return tl.sightings(lines.select("scope", "run", F.inline(F.array_compact(F.array(own, F.when(F.col("l_returnflag") == "R", beside))))))


def _claims(lines, kinds, key):
    shown = lines.groupBy("scope", "file_id", "revision").agg(F.min("at").alias("since"))
    return shown.select("*", (F.col("file_id") * 10 + F.col("revision") % kinds).alias("item"), key.alias("key"))


def _fold(runs, items):
    return bt.status_intervals(tl.with_absences(runs, items), ["scope", "item"], ["at", "run"], "at", "status", "key")


def covered_file_intervals(spark, d):
    """Files whose absence coverage forbids to infer."""
    runs, lines, _ = _facts(spark, d)
    return folded(_fold(runs, tl.file_items(_seen(lines))))


def _items(runs, lines, n, kinds, key):
    """Items of the claims, written once: what a task holds is one step of a timeline, and symbols serve two."""
    return bucketed(tl.item_items(runs, _seen(lines), _claims(lines, kinds, key)), "scope", n, dealt=True)


def _symbol_items(runs, lines, n):
    return _items(runs, lines, n, 3, F.col("revision"))


def symbol_intervals(spark, d, known=None):
    runs, lines, n = _facts(spark, d, known)
    return folded(_fold(runs, _symbol_items(runs, lines, n)))


def _assertion_intervals(runs, lines, n, symbol_items):
    key = F.lit(1).cast("long")
    targets = _claims(lines, 2, key).select("scope", "item", ((F.floor(F.col("item") / 10) + 1) % 8 * 10 + F.col("item") % 2).alias("target")).distinct()
    items = bucketed(tl.with_target(runs, _items(runs, lines, n, 2, key), targets, symbol_items), "scope", n, dealt=True)
    end = F.when(F.col("item") % 10 == 1, F.lit(VIEW).cast("timestamp_ntz"))
    return bt.clip(_fold(runs, items), F.lit("1900-01-01").cast("timestamp_ntz"), end)


def assertion_intervals(spark, d):
    """Clipped to declared ends: an assertion of item 1, 11, ... ends with 1997."""
    runs, lines, n = _facts(spark, d)
    return folded(_assertion_intervals(runs, lines, n, _symbol_items(runs, lines, n)))


def item_currency(spark, d):
    """Current symbols have an open last interval, current assertions one that holds at the newest run."""
    runs, lines, n = _facts(spark, d)
    symbol_items = _symbol_items(runs, lines, n)
    s = tl.horizon(runs, _fold(runs, symbol_items), False).withColumn("kind", F.lit("symbol"))
    a = tl.horizon(runs, _assertion_intervals(runs, lines, n, symbol_items), True).withColumn("kind", F.lit("assertion"))
    return folded(s).unionByName(folded(a))


def symbols_as_known(spark, d):
    """Symbols valid at the view's time by what was known at an earlier one: intervals of the facts recorded by then, not a filter of the final ones."""
    points = spark.range(1).select(F.lit(VIEW).cast("timestamp_ntz").alias("t"))
    return bt.as_of(symbol_intervals(spark, d, KNOWN), F.broadcast(points)).select("scope", "item", "key")  # one row


def symbol_history(spark, d):
    return tl.history(symbol_intervals(spark, d), F.lit(VIEW).cast("timestamp_ntz"), 3).select("scope", "item", "key", "valid_from", "valid_to", "place")


def revision_symbols(spark, d):
    """Symbols of each customer's picked run: the last complete one, else the last."""
    runs, lines, n = _facts(spark, d)
    picked = bt.pick_run(runs, "scope", "permits", ["at", "run"], "run").join(runs, ["scope", "run"])
    return folded(tl.revision_view(picked.select("scope", "run", "at"), _fold(runs, _symbol_items(runs, lines, n))))


def revision_files(spark, d):
    runs, lines, _ = _facts(spark, d)
    return folded(tl.members_at(bt.pick_run(runs, "scope", "permits", ["at", "run"], "run"), lines))


def _sql(known=None):
    cut = f"WHERE o_orderdate + to_days(CAST(o_orderkey % 4 * 20 AS INTEGER)) <= TIMESTAMP '{known}'" if known else ""
    return f"""runs AS (SELECT o_custkey AS scope, o_orderkey AS run, o_orderdate AS "at", o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 4 <> 0) AS permits FROM orders {cut}),
ln AS (SELECT scope, run, "at", l_partkey % 8 AS file_id, l_suppkey AS revision, l_returnflag FROM lineitem JOIN runs ON run = l_orderkey),
mem AS (SELECT scope, run, file_id, min(revision) AS member FROM ln GROUP BY ALL),
cov AS (SELECT scope, run, file_id, bool_and(c) AS complete FROM (SELECT scope, run, file_id, l_returnflag <> 'A' AS c FROM ln UNION ALL SELECT scope, run, (file_id + 1) % 8, true FROM ln WHERE l_returnflag = 'R') GROUP BY ALL),
shown AS (SELECT scope, file_id, revision, min("at") AS since FROM ln GROUP BY ALL),
cl(kind, scope, file_id, revision, since, item, key) AS (SELECT 'symbol', scope, file_id, revision, since, file_id * 10 + revision % 3, revision FROM shown UNION ALL SELECT 'assertion', scope, file_id, revision, since, file_id * 10 + revision % 2, 1 FROM shown),
its AS (SELECT DISTINCT kind, scope, item FROM cl),
own AS (SELECT r.scope, r.run, cl.kind, cl.item, min(cl.key) FILTER (m.member = cl.revision AND cl.since <= r."at") AS key,
  coalesce(bool_or(CASE WHEN m.member IS NOT NULL THEN NOT coalesce(c.complete, true) ELSE c.complete IS NOT NULL END), false) AS hidden FROM runs r JOIN cl USING (scope) LEFT JOIN mem m ON m.run = r.run AND m.file_id = cl.file_id LEFT JOIN cov c ON c.run = r.run AND c.file_id = cl.file_id GROUP BY ALL),
st AS (SELECT o.*, r."at", CASE WHEN key IS NOT NULL THEN 'present' WHEN NOT permits OR hidden THEN 'unknown' ELSE 'absent' END AS status FROM own o JOIN runs r USING (scope, run)),
fs AS (SELECT r.scope, r.run, 'file' AS kind, f.file_id AS item, m.member AS key, r."at", CASE WHEN m.member IS NOT NULL THEN 'present' WHEN c.file_id IS NOT NULL OR NOT permits THEN 'unknown' ELSE 'absent' END AS status
  FROM runs r JOIN (SELECT DISTINCT scope, file_id FROM mem) f USING (scope) LEFT JOIN mem m ON m.run = r.run AND m.file_id = f.file_id LEFT JOIN cov c ON c.run = r.run AND c.file_id = f.file_id),
tg AS (SELECT a.scope, a.run, a.kind, a.item, a.key, a."at", CASE WHEN a.status <> 'present' THEN a.status ELSE coalesce(t.status, CASE WHEN r.permits THEN 'absent' ELSE 'unknown' END) END AS status FROM st a JOIN runs r USING (scope, run)
  LEFT JOIN st t ON t.kind = 'symbol' AND t.run = a.run AND t.item = (a.item // 10 + 1) % 8 * 10 + a.item % 2 WHERE a.kind = 'assertion'),
al AS (SELECT scope, run, kind, item, "at", CASE WHEN status = 'present' THEN key END AS key FROM (SELECT * EXCLUDE (hidden) FROM st WHERE kind = 'symbol' UNION ALL BY NAME FROM fs UNION ALL BY NAME FROM tg) WHERE status <> 'unknown'),
ch AS (SELECT *, lag(key) OVER w AS prev, row_number() OVER w AS rn FROM al WINDOW w AS (PARTITION BY kind, scope, item ORDER BY "at", run)),
iv AS (SELECT * FROM (SELECT kind, scope, item, key, "at" AS valid_from, lead("at") OVER (PARTITION BY kind, scope, item ORDER BY "at", run) AS valid_to FROM ch WHERE rn = 1 OR prev IS DISTINCT FROM key) WHERE key IS NOT NULL AND (valid_to IS NULL OR valid_from < valid_to)),
ai AS (SELECT scope, item, key, valid_from, least(valid_to, CASE WHEN item % 10 = 1 THEN TIMESTAMP '{VIEW}' END) AS valid_to FROM iv WHERE kind = 'assertion'),
ac AS (SELECT * FROM ai WHERE valid_to IS NULL OR valid_from < valid_to),
pick AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY scope ORDER BY permits DESC, "at" DESC, run DESC) = 1)"""


T = _sql()
QUERIES = {f.__name__: f for f in (covered_file_intervals, symbol_intervals, assertion_intervals, item_currency, symbols_as_known, symbol_history, revision_symbols, revision_files)}
ORACLE_SQL = {
    "covered_file_intervals": f"WITH {T} SELECT scope, item, key, valid_from, valid_to FROM iv WHERE kind = 'file'",
    "symbol_intervals": f"WITH {T} SELECT scope, item, key, valid_from, valid_to FROM iv WHERE kind = 'symbol'",
    "assertion_intervals": f"WITH {T} SELECT scope, item, key, valid_from, valid_to FROM ac",
    "item_currency": f"""WITH {T}, tp AS (SELECT scope, max("at") AS top FROM runs GROUP BY 1), ls AS (SELECT scope, item, arg_max({{'t': valid_to}}, valid_from).t IS NULL AS current, 'symbol' AS kind FROM iv WHERE kind = 'symbol' GROUP BY ALL),
la AS (SELECT scope, item, max(valid_from) AS f, arg_max({{'t': valid_to}}, valid_from).t AS t FROM ac GROUP BY ALL) SELECT * FROM ls UNION ALL SELECT scope, item, f <= top AND (t IS NULL OR top < t), 'assertion' FROM la JOIN tp USING (scope)""",
    "symbols_as_known": f"WITH {_sql(KNOWN)} SELECT scope, item, key FROM iv WHERE kind = 'symbol' AND valid_from <= TIMESTAMP '{VIEW}' AND (valid_to IS NULL OR TIMESTAMP '{VIEW}' < valid_to)",
    "symbol_history": f"""WITH {T} SELECT * FROM (SELECT scope, item, key, valid_from, CASE WHEN valid_to <= TIMESTAMP '{VIEW}' THEN valid_to END AS valid_to, row_number() OVER (PARTITION BY scope, item ORDER BY valid_from DESC) AS place FROM iv
WHERE kind = 'symbol' AND valid_from <= TIMESTAMP '{VIEW}') WHERE place <= 3""",
    "revision_symbols": f"""WITH {T} SELECT scope, run, item, key FROM pick JOIN iv USING (scope) WHERE kind = 'symbol' AND valid_from <= "at" AND (valid_to IS NULL OR "at" < valid_to)""",
    "revision_files": f"WITH {T} SELECT scope, run, file_id, member AS revision FROM mem JOIN pick USING (scope, run)",
}
