"""Identities, offsets, remotes and keyed digests over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import identities as ids
from chronofold.sources.tables import ledger, table

ROOT = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
KEY = b"a key of the tests that is longer than sixty-four bytes, so that it is hashed first"


def _files(spark, d):
    p = table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    return p.select(
        "p_partkey", F.concat(F.lit("r"), (F.col("p_partkey") % 5).cast("string")).alias("repo"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/m"), text("p_size"), F.lit(".py")).alias("path"),
        F.sha1(text("p_partkey")).alias("oid"), F.sha2(F.col("p_type"), 256).alias("parser"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("scip py pkg "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("local "), text("p_size"))).alias("scip"), F.col("p_name").alias("name"),
    )


def code_identities(spark, d):
    i = ids.Ids(ROOT)
    f, repo = _files(spark, d), F.col("repo")
    f = f.withColumns({"file": i.file(repo, F.col("path"), F.col("oid")), "loose": i.uncommitted(repo, F.col("path")), "draft": i.provisional(repo, F.lit("co1"), F.col("path"))})
    f = f.withColumn("revision", i.revision(repo, F.col("file"), F.col("oid"), F.lit("python"), F.col("parser")))
    f = f.withColumn("symbol", i.symbol(repo, F.col("scip"), F.lit("python"), F.col("file"), F.col("name"), F.lit("class"), F.lit("0")))
    f = f.withColumns({"symbol_revision": i.symbol_revision(repo, F.col("symbol"), F.col("parser"), F.col("parser")), "assertion": ids.assertion_id("relation", F.col("symbol"), F.lit("CALLS"), F.col("file"))})
    return f.select("p_partkey", "file", "loose", "draft", "revision", "symbol", "symbol_revision", "assertion", ids.keyed_event_id("ours\n", F.col("assertion")).alias("event"))


def _fr(*parts):
    return " || ".join(f"strlen({p}) || ':' || {p}" for p in parts)


def _u5(ns, name):
    h = f"sha1(unhex(replace({ns}, '-', '')) || encode({name}))"
    return f"list_transform([{h}], lambda h: h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32])[1]"


CODE_SQL = f"""WITH p AS (SELECT p_partkey, 'r' || (p_partkey % 5) AS repo, 'src/' || lower(replace(p_brand, '#', '_')) || '/m' || p_size || '.py' AS path, sha1(CAST(p_partkey AS VARCHAR)) AS oid, sha256(p_type) AS parser,
  CASE p_partkey % 3 WHEN 0 THEN 'scip py pkg ' || p_name WHEN 1 THEN 'local ' || p_size END AS scip, p_name AS name FROM part),
r AS (SELECT *, {_u5(f"'{ROOT}'", _fr("'repository'", "repo"))} AS ns FROM p),
f AS (SELECT *, {_u5("ns", _fr("'file'", "path", "oid"))} AS file, {_u5(_u5("ns", _fr("'namespace'", "'uncommitted'")), _fr("path"))} AS loose, {_u5(_u5("ns", _fr("'namespace'", "'provisional'")), _fr("'co1'", "path"))} AS draft FROM r),
v AS (SELECT *, {_u5("ns", _fr("'file_revision'", "file", "oid", "'python'", "parser"))} AS revision, CASE WHEN p_partkey % 3 = 0 THEN {_u5("ns", _fr("'symbol_scip'", "scip"))} ELSE {_u5("ns", _fr("'symbol_fallback'", "'python'", "file", "name", "'class'", "'0'"))} END AS symbol FROM f),
s AS (SELECT *, {_u5("ns", _fr("'symbol_revision'", "symbol", "parser", "parser"))} AS symbol_revision, 'as-relation-' || sha256({_fr("'relation'", "symbol", "'CALLS'", "file")})[1:48] AS assertion FROM v)
SELECT p_partkey, file, loose, draft, revision, symbol, symbol_revision, assertion, list_transform([sha256('ours' || chr(10) || assertion)], lambda h: h[1:8] || '-' || h[9:12] || '-7' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32])[1] AS event FROM s"""


def event_keys(spark, d):
    ev = ledger(spark, d)
    e = F.col("event_id").cast("string")
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), e))
    digest = F.sha2(e, 256)
    key = F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), F.when(F.col("event_id") % 5 == 0, F.lit("zz")).otherwise(F.substring(digest, 3, 2)), F.lit("/"), digest, F.lit(".zst"))
    return ev.select(
        "event_id", ids.order_key(F.col("occurred_at"), e).alias("order_key"), ids.resource_uri("ledger://", e, content).alias("uri"), ids.lock_number(digest).alias("lock"), ids.digest_of_key(key).alias("digest"),
        ids.idempotency_key(KEY, "src", F.col("event_type"), F.col("stream_id"), ids.fixed_time(F.col("occurred_at")), F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}"))).alias("idempotency"), ids.opaque("d:", F.col("event_type"), e).alias("opaque"),
    )


def _pads():
    import hashlib

    block = hashlib.sha256(KEY).digest().ljust(64, b"\0")
    return [bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C)]


EVENT_SQL = f"""WITH e AS (SELECT event_id, event_type, 'u' || user_id AS stream_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(CAST(event_id AS VARCHAR)) AS g FROM events)
SELECT event_id, t || '|' || event_id AS order_key, 'ledger://events/' || event_id || CASE WHEN event_id % 2 = 0 THEN '/contents/' || sha256('c' || event_id) ELSE '' END AS uri,
  CASE WHEN ('0x' || g[1:8])::BIGINT >= 2147483648 THEN ('0x' || g[1:8])::BIGINT - 4294967296 ELSE ('0x' || g[1:8])::BIGINT END AS lock, CASE WHEN event_id % 5 <> 0 THEN g END AS digest,
  'src:' || event_type || ':' || stream_id || ':' || t || ':' || sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || encode('{{"k":' || k || '}}')))) AS idempotency, sha256('d:' || event_type || event_id) AS opaque FROM e"""


def column_offsets(spark, d):
    """A column of each document's first line, counted in each encoding; every fifth line is made of two-, three- and four-byte characters."""
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("aé日🙂b"), F.substring_index("text", "\n", 1))).otherwise(F.substring_index("text", "\n", 1))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", line.alias("line"), (F.col("doc_id") % 13).alias("at"))
    each = docs.withColumn("encoding", F.explode(F.array(*[F.lit(x) for x in ("utf-8", "utf-16", "utf-32", "none", "other")]))).withColumn("encoding", F.when(F.col("encoding") != "none", F.col("encoding")))
    return each.select("doc_id", "encoding", ids.byte_offset(F.col("line"), F.col("at"), F.col("encoding")).alias("offset"))


OFFSETS_SQL = """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'aé日🙂b' ELSE '' END || string_split(text, chr(10))[1] AS line, doc_id % 13 AS c FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, list_transform(string_split(line[1:14], ''), lambda x: strlen(x)) AS b FROM l WHERE line <> '' UNION ALL SELECT *, []::BIGINT[] FROM l WHERE line = ''),
w AS (SELECT *, list_transform(range(0, len(b) + 1), lambda i: coalesce(list_sum(b[1:i]), 0)) AS by8, list_transform(range(0, len(b) + 1), lambda i: coalesce(list_sum(list_transform(b[1:i], lambda x: CASE WHEN x = 4 THEN 2 ELSE 1 END)), 0)) AS by16 FROM u),
x AS (SELECT *, strlen(line) = length(line) AS a FROM w), e(encoding) AS (VALUES ('utf-8'), ('utf-16'), ('utf-32'), (NULL), ('other'))
SELECT doc_id, encoding, CAST(CASE WHEN a AND coalesce(encoding, '') <> 'other' THEN CASE WHEN c <= strlen(line) THEN c END WHEN encoding = 'utf-8' THEN CASE WHEN list_contains(by8, c) OR c > by8[-1] AND c <= strlen(line) THEN c END
  WHEN encoding = 'utf-16' THEN by8[list_position(by16, c)] WHEN encoding = 'utf-32' THEN by8[c + 1] END AS BIGINT) AS "offset" FROM x, e"""


def module_names(spark, d):
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 6
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    path = F.when(kind == 0, F.concat(F.lit("src/"), brand, F.lit("/__init__.py"))).when(kind == 1, F.concat(F.lit("my-lib/"), brand, F.lit("/a.py"))).when(kind == 2, F.concat(brand, F.lit("/index.ts"))).when(kind == 3, F.lit("2024/módulo.py")).when(kind == 4, F.concat(F.lit("top"), F.lit(".x.py"))).otherwise(F.concat(F.lit("a/b/"), brand))
    scip = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("npm x src/"), brand, F.lit("/f()."))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("pip x "), brand, F.lit("."))).when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("py z_"), brand, F.lit("x")))
    f = p.select("p_partkey", path.alias("path"), scip.alias("scip"))
    return f.select("p_partkey", ids.module_name(F.col("path")).alias("module"), F.array_join(F.array_sort(ids.descriptors(F.col("path"))), ",").alias("descriptors"), ids.path_bound(F.col("scip"), F.col("path")).alias("bound"))


MODULE_SQL = r"""WITH p AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS b FROM part), f AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'src.' || b WHEN 1 THEN b || '.a' WHEN 2 THEN b || '.index' WHEN 3 THEN 'módulo' WHEN 4 THEN '' ELSE 'a.b.' || b END AS module,
  CASE p_partkey % 6 WHEN 0 THEN ['src.' || b, 'src/' || b || '/__init__'] WHEN 1 THEN [b || '.a', 'my-lib/' || b || '/a'] WHEN 2 THEN [b, b || '.index', b || '/index'] WHEN 3 THEN ['2024/módulo', 'módulo'] WHEN 4 THEN ['top.x'] ELSE ['a.b.' || b, 'a/b/' || b] END AS ds,
  CASE p_partkey % 4 WHEN 1 THEN 'npm x src/' || b || '/f().' WHEN 2 THEN 'pip x ' || b || '.' WHEN 3 THEN 'py z_' || b || 'x' END AS scip FROM p)
SELECT p_partkey, module, array_to_string(list_sort(ds), ',') AS descriptors, CASE WHEN scip IS NULL THEN true ELSE len(list_filter(ds, lambda x: regexp_matches(scip, '(^|[^A-Za-z0-9_])' || regexp_escape(x) || '([^A-Za-z0-9_]|$)'))) > 0 END AS bound FROM f"""

REMOTES = [
    "https://Git.Example.COM./{o}/{p}.git", "ssh://git@h.example:22/{o}/sub/{p}/", "git@h.example:{o}/{p}.GIT", "https://h.example:8443/{o}/a%2db%c3%a9{p}", "https://user@h.example/{o}/{p}", "https://h.example/{o}/{p}?x=1",
    "ftp://h.example/{o}/{p}", "https://h.example/{o}/a%2F{p}", "https://-bad.example/{o}/{p}", "h.example:{p}", "ssh://h.example/{o}/../{p}",
]
WANT = [("git.example.com", "{o}", "{p}"), ("h.example", "{o}", "sub/{p}"), ("h.example", "{o}", "{p}"), ("h.example:8443", "{o}", "a-b%C3%A9{p}")]


def remotes(spark, d):
    s = table(spark, d, "customer")
    owner, path = F.concat(F.lit("o"), F.col("c_nationkey").cast("string")), F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    form = F.array(*[F.lit(x) for x in REMOTES])[(F.col("c_custkey") % len(REMOTES)).cast("int")]
    r = ids.remote(F.replace(F.replace(form, F.lit("{o}"), owner), F.lit("{p}"), path))
    return s.select("c_custkey", r.alias("r")).select("c_custkey", "r.host", "r.owner", "r.path")


def _want(i):
    cases = " ".join(f"WHEN {k} THEN '{w[i]}'" for k, w in enumerate(WANT))
    return f"replace(replace(CASE c_custkey % {len(REMOTES)} {cases} END, '{{o}}', 'o' || c_nationkey), '{{p}}', 'p' || c_custkey)"


REMOTES_SQL = f"SELECT c_custkey, {_want(0)} AS host, {_want(1)} AS owner, {_want(2)} AS path FROM customer"

QUERIES = {f.__name__: f for f in (code_identities, event_keys, column_offsets, module_names, remotes)}
ORACLE_SQL = {"code_identities": CODE_SQL, "event_keys": EVENT_SQL, "column_offsets": OFFSETS_SQL, "module_names": MODULE_SQL, "remotes": REMOTES_SQL}
