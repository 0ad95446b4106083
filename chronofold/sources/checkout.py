"""Listings of a version-controlled checkout as rows: the index (``ls-files -s -z``) and the status (porcelain v2, NUL-separated)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\0"


def safe_path(path: Column) -> Column:
    """Relative, without empty, dot or ``.git`` segments, and valid text."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.lower(p) == ".git"))
    return ~bad & ~F.contains(path, F.lit("�")) & ~F.contains(path, F.lit("\\"))


def index_listing(listings: DataFrame, scope: str, column: str) -> DataFrame:
    """One row per path: mode, oid, and state entry, conflicted (any stage but 0: no oid) or rejected (an unsafe path or record)."""
    record = F.explode(F.split(F.col(column), NUL))
    r = listings.select(scope, record.alias("r")).filter("r <> ''")
    part = lambda i: F.regexp_extract("r", r"^(\d{6}) ([0-9a-f]{40}|[0-9a-f]{64}) ([0-3])\t(?s:(.+))$", i)
    f = r.select(scope, part(1).alias("mode"), part(2).alias("oid"), part(3).alias("stage"), part(4).alias("path"), "r")
    f = f.withColumn("sound", (F.col("path") != "") & safe_path(F.col("path"))).withColumn("path", F.when(F.col("path") == "", F.col("r")).otherwise(F.col("path")))
    g = f.groupBy(scope, "path").agg(F.bool_and("sound").alias("sound"), F.max("stage").alias("stage"), F.min_by("mode", "stage").alias("mode"), F.min_by("oid", "stage").alias("oid"))
    clean = F.col("sound") & (F.col("stage") == "0")
    state = F.when(~F.col("sound"), "rejected").when(clean, "entry").otherwise("conflicted")
    return g.select(scope, "path", F.when(F.col("sound"), F.col("mode")).alias("mode"), F.when(clean, F.col("oid")).alias("oid"), state.alias("state"))


def parse_status(text: str) -> list[tuple[str, str | None, str | None, str]]:
    """(path, origin, codes, state); a rename record takes the next token as its origin.  Ignored entries and headers are skipped."""
    out, tokens = [], iter(text.split(NUL))
    for token in tokens:
        kind = token[:2]
        if kind == "1 " and len(p := token.split(" ", 8)) == 9:
            out.append((p[8], None, p[1], "changed"))
        elif kind == "2 " and len(p := token.split(" ", 9)) == 10:
            out.append((p[9], next(tokens, ""), p[1], "copied" if p[8][:1] == "C" else "renamed"))
        elif kind == "u " and len(p := token.split(" ", 10)) == 11:
            out.append((p[10], None, p[1], "unmerged"))
        elif kind == "? ":
            out.append((token[2:], None, None, "untracked_folder" if token.endswith("/") else "untracked"))
        elif token and kind not in ("! ", "# "):
            out.append((token, None, None, "malformed"))
    return out


def status_listing(listings: DataFrame, scope: str, column: str) -> DataFrame:
    """Rows of each listing as ``parse_status`` gives them; a null listing has none."""
    kind = dict(listings.select(scope).dtypes)[scope]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows = parse_status(text) if text is not None else []
                if rows:
                    own = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, pa.string()) for c in zip(*rows, strict=True)]], names=[scope, "path", "origin", "codes", "state"])

    return listings.select(scope, F.col(column).cast("string")).mapInArrow(run, f"{scope} {kind}, path string, origin string, codes string, state string")


def dirty_entries(index: DataFrame, seen: DataFrame, status: DataFrame, scope: str) -> DataFrame:
    """Paths whose observed blob is not the index's: dirty by status, or racing (status calls them clean), or missing.

    ``index``: scope, path, oid.  ``seen``: scope, path, blob.  ``status``: scope, path.
    """
    on = [scope, "path"]
    told = status.select(*on).distinct().withColumn("told", F.lit(True))
    j = index.select(*on, "oid").join(seen.select(*on, "blob"), on, "left").join(told, on, "left")
    reason = F.when(F.col("blob").isNull(), "missing").when(F.col("told"), "changed").otherwise("race")
    return j.filter(F.col("told") | ~F.col("oid").eqNullSafe(F.col("blob"))).select(*on, reason.alias("reason"))
