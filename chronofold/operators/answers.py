"""Answer packages: candidates merged and ranked in integer micro-units, cut to a page by budget, continued by signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CANDIDATES, BYTES_PER_TOKEN = 500, 4  # the documented caps of one answer
CANDIDATE = ["item_id", "kind", "priority", "tier", "exact_scope", "distance", "match", "recency", "body", "citations"]


class BudgetTooSmall(ValueError):
    """The first item does not fit, even without its excerpt."""


class CursorError(ValueError):
    """A cursor that cannot continue this query; ``reason`` is invalid, mismatch, expired or stale."""

    def __init__(self, reason: str):
        super().__init__(f"cursor {reason}")
        self.reason = reason


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per item: united citations, exact if any source was exact, the nearest distance, the best match, tier, priority and recency."""
    best = F.struct("priority", "tier", "match", "kind", "body")
    return candidates.groupBy("item_id").agg(
        F.max_by("kind", best).alias("kind"), F.max("priority").alias("priority"), F.max("tier").alias("tier"), F.bool_or("exact_scope").alias("exact_scope"),
        F.min("distance").alias("distance"), F.max("match").alias("match"), F.max("recency").alias("recency"), F.max_by("body", best).alias("body"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"),
    )


def micro_score(priority: Column, tier: Column, exact: Column, distance: Column, match: Column, recency: Column) -> Column:
    """Weighted sum in millionths, half to even; an unknown distance is no proximity, an unknown recency rank 0."""
    near = F.coalesce(20 / (1 + distance), F.lit(0.0))
    total = 100 * priority + 4 * tier + 6 * exact.cast("int") + near + 40 * match + 3 * F.coalesce(recency, F.lit(0.0))
    return F.bround(total * 1_000_000, 0).cast("long")


def time_ranks(times: DataFrame, slices: int = 1024) -> DataFrame:
    """(_t, rank_of): the place of each distinct time ``_t`` scaled to [0, 1]; a single time is 1.

    Times are dealt to ``slices`` equal spans; only the spans' counts are put in order together, so no window holds all times.
    """
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    ends = times.agg(F.min(micros).alias("low"), F.max(micros).alias("high"), F.count("*").alias("n"))  # one row
    dealt = times.crossJoin(F.broadcast(ends)).withColumn("slice", F.floor((micros - F.col("low")) / (F.col("high") - F.col("low") + 1) * slices))
    counts = dealt.groupBy("slice").agg(F.count("*").alias("own"))  # at most ``slices`` rows
    before = counts.select("slice", (F.sum("own").over(Window.orderBy("slice")) - F.col("own")).alias("before"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("_t")) + F.col("before")
    return dealt.join(F.broadcast(before), "slice").select("_t", F.when(F.col("n") == 1, 1.0).otherwise((place - 1) / (F.col("n") - 1)).alias("rank_of"))


def rank_candidates(merged: DataFrame, cap: int = MAX_CANDIDATES) -> DataFrame:
    """The best ``cap`` candidates with score and rank (1 first), ties by item_id; ``capped`` tells whether some were left out.

    Recency is the position among the distinct times of all candidates, scaled to [0, 1]; a single time counts 1.
    """
    scaled = time_ranks(merged.filter("recency is not null").select(F.col("recency").alias("_t")).distinct())
    scored = merged.join(scaled, merged.recency == scaled["_t"], "left").drop("_t")
    scored = scored.withColumn("score", micro_score(*[F.col(c) for c in ("priority", "tier", "exact_scope", "distance", "match", "rank_of")])).drop("rank_of")
    first = scored.orderBy(F.desc("score"), "item_id").limit(cap + 1)
    numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).cast("long"))  # at most cap + 1 rows
    return numbered.withColumn("capped", F.max("rank").over(Window.partitionBy(F.lit(1))) > cap).filter(F.col("rank") <= cap)


def page(ranked: DataFrame, start: int, max_items: int, max_bytes: int, max_tokens: int) -> DataFrame:
    """Ranks above ``start`` that fit: item sizes, separating commas and two brackets within the bytes and the tokens of four bytes.

    The page is contiguous.  The first item may lose its excerpt (``quoted`` false) to fit.  A page that is empty although ranks
    are left means that the budget is too small; ``require_page`` turns that into an exception.
    """
    room = min(max_bytes, max_tokens * BYTES_PER_TOKEN)
    rest = ranked.filter(F.col("rank") > start)
    bare = F.to_json(F.struct("item_id", "kind", "score", "citations"))
    full = F.to_json(F.struct("item_id", "kind", "score", "citations", "body"))
    place = F.row_number().over(Window.orderBy("rank"))
    sized = rest.withColumn("place", place).withColumn("quoted", ~((F.col("place") == 1) & (F.octet_length(full) + 2 > room)))
    sized = sized.withColumn("bytes", F.octet_length(F.when(F.col("quoted"), full).otherwise(bare)).cast("long"))
    running = F.sum("bytes").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("place") - 1 + 2
    return sized.withColumn("used", running.cast("long")).filter((F.col("used") <= room) & (F.col("place") <= max_items)).drop("place")


def package(ranked: DataFrame, start: int, max_items: int, max_bytes: int, max_tokens: int) -> DataFrame:
    """One row: the page's items as a JSON array in rank order, the position after it, whether more follow, and the warnings."""
    taken = page(ranked, start, max_items, max_bytes, max_tokens)
    item = F.struct("rank", F.to_json(F.struct("item_id", "kind", "score", "citations", F.when(F.col("quoted"), F.col("body")).alias("body"))).alias("item"))
    got = taken.agg(F.array_sort(F.collect_list(item)).alias("i"), F.max("rank").alias("position"))  # at most max_items rows
    total = ranked.agg(F.max("rank").alias("last"), F.bool_or("capped").alias("capped"))
    return got.crossJoin(total).select(
        F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]")).alias("items"), F.coalesce("position", F.lit(start)).alias("position"),
        (F.coalesce("position", F.lit(start)) < F.coalesce("last", F.lit(0))).alias("truncated"),
        F.when(F.col("capped"), F.array(F.lit("candidates_capped"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def require_page(packed: DataFrame, start: int):
    """The one row of ``package``; refuses a budget that cannot hold the first item."""
    row = packed.first()
    if row["truncated"] and row["position"] == start:
        raise BudgetTooSmall("the budget cannot hold the first item")
    return row


def query_digest(tool: str, principal: str, request: dict) -> str:
    """Identity of a query: every input but its cursor."""
    inputs = {k: v for k, v in request.items() if k != "cursor"}
    return hashlib.sha256(json.dumps([tool, principal, inputs], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Cursors:
    """Issues and reads page positions that are signed with one key and bound to query, snapshot and time."""

    def __init__(self, key: bytes, seconds: int = 900):
        if len(key) < 32 or seconds <= 0:
            raise ValueError("a cursor key has at least 32 bytes and a positive life")
        self.key, self.seconds = key, seconds

    def _tag(self, body: bytes) -> bytes:
        return hmac.new(self.key, b"page-cursor\0" + body, hashlib.sha256).digest()

    def issue(self, digest: str, position: int, snapshot: str, now: float | None = None) -> str:
        until = int(time.time() if now is None else now) + self.seconds
        body = json.dumps([digest, position, snapshot, until]).encode()
        return base64.urlsafe_b64encode(self._tag(body) + body).decode()

    def read(self, cursor: str, digest: str, snapshot: str, now: float | None = None) -> int:
        try:
            raw = base64.b64decode(cursor.encode("ascii"), b"-_", validate=True)
        except (ValueError, UnicodeEncodeError):
            raise CursorError("invalid") from None
        tag, body = raw[:32], raw[32:]
        if not hmac.compare_digest(tag, self._tag(body)):
            raise CursorError("invalid")
        own, position, seen, until = json.loads(body)
        if own != digest:
            raise CursorError("mismatch")
        if (time.time() if now is None else now) >= until:
            raise CursorError("expired")
        if seen != snapshot:
            raise CursorError("stale")
        return position
