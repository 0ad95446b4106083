"""Interval algebra over run facts: timelines, as-of reads, clips, windows, diffs and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_intervals(facts: DataFrame, entity: list[str], order: list[str], time: str, status: str, key: str) -> DataFrame:
    """Half-open intervals from a present / absent / unknown timeline.

    Unknown leaves the state as it was; absent closes; a present row with another key closes and opens.  The last interval is open
    (null end).
    """
    w = Window.partitionBy(*entity).orderBy(*order)
    known = facts.filter(F.col(status) != "unknown").withColumn("_k", F.when(F.col(status) == "present", F.col(key)))
    starts = known.withColumn("_p", F.lag(F.struct("_k")).over(w)).filter(F.col("_p").isNull() | ~F.col("_p._k").eqNullSafe(F.col("_k")))
    ends = starts.withColumn("valid_to", F.lead(time).over(w)).filter("_k is not null")
    return ends.select(*entity, F.col("_k").alias("key"), F.col(time).alias("valid_from"), "valid_to").filter("valid_to is null or valid_from < valid_to")


def as_of(intervals: DataFrame, points: DataFrame, point: str = "t", known: str | None = None) -> DataFrame:
    """Intervals that hold at each point (start <= t < end); points are a small side, sent to every task behind Spark's own size check.

    With ``known``, a column of the points, also on the recorded axis: recorded_from <= known < recorded_to, open where that is null.
    """
    on = (F.col("valid_from") <= F.col(point)) & (F.col("valid_to").isNull() | (F.col(point) < F.col("valid_to")))
    if known is not None:
        on &= (F.col("recorded_from") <= F.col(known)) & (F.col("recorded_to").isNull() | (F.col(known) < F.col("recorded_to")))
    return intervals.join(points, on)


def clip(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Intersect with [low, high); a null high is open; empty intersections go."""
    out = intervals.withColumn("valid_from", F.greatest("valid_from", low)).withColumn("valid_to", F.least("valid_to", high))
    return out.filter("valid_to is null or valid_from < valid_to")


def run_windows(runs: DataFrame, scope: str, time: str, run: str) -> DataFrame:
    """[start, next strictly later start of the scope); the latest is open."""
    starts = runs.select(scope, time).distinct()
    until = F.lead(time).over(Window.partitionBy(scope).orderBy(time))
    return runs.join(starts.withColumn("window_end", until), [scope, time]).select(scope, run, F.col(time).alias("window_start"), "window_end")


def pick_run(runs: DataFrame, scope: str, complete: str, order: list[str], run: str) -> DataFrame:
    """The last complete run of the scope, else its last run."""
    return runs.groupBy(scope).agg(F.max_by(F.struct(run, complete), F.struct(F.col(complete).cast("int"), *order)).alias("p")).select(scope, f"p.{run}", f"p.{complete}")


def run_diff(members: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer difference of two member sets: added, removed, modified."""
    a, b = members.alias("a"), before.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    change = F.when(F.col(f"b.{value}").isNull(), "added").when(F.col(f"a.{value}").isNull(), "removed").when(F.col(f"a.{value}") != F.col(f"b.{value}"), "modified")
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], change.alias("change")).filter("change is not null")


def evidence_winner(assertions: DataFrame, triple: list[str], rank: Column, confidence: str, ident: str) -> DataFrame:
    """Per triple: highest rank, then confidence, then smallest id; and the number of losers, which ``evidence_losers`` lists."""
    ranked = assertions.withColumn("_r", rank)
    best = F.min_by(F.struct(ident, "_r", confidence), F.struct(-F.col("_r"), -F.col(confidence), F.col(ident)))
    return ranked.groupBy(*triple).agg(best.alias("b"), F.count("*").alias("n")).select(
        *triple, F.col(f"b.{ident}").alias("winner"), F.col("b._r").cast("long").alias("rank"), F.col(f"b.{confidence}").alias("confidence"), (F.col("n") - 1).alias("n_lower")
    )


def evidence_losers(assertions: DataFrame, winners: DataFrame, triple: list[str], ident: str) -> DataFrame:
    """The assertions that lost their triple, a row each: the triple, its winner, loser.  However many there are, no list of them is built."""
    return assertions.select(*triple, F.col(ident).alias("loser")).join(winners.select(*triple, "winner"), triple).filter("loser <> winner")


def next_pass(runs: DataFrame, target: list[str], order: list[str], failed: str, passed: str, ident: str) -> DataFrame:
    """Each failing run with the earliest later pass of its target (strict on the order key), else null.

    Read backwards, so the frame only grows and each row costs the same however many runs a target has.
    """
    ahead = Window.partitionBy(*target).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    fix = F.last(F.when(F.col(passed), F.col(ident)), ignorenulls=True).over(ahead)
    return runs.withColumn("fixed_by", fix).filter(failed)
