"""Status timelines of files, symbols and assertions over the runs of a repository, without a table of all runs times all things.

runs        scope, run, at, permits (absence may be inferred); ordered by (at, run)
sightings   scope, run, file_id, member, complete: what a run's members and coverage say of a file
claims      scope, file_id, revision, item, key, since: a file revision that shows an item

A thing has rows only at the runs that say something of it (``items``).  Between two of them a run that permits absence makes it absent, and only the first
such run matters, so one row more at most is made for each item (``with_absences``).  Every join, group and window has the scope among its keys, so tables
that are bucketed by it (``scratch.bucketed``) are folded without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["at", "run"]
BLOCKING = ["scan_incomplete", "snapshot_incomplete"]  # fixed values: error classes that forbid to infer absence


def permissions(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``runs`` with ``permits``: the latest completion (run, event_order, error_class) of each is not of a blocking class; without one it forbids."""
    last = outcomes.groupBy("run").agg(F.max_by(F.struct("error_class"), "event_order").alias("o"))
    ok = F.col("o").isNotNull() & ~F.coalesce(F.col("o.error_class").isin(BLOCKING), F.lit(False))
    return runs.join(last, "run", "left").withColumn("permits", F.coalesce(ok, F.lit(False))).drop("o")


def numbered(runs: DataFrame) -> DataFrame:
    """``runs`` with their place ``n`` in the scope and the next run behind them that permits absence, ``gap`` (n, at, run), if any."""
    order = Window.partitionBy("scope").orderBy(*ORDER)
    placed = runs.withColumn("n", F.row_number().over(order))
    back = Window.partitionBy("scope").orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("gap", F.last(F.when(F.col("permits"), F.struct("n", "at", "run")), ignorenulls=True).over(back))


def sightings(marks: DataFrame) -> DataFrame:
    """What each run says of a file (scope, run, file_id, member, complete) from its members and coverage, which ``marks`` (scope, run, file_id, revision, complete) holds in one frame.

    A member is the smallest revision and null where only coverage tells of the file; ``complete`` is null without coverage.
    """
    return marks.groupBy("scope", "run", "file_id").agg(F.min("revision").alias("member"), F.min("complete").alias("complete"))


def file_items(seen: DataFrame) -> DataFrame:
    """(scope, run, item, status, key) of sightings: present with the member, unknown where only coverage tells of a file."""
    return seen.select("scope", "run", F.col("file_id").alias("item"), F.when(F.col("member").isNotNull(), "present").otherwise("unknown").alias("status"), F.col("member").alias("key"))


def item_items(runs: DataFrame, seen: DataFrame, claims: DataFrame) -> DataFrame:
    """The same for things that file revisions claim: present with the smallest key of a live claim (the run's member of the file is the claiming revision, claimed by then).

    Otherwise unknown where the run forbids absence, a member's coverage is not complete, or a file is covered but no member; else absent.
    """
    owned = seen.join(runs.select("scope", "run", "at", "permits"), ["scope", "run"]).join(claims, ["scope", "file_id"])
    live = F.coalesce((F.col("member") == F.col("revision")) & (F.col("since") <= F.col("at")), F.lit(False))
    hidden = F.when(F.col("member").isNotNull(), ~F.coalesce("complete", F.lit(True))).otherwise(F.lit(True))
    out = owned.groupBy("scope", "run", "item").agg(F.min(F.when(live, F.col("key"))).alias("key"), F.bool_or(hidden | ~F.col("permits")).alias("hidden"))
    status = F.when(F.col("key").isNotNull(), "present").when(F.col("hidden"), "unknown").otherwise("absent")
    return out.select("scope", "run", "item", status.alias("status"), "key")


def with_target(runs: DataFrame, items: DataFrame, targets: DataFrame, target_items: DataFrame) -> DataFrame:
    """Items of assertions that are present only while their target is: (item -> target) by ``targets`` (scope, item, target); a target without a row follows the run's permission."""
    t = target_items.select("scope", "run", F.col("item").alias("target"), F.col("status").alias("of_target"))
    wide = items.join(targets, ["scope", "item"], "left").join(t, ["scope", "run", "target"], "left").join(runs.select("scope", "run", "permits"), ["scope", "run"])
    of = F.coalesce("of_target", F.when(F.col("permits"), "absent").otherwise("unknown"))
    status = F.when((F.col("status") != "present") | F.col("target").isNull(), F.col("status")).otherwise(of)
    return wide.select("scope", "run", "item", status.alias("status"), F.when(status == "present", F.col("key")).alias("key"))


def with_absences(runs: DataFrame, items: DataFrame) -> DataFrame:
    """The known states of each item in order of time (scope, item, at, run, status, key): its rows, and an absent one at the first run that permits it between two of them."""
    placed = items.join(numbered(runs).select("scope", "run", "at", "n", "gap"), ["scope", "run"])
    following = F.lead("n").over(Window.partitionBy("scope", "item").orderBy("n"))
    opened = F.col("gap").isNotNull() & (F.col("next_n").isNull() | (F.col("gap.n") < F.col("next_n")))
    own = F.struct("at", "run", "status", "key")
    absent = F.struct(F.col("gap.at").alias("at"), F.col("gap.run").alias("run"), F.lit("absent").alias("status"), F.lit(None).cast(dict(items.dtypes)["key"]).alias("key"))
    # both rows of an item come from one pass over it: a union would compute the items twice
    return placed.withColumn("next_n", following).select("scope", "item", F.inline(F.array_compact(F.array(own, F.when(opened, absent)))))


def horizon(runs: DataFrame, intervals: DataFrame, declared: bool) -> DataFrame:
    """Whether each item is current: its last interval is open or, for ``declared`` ends, holds at the newest run's time: scope, item, current."""
    last = intervals.groupBy("scope", "item").agg(F.max_by(F.struct("valid_from", "valid_to"), "valid_from").alias("i"))
    if not declared:
        return last.select("scope", "item", F.col("i.valid_to").isNull().alias("current"))
    top = runs.groupBy("scope").agg(F.max("at").alias("top"))
    return last.join(top, "scope").select("scope", "item", ((F.col("i.valid_from") <= F.col("top")) & (F.col("i.valid_to").isNull() | (F.col("top") < F.col("i.valid_to")))).alias("current"))


def history(intervals: DataFrame, view: Column, cap: int = 100) -> DataFrame:
    """Each item's intervals that begin by ``view``, newest first, at most ``cap``; an end after the view is open."""
    w = Window.partitionBy("scope", "item").orderBy(F.desc("valid_from"))
    past = intervals.filter(F.col("valid_from") <= view).withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= cap)
    return past.withColumn("valid_to", F.when(F.col("valid_to") <= view, F.col("valid_to")))


def revision_view(picked: DataFrame, intervals: DataFrame) -> DataFrame:
    """What holds at the start of each scope's picked run (scope, run, at): scope, run, item, key."""
    return picked.join(intervals, "scope").filter((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select("scope", "run", "item", "key")


def members_at(picked: DataFrame, members: DataFrame) -> DataFrame:
    """The files of the picked runs with their revisions: scope, run, file_id, revision."""
    return members.groupBy("scope", "run", "file_id").agg(F.min("revision").alias("revision")).join(picked.select("scope", "run"), ["scope", "run"], "left_semi")
