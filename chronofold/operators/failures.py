"""Failures, the runs that show them, and whether a later pass resolved them.

runs          run_id, target columns, failed, passed, completed_at, recorded_at, commit_id, snapshot_id
observations  failure_id, ci_run_id, test_run_id, valid_from, recorded_at
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(runs: DataFrame, valid_at, recorded_at) -> DataFrame:
    """Runs completed and recorded by the two cuts."""
    return runs.filter((F.col("completed_at") <= F.lit(valid_at)) & (F.col("recorded_at") <= F.lit(recorded_at)))


def with_next_pass(runs: DataFrame, target: list[str]) -> DataFrame:
    """Failing runs with ``fix``: the earliest later passing run of the target that names a commit or a snapshot (run_id, completed_at, commit_id), else null."""
    ahead = Window.partitionBy(*target).orderBy(F.desc("completed_at"), F.desc("run_id")).rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("passed") & (F.col("commit_id").isNotNull() | F.col("snapshot_id").isNotNull())
    fix = F.last(F.when(counts, F.struct("run_id", "completed_at", "commit_id")), ignorenulls=True).over(ahead)
    return runs.withColumn("fix", fix).filter("failed")


def fix_paths(observations: DataFrame, runs: DataFrame, target: list[str], valid_at, recorded_at) -> DataFrame:
    """Per failure and target its latest visible failing run and that run's next pass: failure_id, target, run_id, completed_at, fixed_by, fixed_at, commit_changed.

    ``commit_changed`` is null where either commit is unknown.
    """
    seen = observations.filter((F.col("valid_from") <= F.lit(valid_at)) & (F.col("recorded_at") <= F.lit(recorded_at)))
    failing = with_next_pass(visible(runs, valid_at, recorded_at), target).select("run_id", *target, "completed_at", "commit_id", "fix")
    hit = seen.filter("ci_run_id is not null").select("failure_id", F.col("ci_run_id").alias("run_id")).join(failing, "run_id")
    last = hit.groupBy("failure_id", *target).agg(F.max_by(F.struct("run_id", "completed_at", "commit_id", "fix"), F.struct("completed_at", "run_id")).alias("r"))
    return last.select(
        "failure_id", *target, "r.run_id", "r.completed_at", F.col("r.fix.run_id").alias("fixed_by"), F.col("r.fix.completed_at").alias("fixed_at"),
        (F.col("r.commit_id") != F.col("r.fix.commit_id")).alias("commit_changed"),
    )


def resolution(observations: DataFrame, runs: DataFrame, target: list[str], valid_at, recorded_at, cut: DataFrame | None = None) -> DataFrame:
    """Per failure: n_observed, first_seen, last_seen, status.

    Resolved: every target has a next pass and nothing was observed after the pass of the latest failing run.  Unresolved: there are CI runs otherwise.
    Unsupported: only test runs.  Unknown: neither, or a failure of ``cut`` (failure_id), whose history was not read to its end.
    """
    seen = observations.filter((F.col("valid_from") <= F.lit(valid_at)) & (F.col("recorded_at") <= F.lit(recorded_at)))
    ends = visible(runs, valid_at, recorded_at).select(F.col("run_id").alias("ci_run_id"), F.col("completed_at").alias("run_end"))
    facts = seen.join(ends, "ci_run_id", "left").groupBy("failure_id").agg(
        F.count("*").alias("n_observed"), F.min("valid_from").alias("first_seen"), F.max(F.coalesce("run_end", "valid_from")).alias("last_seen"),
        F.count("ci_run_id").alias("n_ci"), F.count("test_run_id").alias("n_test"),
    )
    paths = fix_paths(observations, runs, target, valid_at, recorded_at).groupBy("failure_id").agg(
        F.bool_and(F.col("fixed_by").isNotNull()).alias("all_fixed"), F.max_by("fixed_at", F.struct("completed_at", "run_id")).alias("closed_at")
    )
    out = facts.join(paths, "failure_id", "left")
    status = F.when(F.col("all_fixed") & (F.col("last_seen") <= F.col("closed_at")), "resolved").when(F.col("n_ci") > 0, "unresolved").when(F.col("n_test") > 0, "unsupported").otherwise("unknown")
    if cut is not None:
        out = out.join(cut.select("failure_id", F.lit(True).alias("is_cut")), "failure_id", "left")
        status = F.when(F.col("is_cut"), "unknown").otherwise(status)
    return out.select("failure_id", "n_observed", "first_seen", "last_seen", status.alias("status"))


def newest_observations(observations: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(kept, cut): the ``cap`` newest observations without the failure that the cut goes through, and the failures (failure_id) that lost some."""
    first = observations.orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(cap + 1)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recorded_at"), F.desc("event_id"))))  # at most cap + 1 rows
    split = numbered.filter(F.col("place") == cap + 1).select("failure_id")
    kept = numbered.filter(F.col("place") <= cap).drop("place").join(F.broadcast(split), "failure_id", "left_anti")  # one row
    whole = observations.groupBy("failure_id").agg(F.count("*").alias("n"))
    part = kept.groupBy("failure_id").agg(F.count("*").alias("k"))
    return kept, whole.join(part, "failure_id").filter("k < n").select("failure_id")
