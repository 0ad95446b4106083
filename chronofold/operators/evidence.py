"""Which events may back an answer, how hits are re-attributed to them, and the wide vector read behind a narrow scope.

events   event_id, event_type, project_id, repository_id, occurred_at, observed_at, snapshot_id, run_id, outbox_id
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.search import dot

# Fixed value: the most candidates that the vector read widens to.
MOST_CANDIDATES = 1000


@dataclass(frozen=True)
class Scope:
    """What a cited event must satisfy; a bound that is None does not bind.  At least a project or a repository is needed."""

    project: str | None = None
    repository: str | None = None
    before: object = None
    recorded_before: object = None
    revision: bool = False
    snapshot: object = None
    most_outbox: int | None = None

    def __post_init__(self):
        if self.project is None and self.repository is None:
            raise ValueError("a scope needs a project or a repository")

    def admits(self) -> Column:
        """Exclusive bounds of both times, delivered by the outbox bound, and in a revision no output of another dirty snapshot.  Null columns never match."""
        c, every = F.col, F.lit(True)
        for want, name in ((self.project, "project_id"), (self.repository, "repository_id")):
            if want is not None:
                every &= c(name) == want
        for bound, name in ((self.before, "occurred_at"), (self.recorded_before, "observed_at")):
            if bound is not None:
                every &= c(name) < F.lit(bound)
        if self.most_outbox is not None:
            every &= c("outbox_id") <= self.most_outbox
        if self.revision:
            dirty = c("event_type").startswith("quality.") & c("snapshot_id").isNotNull() & ~c("snapshot_id").eqNullSafe(F.lit(self.snapshot))
            every &= ~dirty
        return F.coalesce(every, F.lit(False))


def admitted(events: DataFrame, scope: Scope, kept_runs: DataFrame | None = None) -> DataFrame:
    """Events that the scope admits; in a revision a failure observation needs its run among ``kept_runs`` (run_id), or to name none."""
    out = events.filter(scope.admits())
    if not scope.revision or kept_runs is None:
        return out
    kept = kept_runs.select("run_id", F.lit(True).alias("_k")).distinct()
    checked = out.join(kept, "run_id", "left")
    return checked.filter((F.col("event_type") != "knowledge.failure.observed") | F.col("run_id").isNull() | F.col("_k")).drop("_k").select(out.columns)


def newest_events(events: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(the ``cap`` newest by id, one row that tells whether more were left out)."""
    some = events.orderBy(F.desc("event_id")).limit(cap + 1)
    return some.orderBy(F.desc("event_id")).limit(cap), some.agg((F.count("*") > cap).alias("capped"))


def reattributed(hits: DataFrame, provenance: DataFrame, events: DataFrame) -> DataFrame:
    """Hits (content_id, event_id, score) by an admitted event: their own if it is, else the earliest admitted one of their content; hits without any go."""
    own = hits.join(events.select("event_id", F.lit(True).alias("_own")), "event_id", "left")
    other = provenance.join(events.select(F.col("event_id").alias("source_id"), "occurred_at"), "source_id").groupBy("content_id").agg(F.min_by("source_id", F.struct("occurred_at", "source_id")).alias("_first"))
    return own.join(other, "content_id", "left").withColumn("cited", F.when(F.col("_own"), F.col("event_id")).otherwise(F.col("_first"))).filter("cited is not null").drop("_own", "_first")


def rank_by_event(scores: DataFrame, provenance: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted event (event_id) the best score of the documents that cite it."""
    cited = provenance.join(wanted.select(F.col("event_id").alias("source_id")), "source_id", "left_semi")
    return cited.join(scores, "content_id").groupBy(F.col("source_id").alias("event_id")).agg(F.max("score").alias("score"))


def vector_topk_overfetch(vectors: DataFrame, query: list[float], in_scope: Column, ident: str, vector: str, k: int, documents: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest of a scope as a global index gives them: the nearest 4k of all, filtered, and four times as many while too few remain, up to 1,000.

    Exact reads filter first (``search.cosine_topk``); this one is for equal answers where an index cannot.  Hits without a row in ``documents`` (ident) go.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col(vector), q) / (F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(q, q)))
    wide, total = min(4 * k, MOST_CANDIDATES), vectors.count()
    while True:
        near = vectors.withColumn("score", F.round(score, 6)).withColumn("_in", F.coalesce(in_scope, F.lit(False))).select(ident, "score", "_in").orderBy(F.desc("score"), ident).limit(wide)
        kept = near.filter("_in").drop("_in")
        if documents is not None:
            kept = kept.join(documents.select(ident), ident, "left_semi")
        if wide >= min(MOST_CANDIDATES, total) or kept.count() >= k:
            return kept.orderBy(F.desc("score"), ident).limit(k)
        wide = min(4 * wide, MOST_CANDIDATES)
