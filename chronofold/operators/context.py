"""The five questions: typed candidates of code, relations, decisions, failures and content, packed into one cited answer.

A ``World`` holds one repository's tables as they were at the asked revision and times (the interval and as-of operators give them):

nodes      id, kind (module, file, symbol), name, path, observed, citations
edges      id, src, dst, type, evidence, confidence, review, observed, citations
decisions  id, status, standing (active, superseded, expired, superseded_undated), subjects, supersedes_id, superseded_by, recorded_at, citations
failures   id, component, operation, error_class, fingerprint, valid_from, observed_at (array), resolution, citations
hits       content_id, source (lexical, vector), score, excerpt, observed, citations
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import answers, graph
from chronofold.sources.scratch import cut_lineage

# English and Portuguese function words that are no query tokens.
STOP_WORDS = frozenset(
    "a an and are as at be by do for from how in into is it of on or the this that to was were what when where which why with "
    "o os de da dos das em no na um uma para por que com".split()
)
# Limits of a query and of the walk around its anchors.
MAX_QUERY, MAX_TOKENS, MAX_TOKEN, ANCHORS, DEPTH = 1000, 16, 48, 5, 2
EXACT = ["scip", "git", "test"]
CAMEL, TOKEN = "(?<=[a-z0-9])(?=[A-Z])", "[0-9a-zà-öø-ÿ]+"
WORD_CHARACTER = re.compile(TOKEN)


class RequestError(ValueError):
    """A query that cannot be asked: too long, an unknown or an ambiguous symbol."""


@dataclass(frozen=True)
class World:
    """A question reads only some of the tables; those it does not read may be left out."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    decisions: DataFrame | None = None
    failures: DataFrame | None = None
    hits: DataFrame | None = None


def query_tokens(text: str) -> list[str]:
    """The first distinct words without function words; a capital after a small letter or a digit begins one.

    One scan over the characters, for the one short text of a question; ``scalars.query_tokens`` is the same rule for a column.
    """
    if len(text) > MAX_QUERY:
        raise RequestError(f"a query has at most {MAX_QUERY} characters")
    found: dict[str, None] = {}
    word, before = "", ""
    for char in f"{text} ":
        small = char.lower()
        inside = WORD_CHARACTER.fullmatch(small) is not None
        if word and (not inside or ("A" <= char <= "Z" and ("a" <= before <= "z" or "0" <= before <= "9"))):
            if 1 < len(word) <= MAX_TOKEN and word not in STOP_WORDS:
                found[word] = None
            word = ""
        word, before = (word + small if inside else ""), char
    return [*found][:MAX_TOKENS]


def overlap(tokens: list[str], names: Column) -> Column:
    """Share of the tokens that are words of the names (an array), six digits; 0 without tokens."""
    if not tokens:
        return F.lit(0.0)
    text = F.lower(F.regexp_replace(F.array_join(names, " "), CAMEL, " "))
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.round(F.size(F.array_intersect(F.array(*[F.lit(t) for t in tokens]), words)) / F.lit(len(tokens)), 6)


def _items(df: DataFrame, kind: str | Column, ident: Column, body: Column, recency: str, tier=1, match=0.0, priority=0, exact=True, distance=None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    kind = as_column(kind)
    return df.select(
        F.concat(kind, F.lit(":"), ident).alias("item_id"), kind.alias("kind"), as_column(priority).cast("int").alias("priority"), as_column(tier).cast("int").alias("tier"),
        as_column(exact).alias("exact_scope"), as_column(distance).cast("int").alias("distance"), as_column(match).cast("double").alias("match"), F.col(recency).cast("timestamp").alias("recency"),
        body.alias("body"), F.col("citations"),
    )


def relation_tier(evidence: Column, confidence: Column, review: Column) -> Column:
    """5 for deterministic evidence of full confidence, 3 from 0.9 on, else 2; an accepted review adds one."""
    base = F.when((confidence >= 1.0) & evidence.isin(EXACT), 5).when(confidence >= 0.9, 3).otherwise(2)
    return base + F.when(review == "accepted", 1).otherwise(0)


def normal_hits(hits: DataFrame) -> DataFrame:
    """The best match per content: lexical scores over their greatest, vector scores from 0.3 on times 0.8, at most 1."""
    top = hits.filter("source = 'lexical'").agg(F.max("score").alias("top"))
    scaled = F.when(F.col("source") == "lexical", F.when(F.col("top") > 0, F.col("score") / F.col("top"))).when(F.col("score") >= 0.3, F.least(F.col("score") * 0.8, F.lit(1.0)))
    scored = hits.crossJoin(F.broadcast(top)).withColumn("match", F.round(scaled, 6)).filter("match > 0")  # one row
    return scored.groupBy("content_id").agg(F.max("match").alias("match"), F.max_by(F.struct("excerpt", "observed", "citations"), F.struct("match", "source")).alias("h")).select("content_id", "match", "h.*")


def _with_hits(facts: DataFrame, own: Column, hits: DataFrame) -> DataFrame:
    """``match``: the greater of the facts' own match and that of the best hit that cites one of their events."""
    cited = facts.select("id", F.explode("citations").alias("event")).join(hits.select("match", F.explode("citations").alias("event")), "event")
    best = cited.groupBy("id").agg(F.max("match").alias("hit"))
    return facts.withColumn("own", own).join(best, "id", "left").withColumn("match", F.greatest("own", F.coalesce("hit", F.lit(0.0)))).drop("own", "hit")


def code_items(nodes: DataFrame, distances: DataFrame, match: Column, priority: int = 0) -> DataFrame:
    near = nodes.filter("kind in ('file', 'symbol')").join(distances, "id")
    return _items(near, F.col("kind"), F.col("id"), F.concat_ws(" at ", "name", "path"), "observed", tier=F.when(F.col("kind") == "symbol", 4).otherwise(3), match=match, priority=priority, distance=F.col("distance"))


def relation_items(edges: DataFrame, nodes: DataFrame, distances: DataFrame, centre: str | None = None) -> DataFrame:
    """Relations with both ends in reach; those of the centre count more.  Heuristic ones say so."""
    named = nodes.select("id", "name")
    a, b = (distances.join(named, "id", "left").select(F.col("id").alias(end), F.col("distance").alias(f"d_{end}"), F.coalesce("name", "id").alias(f"n_{end}")) for end in ("src", "dst"))
    r = edges.join(a, "src").join(b, "dst")
    tier = relation_tier(F.col("evidence"), F.col("confidence"), F.col("review"))
    sure = F.when((F.col("confidence") >= 1.0) & F.col("evidence").isin(EXACT), "deterministic").otherwise("heuristic, not verified")
    body = F.concat_ws(" ", "n_src", "type", "n_dst", F.concat(F.lit("("), sure, F.lit(": "), F.col("evidence"), F.lit(", confidence "), F.col("confidence").cast("string"), F.lit(")")))
    priority = 0 if centre is None else F.when((F.col("src") == centre) | (F.col("dst") == centre), 4).otherwise(2)
    return _items(r, "relation", F.col("id"), body, "observed", tier=tier, priority=priority, distance=F.least("d_src", "d_dst"))


def decision_items(decisions: DataFrame, priority: int | Column = 0, match: float | Column = 0.0) -> DataFrame:
    ends = F.when(F.col("standing") == "superseded", F.concat(F.lit("superseded by "), F.coalesce("superseded_by", F.lit("unknown")))).otherwise(F.col("standing"))
    body = F.concat(F.lit("decision "), F.col("id"), F.lit(": "), ends, F.lit("; status "), F.col("status"), F.lit("; subjects "), F.array_join("subjects", ", "))
    return _items(decisions, "decision", F.col("id"), body, "recorded_at", tier=F.when(F.col("status") == "accepted", 4).otherwise(2), priority=priority, match=match)


def failure_items(failures: DataFrame, priority: int = 0, match: float | Column = 0.0) -> DataFrame:
    body = F.concat(F.lit("failure "), F.concat_ws(" / ", "component", "operation", "error_class"), F.lit(": "), F.col("resolution"))
    return _items(failures, "failure", F.col("id"), body, "valid_from", tier=F.when(F.col("resolution") == "resolved", 4).otherwise(3), priority=priority, match=match)


def failure_words() -> Column:
    return F.array("id", "component", "operation", "error_class")


def decision_words() -> Column:
    return F.concat(F.array("id"), F.col("subjects"))


def in_window(failures: DataFrame, start, end) -> DataFrame:
    """Failures first seen, or seen again, within [start, end)."""
    inside = lambda t: (t >= F.lit(start)) & (t < F.lit(end))
    return failures.filter(inside(F.col("valid_from")) | F.coalesce(F.exists("observed_at", inside), F.lit(False)))


def _reach(world: World, anchors: DataFrame) -> DataFrame:
    # both ends of a relation and the code itself look the distances up: the walk is done once
    return cut_lineage(graph.neighbourhood(world.edges, anchors.select("id"), DEPTH))


def _all(parts: list[DataFrame]) -> DataFrame:
    # ranking reads the candidates several times: they are made once
    return answers.rank_candidates(cut_lineage(answers.merge_candidates(reduce(DataFrame.unionByName, parts))))


def context_for_task(world: World, task: str) -> DataFrame:
    """Ranked candidates for a task: the best-named code and its surroundings, decisions, open or matching failures, other content."""
    tokens = query_tokens(task)
    matched = world.nodes.filter("kind in ('file', 'symbol')").select("id", overlap(tokens, F.array("name")).alias("named")).filter("named > 0")
    anchors = matched.orderBy(F.desc("named"), "id").limit(ANCHORS)
    reach = _reach(world, anchors)
    nodes = world.nodes.join(matched, "id", "left")
    hits = normal_hits(world.hits)
    decisions = _with_hits(world.decisions.filter("standing = 'active'"), overlap(tokens, decision_words()), hits)
    failures = _with_hits(world.failures, overlap(tokens, failure_words()), hits).filter("resolution <> 'resolved' or match > 0")
    told = world.decisions.select(F.explode("citations").alias("event")).unionByName(world.failures.select(F.explode("citations").alias("event"))).distinct()
    # content that a decision or a failure already carries, or that speaks of one that does not hold, is left out
    carried = hits.select("content_id", F.explode("citations").alias("event")).join(told, "event").select("content_id").distinct()
    other = hits.join(carried, "content_id", "left_anti")
    return _all([
        code_items(nodes, reach, F.coalesce("named", F.lit(0.0))), relation_items(world.edges, world.nodes, reach), decision_items(decisions, match=F.col("match")),
        failure_items(failures, match=F.col("match")), _items(other, "content", F.col("content_id"), F.col("excerpt"), "observed", match=F.col("match"), exact=False),
    ])


def repository_overview(world: World, changes: DataFrame) -> DataFrame:
    """Modules, dependencies on external packages, ``changes`` against the run before (id, change, observed, citations), active decisions and open failures."""
    modules = world.nodes.filter("kind = 'module'")
    needs = world.edges.filter("type = 'DEPENDS_ON'")
    return _all([
        _items(modules, "module", F.col("id"), F.concat_ws(" at ", "name", "path"), "observed", tier=4, priority=2),
        _items(needs, "dependency", F.col("id"), F.concat_ws(" ", "src", F.lit("depends on"), "dst"), "observed", tier=relation_tier(F.col("evidence"), F.col("confidence"), F.col("review")), priority=1),
        _items(changes, "change", F.col("id"), F.concat_ws(" ", "id", "change"), "observed", tier=5, priority=2),
        decision_items(world.decisions.filter("standing = 'active'"), priority=3), failure_items(world.failures.filter("resolution <> 'resolved'"), priority=3),
    ])


def resolve_symbol(nodes: DataFrame, name: str) -> str:
    """Id of the symbol with that id, else that whole name, else that last segment; unknown and ambiguous names are refused."""
    symbols = nodes.filter("kind = 'symbol'")
    step = F.when(F.col("id") == name, 0).when(F.col("name") == name, 1).when(F.element_at(F.split("name", r"\."), -1) == name, 2)
    found = symbols.withColumn("step", step).filter("step is not null").groupBy("step").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).orderBy("step").limit(1).collect()
    if not found:
        raise RequestError("unknown symbol")
    if found[0]["n"] > 1:
        raise RequestError("ambiguous symbol")
    return found[0]["id"]


def symbol_context(world: World, name: str) -> DataFrame:
    """One symbol: its definition, the relations around it, and every decision on it or its file."""
    ident = resolve_symbol(world.nodes, name)
    centre = world.nodes.filter(F.col("id") == ident)
    reach = _reach(world, centre)
    about = centre.select(F.explode(F.array("id", "name", "path")).alias("subject"))
    decided = world.decisions.join(world.decisions.select("id", F.explode("subjects").alias("subject")).join(F.broadcast(about), "subject").select("id").distinct(), "id", "left_semi")  # three rows
    return _all([
        code_items(centre, reach.filter(F.col("id") == ident), F.lit(1.0), priority=5), relation_items(world.edges, world.nodes, reach, centre=ident), decision_items(decided, priority=3, match=1.0),
    ])


def decision_history(world: World, query: str) -> DataFrame:
    """Decisions that match, or all if none does, closed over supersession both ways until none is new; active ones first."""
    matched = cut_lineage(_with_hits(world.decisions, overlap(query_tokens(query), decision_words()), normal_hits(world.hits)))
    named = matched.filter("match > 0").select("id")
    links = world.decisions.select(F.col("id").alias("src"), F.explode(F.array("supersedes_id", "superseded_by")).alias("dst")).filter("dst is not null")
    chosen = graph.closure(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), named) if not named.isEmpty() else matched.select("id")
    return _all([decision_items(matched.join(chosen.distinct(), "id", "left_semi"), priority=F.when(F.col("standing") == "active", 1).otherwise(0), match=F.col("match"))])


def failure_history(world: World, start, end, query: str = "", fingerprint: str | None = None) -> DataFrame:
    """Failures seen in [start, end): those of a fingerprint, or those that match the query, or all if none does."""
    seen = in_window(world.failures, start, end)
    if fingerprint is not None:
        return _all([failure_items(seen.filter(F.col("fingerprint") == fingerprint), match=1.0)])
    matched = _with_hits(seen, overlap(query_tokens(query), failure_words()), normal_hits(world.hits))
    some = matched.agg(F.coalesce(F.bool_or(F.col("match") > 0), F.lit(False)).alias("some"))
    chosen = matched.crossJoin(F.broadcast(some)).filter((F.col("match") > 0) | ~F.col("some")).drop("some")  # one row
    return _all([failure_items(chosen, match=F.col("match"))])
