"""Lexical and vector retrieval, fusion and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the basic Latin range."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_or(docs: DataFrame, terms: list[str], text: str, ident: str, k: int) -> DataFrame:
    """Documents that hold any term, by number of occurrences, then id; the top ``k``."""
    any_term = "(?<![a-z0-9])(?:" + "|".join(sorted(terms)) + ")(?![a-z0-9])"  # terms are words of [a-z0-9]
    hits = F.regexp_count(F.lower(text), F.lit(any_term)).cast("long")
    return docs.select(ident, hits.alias("score")).filter("score > 0").orderBy(F.desc("score"), ident).limit(k)


def lexical_phrase(docs: DataFrame, all_of: list[str], phrase: list[str], text: str, ident: str, k: int) -> DataFrame:
    """Documents with every term and the phrase in sequence, by number of phrase occurrences, then id."""
    words = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), "  "), F.lit(" "))
    every = [F.contains(F.col("w"), F.lit(f" {t} ")) for t in all_of]
    needle = " " + "  ".join(phrase) + " "
    n = F.floor((F.length("w") - F.length(F.replace(F.col("w"), F.lit(needle), F.lit("")))) / len(needle)).cast("long")
    out = docs.select(ident, words.alias("w")).withColumn("score", n).filter("score > 0")
    for cond in every:
        out = out.filter(cond)
    return out.select(ident, "score").orderBy(F.desc("score"), ident).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(vectors: DataFrame, query: DataFrame, vector: str, ident: str, k: int) -> DataFrame:
    """Exact cosine similarity to the one query vector (column q), scope filters applied before; the top ``k``."""
    q = F.broadcast(query.limit(1))  # one row
    score = dot(F.col(vector), F.col("q")) / (F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    return vectors.crossJoin(q).select(ident, F.round(score, 6).alias("score")).orderBy(F.desc("score"), ident).limit(k)


def token_overlap(items: DataFrame, words: str, query: list[str]) -> Column:
    """Share of the query tokens that occur among the words, six digits."""
    q = F.array(*[F.lit(t) for t in query])
    return F.round(F.size(F.array_intersect(q, F.col(words))) / F.lit(len(query)), 6)


def budget_page(ranked: DataFrame, rank: str, body: str, budget: int, items: int) -> DataFrame:
    """The contiguous head of the ranking within a byte budget: bodies, separating commas, two brackets; and an item cap.

    The ranking is bounded (a page's candidates), so one window without partition is in order.
    """
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length(body)
    running = F.sum(size).over(w) + F.row_number().over(Window.orderBy(rank)) - 1 + 2
    return ranked.withColumn("bytes", size.cast("long")).withColumn("total", running.cast("long")).filter((F.col("total") <= budget) & (F.col(rank) <= items))
