"""Web-style queries: quoted phrases, ``or``, ``-`` for not, otherwise and; matched and ranked by how densely covers lie."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[a-z0-9]+")
PIECE = re.compile(r'(-?)(?:"([^"]*)"?|([^\s"]+))')
WEIGHT = 0.1  # of an unlabelled word

#: Conjunctions of operands; an operand is (negated, the words of a phrase).
Query = list[list[tuple[bool, tuple[str, ...]]]]


def parse(text: str) -> Query:
    """``or`` separates conjunctions where operands stand on both sides, else it is a word.  Operands without words are skipped."""
    pieces = list(PIECE.finditer(text.lower()))
    out: Query = [[]]
    for i, m in enumerate(pieces):
        if m[3] == "or" and not m[1] and out[-1] and i + 1 < len(pieces):
            out.append([])
            continue
        words = tuple(WORD.findall(m[2] if m[3] is None else m[3]))
        if words:
            out[-1].append((m[1] == "-", words))
    return [c for c in out if c]


def cover_density(words: list[str], query: Query) -> float:
    """0 where the words do not match; else each cover adds WEIGHT / (1 + foreign words inside it).

    A cover is a shortest stretch that holds all positive operands of a conjunction; the next one starts after its first word.
    A match by negated operands alone has no cover and scores 0 as well.
    """
    phrases = {p for c in query for _, p in c}
    starts_with: dict[str, list[tuple[str, ...]]] = {}
    for p in phrases:
        starts_with.setdefault(p[0], []).append(p)
    ends: dict[int, list[tuple[tuple[str, ...], int]]] = {}
    entries: set[int] = set()
    present = set()
    for i, w in enumerate(words):
        for p in starts_with.get(w, ()):
            if len(p) == 1 or tuple(words[i : i + len(p)]) == p:
                ends.setdefault(i + len(p) - 1, []).append((p, i))
                present.add(p)
    live = [[p for negated, p in c if not negated] for c in query if all((p in present) != negated for negated, p in c)]
    live = [c for c in live if c]
    if not live:
        return 0.0
    for c in live:
        for p in c:
            entries.update(j for end, hits in ends.items() for q, i in hits if q == p for j in range(i, end + 1))
    before = [0]
    for i in range(len(words)):
        before.append(before[-1] + (i in entries))
    last: dict[tuple[str, ...], int] = {}
    floor, score = 0, 0.0
    for end in sorted(ends):
        for p, i in ends[end]:
            last[p] = i
        start = max(min(last.get(p, -1) for p in c) for c in live)
        if start >= floor:
            noise = end - start + 1 - (before[end + 1] - before[start])
            score += WEIGHT / (1 + noise)
            floor = start + 1
    return score


def rank(docs: DataFrame, query: str, text: str, ident: str, k: int) -> DataFrame:
    """The top ``k`` documents by cover density (six digits), then id.  Null texts match nothing; a query without words neither."""
    parsed = parse(query)
    need = sorted({w for c in parsed for negated, p in c if not negated for w in p})
    kind = dict(docs.select(ident).dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [cover_density(WORD.findall(t), parsed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[ident, "score"])

    if not need:
        return docs.select(ident, F.lit(0.0).alias("score")).limit(0)
    # texts without any positive word never reach Python
    some = docs.select(ident, F.lower(text).alias("w")).filter(F.col("w").rlike("(?<![a-z0-9])(?:" + "|".join(need) + ")(?![a-z0-9])"))
    scored = some.mapInArrow(run, f"{ident} {kind}, score double").filter("score > 0")
    return scored.select(ident, F.round("score", 6).alias("score")).orderBy(F.desc("score"), ident).limit(k)
