"""Language identification as mixture inference.

The model holds, for each language, smoothed likelihoods of letter trigrams (hashed to ``BUCKETS``; words are padded, so
starts and ends count).  For a text, expectation-maximisation over its trigram counts estimates the proportion of each
language.  Languages then leave the set from the smallest proportion on, as long as the penalised likelihood
(``PENALTY`` times log of the trigram count for each language) does not fall.  The prediction is the language with the largest share.

Fitting uses a hash-chosen sample of about ``SAMPLE`` documents a language; prediction and its counts use every character of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.common import append_columns, bounded_batches

BUCKETS, SAMPLE, SMOOTHING, PENALTY, ROUNDS = 1 << 15, 3000, 0.5, 3.0, 40
#: The training sample's bound in languages: those with the most documents are learned.  The model has BUCKETS floats for each, so its broadcast is bounded.
MAX_LANGUAGES = 512
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Used buckets and their counts; empty arrays for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = b != 0
    with np.errstate(over="ignore"):
        mixed = a[inside] * np.uint32(0x9E3779B1) ^ b[inside] * np.uint32(0x85EBCA77) ^ c[inside] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def mixture(logp: np.ndarray, n: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """EM over rows of log-likelihoods ``logp`` (grams x languages) with counts ``n``: proportions and log-likelihood."""
    top = logp.max(1)
    p = np.exp(logp - top[:, None])
    share = np.full(logp.shape[1], 1 / logp.shape[1]) if start is None else start
    total = n.sum()
    for _ in range(ROUNDS):
        joint = p * share
        mass = joint.sum(1)
        new = (n / mass) @ joint / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ (np.log(p @ share) + top))


class LanguageModel:
    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(counts)
        c = np.array([counts[k] for k in languages], np.float64).reshape(len(languages), BUCKETS) + SMOOTHING
        return cls(languages, np.log(c / c.sum(1, keepdims=True)).T.astype(np.float32).copy())

    def predict(self, text: str) -> tuple[str, float, list[str]]:
        """(language, score, language set).  ``und`` with score 0 and no set for a text without letters."""
        used, n = trigrams(text)
        if not len(used) or not self.languages:
            return UNDETERMINED, 0.0, []
        logp = self.logp[used].astype(np.float64)
        single = n @ logp
        first = int(single.argmax())
        penalty = PENALTY * np.log1p(n.sum())
        alone = np.exp(single - single.max())
        if len(self.languages) > 1:
            share, best = mixture(logp, n)
            if single[first] - penalty < best - 2 * penalty:
                chosen = np.arange(len(self.languages))
                while len(chosen) > 1:
                    fewer = np.delete(np.arange(len(chosen)), share.argmin())
                    start = share[fewer] + 1e-6
                    share2, value = mixture(logp[:, chosen[fewer]], n, start / start.sum())
                    if value + penalty < best:
                        break
                    chosen, share, best = chosen[fewer], share2, value
                if len(chosen) > 1:
                    order = np.argsort(-share, kind="stable")
                    return self.languages[chosen[order[0]]], float(min(1.0, share[order[0]])), [self.languages[chosen[k]] for k in order]
                first = int(chosen[0])
        return self.languages[first], float(alone[first] / alone.sum()), [self.languages[first]]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            used, n = trigrams(text or "")
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own[used] += n
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(own[used])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from documents with a language that are not held out: an expected ``sample`` of each language, chosen by hash of doc_id.

    Of more than ``languages`` label values those with the most documents are learned, ties by name, so a column of stray labels stops nothing.
    """
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    picked = train.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("lang", "text")
    counts: dict[str, np.ndarray] = {k: np.zeros(BUCKETS, np.int64) for k in sizes}
    rows = picked.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():  # at most ``languages`` x BUCKETS
        counts[r["lang"]][r["bucket"]] = r["n"]
    return LanguageModel.from_counts(counts)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score (0 to 1) and languages (the inferred set, largest share first).

    The score is the language's share of a mixture, or its posterior against the other languages for a text of
    one.  Null, empty and letterless texts, and all texts under a model without languages, give ``und``, 0 and
    an empty set.  Repeated rows come as they are; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        predict = sent.value.predict

        def each(texts: list[str]):
            return list(zip(*[predict(t) for t in texts], strict=True)) or [[], [], []]

        return each

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    return append_columns(docs, fields, compute, text_col)
