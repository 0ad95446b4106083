"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns the columns of documents; the last returns the
packed pieces.  ``run`` writes each stage's result to the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import language, line_dedup, near_copies, packing, simhash
from chronofold.llm.common import Sweep, discard, documents, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay; texts that are null, empty or without letters go.

    Repeated rows are judged alike; an empty table stays empty.
    """
    found = language.identify(docs, language.fit(docs))
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays, with its new length.  A null text is an empty one; the rest as in ``line_dedup``."""
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the longest, among equals the one with the largest doc_id.

    Near copies are op2's: 3-word SimHashes within 3 bits.  ``near_dedup_jaccard`` takes all pairs of similar texts.  Of repeated rows one stays; null
    texts are empty and alike; a null doc_id is the smallest; an empty table stays empty.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def near_dedup_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Like ``near_dedup``, but near copies have 5-word shingle sets of Jaccard similarity 0.8 or more, tested exactly."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences.  Null texts are empty; repeated rows are packed as they come; no rows give none."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("simhash_near_dedup", near_dedup), ("best_fit_packing", pack)]
#: Language models and fingerprints over all pairs are beyond SQL: tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages=STAGES) -> DataFrame:
    """The last stage's rows.  Each stage's result is written; what a stage wrote on the way goes as soon as its own result is there."""
    docs = documents(spark, sf_dir)
    for name, stage in stages[:-1]:
        sweep, before = Sweep(spark), docs
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(docs)
        if before is not docs and hasattr(before, "_written_at"):
            discard(before)
    return stages[-1][1](spark, docs, sf_dir)


def run_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline with ``near_dedup_jaccard`` in place of the SimHash stage."""
    return run(spark, sf_dir, [(n, near_dedup_jaccard if f is near_dedup else f) for n, f in STAGES])
