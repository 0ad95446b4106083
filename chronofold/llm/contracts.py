"""The thin ``opN_`` queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, exact_dedup, html_extract, language, line_dedup, packing, simhash, spotsigs, token_counts, token_store
from chronofold.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("heavy")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir)).drop("group")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = html_extract.extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.edited_pairs(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.as_string(F.col("signatures")).alias("fingerprint"), spotsigs.as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited", "near_next", "copy_edited", "copy_next",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_round_trip(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_simhash, op3_language_id, op4_html_extraction, op5_token_counts,
        op6_packing, op7_bpe, op8_fingerprints, op9_line_dedup, op10_token_output,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
