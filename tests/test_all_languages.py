"""The _all reads search documents of every language, and of none."""

from pyspark.sql import functions as F

from chronofold.plans import catalog

TEXTS = [(1, "the house of the sea and the", "en"), (2, "the house of the sea and the the", "de"), (3, "der the and of the", None), (4, "que", "es")]


def test_reads_take_every_language(spark, tmp_path):
    d = f"file://{tmp_path}"
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")

    def ids(name, column="doc_id"):
        return {r[column] for r in catalog.QUERIES[name](spark, d).collect()}

    assert ids("lexical_or_topk_all") == ids("budget_page_all") == {1, 2, 3, 4} and ids("lexical_or_topk") == ids("budget_page") == {1}
    assert ids("lexical_and_phrase_all") == {1, 2, 3}
    assert ids("rank_fusion_all", "id") == {1, 2, 3, 4, 7}
    assert ids("candidate_rank_all", "item_id") == {f"d{i:010d}" for i in (1, 2, 3, 4)}
    assert not any("lang" in catalog.ORACLE_SQL[n] for n in catalog.ORACLE_SQL if n.endswith("_all"))
