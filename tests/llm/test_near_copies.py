"""The near-copy stage of pipeline_jaccard against all pairs of 5-word shingle sets."""

import random

import corpus_pipeline
import pytest

from chronofold.llm import near_copies


def brute(docs):
    """Kept doc_ids: of each component of pairs with Jaccard >= 0.8 the longest, then the largest id."""
    words = [(t or "").lower().split() for _, t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for k, (i, t) in enumerate(docs):
        best[find(k)] = max(best.get(find(k), (-1, -1)), (len(t or ""), i))
    return {i for _, i in best.values()}


@pytest.mark.parametrize("sampled, common, at_once", [(16, 3, 65536), (1, 1, 2)])
def test_near_dedup_keeps_one_of_each_component(spark, monkeypatch, sampled, common, at_once):
    monkeypatch.setattr(near_copies, "SAMPLED", sampled)
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(12)]
    texts = []
    for _ in range(12):  # copies with one to four changed words, far apart in bits, beside a passage that all hold
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 60, 150]))] + passage
        for edits in (0, 0, 1, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += ["", " \n", "one", "ONE", "one two three four", "a b c d e f", "a b c d e g"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup_jaccard(spark, df, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in out.collect()} == brute(docs)
    assert corpus_pipeline.near_dedup_jaccard(spark, df.limit(0), "").count() == 0


def test_pipeline_jaccard_drops_a_copy_with_one_more_word(spark, tmp_path):
    """The near copy that 3 bits of a 3-word SimHash miss: 60 words, and the same with one more."""
    import __spark_entry__

    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices("the stone river house of tree water and".split(), k=60)), "en", "s", 0) for i in range(30)]
    texts.append((30, texts[2][1] + " extra", "en", "s", 0))
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["pipeline_jaccard"](spark, f"file://{tmp_path}")
    assert {r["doc_id"] for r in out.collect()} == set(range(31)) - {2}
