"""The near-copy stage moves the sets of pairs that may be alike only, and no texts."""

import random

import numpy as np
import pyarrow as pa

from chronofold.llm import near_copies


def test_bitmaps_rule_out_no_pair_that_is_alike():
    rng = np.random.default_rng(5)
    out = 0
    for n in (0, 1, 2, 3, 5, 9, 31, 32, 33, 64, 100, 129, 500, 2000):
        for gone in sorted({0, 1, n // 10, n // 9, n // 5, n // 3, n}):
            for new in sorted({0, 1, n // 9, n // 5, n // 2}):
                one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                other = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
                both = len(np.intersect1d(one, other))
                alike = 5 * both >= 4 * (len(one) + len(other) - both)
                found = near_copies.may_be_alike(len(one), near_copies.parity(one), len(other), near_copies.parity(other))
                assert found == near_copies.may_be_alike(len(other), near_copies.parity(other), len(one), near_copies.parity(one))
                assert found or not alike
                out += not found
    assert out > 100


def test_sets_of_pairs_that_cannot_be_alike_are_not_written_and_texts_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(40)]  # 36 shingles that all hold, of 135: some are in the index, and no two texts are alike
    texts = [" ".join([f"w{rng.randint(0, 10**6)}" for _ in range(100)] + passage) for _ in range(60)]
    texts += [" ".join([f"x{i}"] + texts[i].split()[1:]) for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows, plans, write = {}, {}, near_copies.materialise

    def noted(frame, label):
        out = write(frame, label)
        rows[label] = rows.get(label, 0) + out.count()
        plans.setdefault(label, []).append(frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(near_copies, "materialise", noted)
    monkeypatch.setattr(near_copies, "COMMON", 10**6)  # so the passage is in the index
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables whose wanted rows are too many to broadcast
    try:
        kept = near_copies.keep_one(df)
        assert kept.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows["near-tested"] + rows["near-more"] > 60
    assert rows["near-sets"] <= 12
    assert all("SortMergeJoin" not in p for p in plans["near-sets"])


def test_groups_stay_whole_however_batches_cut_them():
    rng = random.Random(9)
    rows = sorted((rng.randint(0, 30), k) for k in range(200))
    for size in (1, 2, 7, 200):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        parts.insert(1, [])
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in p], pa.int64()) for c in (0, 1)], names=["s", "k"]) for p in parts]
        seen, groups = [], []
        for (s, k), cuts in near_copies._whole_groups(iter(batches)):
            seen += zip(s.tolist(), k.tolist(), strict=True)
            groups += [set(s[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert seen == rows
        assert [len(g) for g in groups] == [1] * len({s for s, _ in rows})
    assert list(near_copies._whole_groups(iter([]))) == []
