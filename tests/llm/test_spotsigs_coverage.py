"""Texts without anchors of the fixed list are fingerprinted whole."""

import random

from chronofold.llm import spotsigs


def signatures(text, chain=3):
    """The signature texts of a lower-case text with blanks between words."""
    words = text.split()
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    starts = [i for i in content if i == 0 or words[i - 1] in spotsigs.ANCHORS or (i >= chain and not set(words[i - chain : i]) & set(spotsigs.ANCHORS))]
    return {" ".join(words[j] for j in content[content.index(i) : content.index(i) + chain]) for i in starts}


def test_every_word_reaches_the_fingerprint(spark):
    rng = random.Random(6)
    finnish = [f"sana{rng.randint(0, 9999)}" for _ in range(80)]
    other = finnish[:3] + [f"toinen{rng.randint(0, 9999)}" for _ in range(77)]
    changed = ["muu", *finnish[1:]]
    mixed = " ".join(rng.choice(["the", "of", "a1", "b2", "c3", "d4", "e5"]) for _ in range(200))
    texts = [(1, " ".join(finnish)), (2, " ".join(other)), (3, " ".join(changed)), (4, mixed), (5, "1 2 3 4 5 6 7")]
    got = {r["doc_id"]: set(r["signatures"]) for r in spotsigs.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: len(s) for i, s in got.items()} == {i: len(signatures(t)) for i, t in texts}
    assert len(got[1] & got[2]) <= 1 and len(got[1] & got[3]) >= 0.9 * len(got[1] | got[3])


def test_near_next_of_texts_with_one_opening(spark):
    opening = "yksi kaksi kolme "
    texts = [(k, opening + " ".join(f"s{k}x{i}" for i in range(60))) for k in range(4)]
    rows = spotsigs.edited_pairs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["near_next"] < 0.1 and 0.3 < r["near_edited"] < 1 for r in rows)
