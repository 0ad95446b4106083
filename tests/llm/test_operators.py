"""Every operator against a brute-force version, on small tables with nulls, ties, repeats, empty and long texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import bpe, exact_dedup, html_extract, language, line_dedup, mphash, packing, simhash, spotsigs, token_counts, token_store
from chronofold.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, kept string, digest string, row string"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = ["The", "of", "house", "tree", "Éclair", "stone", "and", "river", "x1", "don't", "ÑANDÚ", "日本", "a"]
    line = "a shared line of more than twenty characters"
    out = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4)))
        out.append((i, text + ("\n  " + line.upper() + "\t" if i % 4 == 0 else "")))
    out += [(60, None), (61, ""), (62, " \n\t"), (63, "!!! ???"), (64, out[3][1]), (65, out[3][1].upper()), (66, "word " * 9000), (67, "x" * 20000)]
    out += [(68, out[5][1] + " stone"), (69, "<|endoftext|> and <|startoftext|>"), (70, "é" * 12 + "\n" + "é" * 12), (71, "  double  spaces ")]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "k", "d", "r") for i, t in docs], SCHEMA).repartition(3)


def rows(df, *cols):
    return {r[0]: tuple(r[c] for c in cols) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, docs):
    for counters in (1, 256):
        got = exact_dedup.exact_dedup(frame(spark, docs), counters=counters)
        assert rows(got, "keep_id", "group_size", "kept", "text_sha256") == brute.exact(docs)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    ties = exact_dedup.exact_dedup(spark.createDataFrame([(7, "a"), (7, "A"), (None, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in ties) == 2 and {r["group_size"] for r in ties} == {3, 1}


def test_misra_gries():
    summary = exact_dedup.MisraGries(9)
    rng = random.Random(1)
    items = ["hot"] * 200 + [str(rng.random()) for _ in range(600)]
    rng.shuffle(items)
    for x in items:
        summary.add(x)
    assert "hot" in summary.counts and len(summary.counts) <= 9


def test_simhash(spark, docs):
    want = brute.components(docs)
    for limit in (4096, 2):
        assert rows(simhash.simhash_dedup(frame(spark, docs), bucket_limit=limit), "fingerprint", "component_id") == want
    assert simhash.simhash_dedup(empty(spark)).count() == 0
    kept = simhash.keep_one(frame(spark, docs))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    groups = [want[r["doc_id"]][1] for r in kept.collect()]
    assert sorted(groups) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("limit", [4096, 3])
def test_simhash_links_dense_ball(spark, limit):
    """Thousands of links in few buckets, by forest and by hubs, against all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    arr = np.array(sorted(fps), np.uint64)
    parent = list(range(len(arr)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            parent[find(i)] = find(int(j))
    signed = arr.view(np.int64).tolist()
    got = {r["node"]: r["root"] for r in connected_components(simhash.simhash_links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)).collect()}
    by_root, want = {}, {}
    for k, x in enumerate(signed):
        by_root.setdefault(got.get(x, x), set()).add(x)
        want.setdefault(find(k), set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_components_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(41)}) == 1 and got[200] == got[201] and got[200] != got[0] and 100 not in got


def test_language(spark, docs):
    rng = random.Random(2)
    vocab = {"en": "the house of stone and water".split(), "de": "der stein und das wasser über".split()}
    train = [(i, " ".join(rng.choices(vocab[k], k=30)), k) for i, k in enumerate(["en", "de"] * 60)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.fit(df)
    out = language.identify(df.withColumn("score", df.lang), model).filter(language.held_out(F.col("doc_id"))).collect()
    assert out and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in out)
    assert model.predict("") == ("und", 0.0, []) and model.predict("12 !?")[0] == "und"
    both = model.predict(" ".join(rng.choices(vocab["en"], k=80) + rng.choices(vocab["de"], k=40)))
    assert both[0] == "en" and set(both[2]) == {"en", "de"} and 0.5 < both[1] < 0.9
    assert {r["lang_pred"] for r in language.identify(frame(spark, docs), language.fit(empty(spark))).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0


def test_html(spark):
    model = html_extract.trained()
    page = "<html><body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>Title of it</h1><p>Some  text &amp; more&#33;<br>And a line.<p>Second one.</article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, "", "z"), (4, "<!-- <p>no", "w")], "page_id long, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(df, model=model).collect()}
    assert got == {1: "Title of it\nSome text & more! And a line.\nSecond one.", 2: "", 3: "", 4: ""}
    right = total = 0
    for source in html_extract.labelled_pages(120, seed=1234):
        tree, y = html_extract.parse(source), []
        for n in tree:
            y.append(n.label if n.label is not None else (y[n.parent] if n.parent >= 0 else 0))
        right += model.texts([source])[0] == "\n".join(n.text for k, n in enumerate(tree) if n.text is not None and y[k])
        total += 1
    assert right / total > 0.85


def test_marginals_match_enumeration():
    tree = html_extract.parse("<div><p>a b</p><ul><li>c</li></ul></div>")
    names, kinds = {}, {"other": 0}
    forest = html_extract.Forest([tree], names, kinds, grow=True)
    rng = np.random.default_rng(0)
    unary, edge = rng.normal(size=len(tree)), rng.normal(size=(len(kinds), 2, 2))
    total, mass = 0.0, np.zeros(len(tree))
    for code in range(1 << len(tree)):
        y = [(code >> k) & 1 for k in range(len(tree))]
        score = sum(unary[k] * y[k] for k in range(len(tree))) + sum(edge[forest.kind[k], y[n.parent], y[k]] for k, n in enumerate(tree) if n.parent >= 0)
        total += np.exp(score)
        mass += np.exp(score) * np.array(y)
    assert np.allclose(forest.marginals(unary, edge)[0], mass / total)


def test_token_counts(spark, docs):
    for table in (20_000, 3):
        assert rows(token_counts.token_counts(frame(spark, docs), table_words=table), "n_bytes", "n_tokens", "over_limit") == brute.token_counts(docs)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_packing(spark, docs):
    ids = brute.byte_ids(docs)
    got = packing.pack_documents(frame(spark, docs), with_ids=True, group_pieces=40).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, v in ids.items():
        own = sorted(pieces.pop(k), key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == v
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
        assert all(r["length"] == 2048 for r in own[1:])
    assert not pieces
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(spark)).count() == 0


def test_best_two_fit_is_tight():
    rng = random.Random(4)
    lengths = [rng.randint(1, 2047) for _ in range(3000)]
    bins = packing.best_two_fit(np.bincount(lengths, minlength=2049), 2048)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 2048 for b in bins)
    assert len(bins) <= 1.01 * max(sum(lengths) / 2048, sum(x > 1024 for x in lengths))
    # greedy takes 6 and 3, leaving 1; the pair 2 + 2 fits the gap of 4 left by the 3
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)[0] == [6, 2, 2]


def test_bpe(spark, docs):
    df = frame(spark, docs)
    want = brute.word_round_trip(docs)
    assert rows(bpe.bpe_round_trip(df), "n_tokens", "ids_sha256", "decoded_sha256") == want
    encoded = bpe.bpe_encode(df)
    assert {r["doc_id"]: len(r["ids"]) for r in encoded.collect()} == {k: v[0] for k, v in want.items()}
    assert {r["doc_id"]: brute.sha(r["text"]) for r in bpe.bpe_decode(encoded).collect()} == {k: v[2] for k, v in want.items()}
    assert bpe.bpe_round_trip(empty(spark)).count() == 0


def test_spotsigs(spark, docs):
    df = frame(spark, docs)
    got = spotsigs.edited_pairs(df)
    assert {r["doc_id"]: (r["n_chars"], brute.sha(r["edited_text"])) for r in got.collect()} == brute.edited(docs)
    many = [(i * 7, f"the stone {i} of a river and tree {i % 5}") for i in range(900)] + [(None, "no id here"), (14, "twice")]
    out = spotsigs.edited_pairs(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert len(out) == len(many)
    unique = [(i, t) for i, t in many if i is not None and i != 14]
    one = {r["doc_id"]: (r["n_chars"], brute.sha(r["edited_text"])) for r in spotsigs.edited_pairs(spark.createDataFrame(unique, "doc_id long, text string")).collect()}
    assert one == brute.edited(unique)
    assert spotsigs.edited_pairs(empty(spark)).count() == 0
    single = spotsigs.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert single["edited_text"] == "abcdab" and single["near_next"] == 1.0


def test_spotsigs_pairs(spark, docs):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["the", "of", "is", "to"]) if rng.random() < 0.3 else f"w{rng.randint(0, 400)}" for _ in range(120)) for _ in range(8)]
    texts = [(i, base[i % 8] if i < 16 else base[i % 8].replace(base[i % 8].split()[i % 90 + 5], "changed", 1)) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {r["doc_id"]: frozenset(r["signatures"]) for r in spotsigs.fingerprints(df).collect()}
    pairs, members = spotsigs.near_pairs(df)
    cls = {r["doc_id"]: r["class_id"] for r in members.collect()}
    got = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    want = {frozenset((cls[i], cls[j])) for i in sets for j in sets if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == want and want
    assert all((sets[i] == sets[j]) == (cls[i] == cls[j]) for i in sets for j in sets)


def test_mphash():
    rng = np.random.default_rng(1)
    lo, hi = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    mph = mphash.MinimalPerfectHash.build(lo, hi)
    assert sorted(mph.index(lo, hi).tolist()) == list(range(5000))
    again, arrays = mphash.MinimalPerfectHash.load(mph.dump(x=np.arange(3)))
    assert (again.index(lo, hi) == mph.index(lo, hi)).all() and arrays["x"].tolist() == [0, 1, 2]
    same = np.full(3, 5, np.uint64)
    assert sorted(mphash.MinimalPerfectHash.build(same, np.arange(3, dtype=np.uint64)).index(same, np.arange(3, dtype=np.uint64)).tolist()) == [0, 1, 2]


def test_lines(spark, docs):
    want = brute.line_dedup(docs)
    df = frame(spark, docs).drop("row")
    for options in ({}, {"broadcast_limit": 0}, {"shard_keys": 1, "broadcast_limit": 0}, {"shard_keys": 1}):
        got = line_dedup.line_dedup(df.withColumnRenamed("kept", "n_lines"), **options)
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["kept_text"])) for r in got.collect()} == want
    assert any(w[1] for w in want.values())
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    same = [(5, "x" * 30), (5, "x" * 30), (None, "x" * 30), (1, "x" * 30)]
    out = line_dedup.line_dedup(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in out) == [(-1, 1), (1, 1), (5, 0), (5, 0)]


def test_huffman():
    rng = np.random.default_rng(2)
    for counts in (np.array([0, 5, 0]), np.array([1 << k for k in range(30)]), rng.integers(0, 50, 3000)):
        lengths = token_store.code_lengths(counts)
        used = lengths[lengths > 0].astype(float)
        assert (lengths[counts > 0] > 0).all() and lengths.max() <= 16 and (2.0**-used).sum() <= 1
        ids = rng.choice(np.flatnonzero(counts), 1000)
        block = token_store.encode_block([3, 9], [400, 600], ids, token_store.canonical_codes(lengths), lengths)
        doc_ids, sizes, back = token_store.decode_block(block, token_store.decode_table(lengths))
        assert doc_ids.tolist() == [3, 9] and sizes.tolist() == [400, 600] and (back == ids).all()


def test_token_store(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 500)
    want = brute.token_store(docs)
    assert rows(token_store.token_round_trip(frame(spark, docs)), "start", "n_tokens", "ids_crc32") == want
    token_store.write_tokens(frame(spark, docs), f"file://{tmp_path}/store", part_tokens=2000)
    back = token_store.read_tokens(spark, f"file://{tmp_path}/store")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back.collect()} == want
    assert token_store.token_round_trip(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices("the stone river house of tree water and".split(), k=60)), "en", "s", 0) for i in range(30)]
    texts += [(30, texts[2][1] + " extra", "en", "s", 0), (31, None, None, None, None), (32, "123 456", "en", "s", 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = dict([(i, t) for i, t, *_ in texts if t and any(c.isalpha() for c in t)])
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, corpus_pipeline.language_id(spark, df, ""), "").collect()}
    assert lines.keys() == kept.keys()
    groups = brute.components(list(lines.items()))
    best = {}
    for i, t in lines.items():
        best[groups[i][1]] = max(best.get(groups[i][1], (0, -1)), (len(t), i))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r["doc_id"] for r in out.collect()} == {i for _, i in best.values()}
