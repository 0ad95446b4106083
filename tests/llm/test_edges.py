"""Repeats, ties, odd names, wide vocabularies, and the driver's own tables: what the plain tests of the operators leave out."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import bpe, chunks, common, contracts, html_extract, language, line_dedup, packing, simhash, spotsigs, token_counts, token_store
from tests.llm import brute

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REPEATS = [(1, "the house of stone"), (1, "the house of stone"), (1, "a river"), (None, "the house of stone"), (None, None), (2, "x" * 30000), (3, "word\n" * 3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "n": F.lit(1)})


def test_repeated_rows_of_counts_and_ids(spark):
    df = frame(spark, REPEATS)
    key = lambda r: (r[0] is not None, r)
    counts = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df).collect()), key=key)
    assert counts == sorted(((i, *brute.token_counts([(0, t)])[0][:2]) for i, t in REPEATS), key=key)
    trips = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_round_trip(df).collect()), key=key)
    assert trips == sorted(((i, *brute.word_round_trip([(0, t)])[0]) for i, t in REPEATS), key=key)
    stored = token_store.token_round_trip(df).orderBy("start").collect()
    assert [r["start"] for r in stored] == np.cumsum([0] + [r["n_tokens"] for r in stored])[:-1].tolist()
    assert [r["doc_id"] for r in stored] == [None, None, 1, 1, 1, 2, 3]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stored), key=key) == sorted(((i, *brute.token_store([(0, t)])[0][1:]) for i, t in REPEATS), key=key)


def test_repeated_rows_of_packing(spark):
    packed = packing.pack_documents(frame(spark, REPEATS), with_ids=True).collect()
    whole = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at, _ = whole.get(r["sequence_id"], (0, 0))
        assert r["offset"] == at and at + r["length"] <= 2048
        whole[r["sequence_id"]] = (at + r["length"], 0)
    assert sorted(r["length"] for r in packed if r["piece"] == 0) == sorted((len(x) - 1) % 2048 + 1 for i, t in REPEATS for x in [brute.byte_ids([(0, t)])[0]])


def best_two_fit(lengths, capacity):
    """Greedy, always the longest that fits, then one replacement of the smallest by the fullest pair; over a plain list."""
    left, bins = sorted(lengths), []
    while left:
        content = []
        while fits := [x for x in left if x <= capacity - sum(content)]:
            content.append(fits[-1])
            left.remove(fits[-1])
        if sum(content) < capacity:
            small = min(content)
            room, pool = capacity - sum(content) + small, sorted([*left, small])
            best = max(((a + b, a, b) for i, a in enumerate(pool) for b in pool[:i] if a + b <= room), default=(0, 0, 0), key=lambda x: x[0])
            if best[0] > small:
                content.remove(small)
                left.append(small)
                for x in best[1:]:
                    left.remove(x)
                    content.append(x)
                left.sort()
        bins.append(content)
    return bins


def test_packer_equals_a_plain_one():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 60, 40).tolist()
        got = packing.best_two_fit(np.bincount(lengths, minlength=65), 64)
        assert sorted(x for b in got for x in b) == sorted(lengths)
        assert [sum(b) for b in got] == [sum(b) for b in best_two_fit(lengths, 64)]


def test_lines_count_documents_not_rows(spark):
    line = "L" * 30
    for limit in (1 << 20, 0):
        twice = line_dedup.line_dedup(frame(spark, [(5, line), (5, line), (1, line)]), broadcast_limit=limit).collect()
        assert [r["n_dropped"] for r in twice] == [0, 0, 0]
        thrice = line_dedup.line_dedup(frame(spark, [(5, line), (5, line), (1, line), (2, "x\n" + line)]), broadcast_limit=limit).collect()
        assert sorted((r["doc_id"], r["n_dropped"], r["kept_text"]) for r in thrice) == [(1, 1, ""), (2, 1, "x"), (5, 0, line), (5, 0, line)]


def test_sharded_probe_moves_no_text(spark):
    rows = [(i, "\n".join([f"a line of document {i % 50} that comes again"] * 3 + ["t" * 50])) for i in range(400)]
    df = frame(spark, rows).repartition(3)
    plan = line_dedup.line_dedup(df, broadcast_limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    want = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.line_dedup(df).collect()}
    assert {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.line_dedup(df, broadcast_limit=0).collect()} == want


def test_chunks_of_many_lines(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 7)
    rows = [(i, "\n".join(f"shared line number {k} of all documents" for k in range(i % 12))) for i in range(40)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["kept_text"])) for r in line_dedup.line_dedup(frame(spark, rows), broadcast_limit=0).collect()}
    assert got == brute.line_dedup(rows)


def test_keep_one_passes_any_column(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, 8, "z"), (2, "a b c d", 9, 10, "y"), (None, None, 1, 1, "x")], "doc_id long, text string, simhash_row long, simhash_fp long, `words` string")
    assert sorted(simhash.keep_one(df).collect(), key=str) == sorted([r for r in df.collect() if r["doc_id"] != 1], key=str)


def test_intermediate_tables_go(spark):
    sweep, tables = common.Sweep(spark), spark.catalog.listTables()
    out = common.materialise(simhash.keep_one(frame(spark, [(1, "a b c"), (2, "a b c"), (3, "d e f")])), "kept")
    sweep(out)
    assert {p for p in common._WRITTEN if p not in sweep.before} == {out._written_at} and out.count() == 2
    assert len(spark.catalog.listTables()) == len(tables)
    common.discard(out)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch(Session())


def test_wide_vocabulary():
    rng = np.random.default_rng(4)
    for vocab in (70_000, 100_000, 300_000):
        counts = rng.integers(1, 1000, vocab)
        lengths = token_store.code_lengths(counts)
        used = lengths.astype(float)
        assert lengths.min() > 0 and 16 < lengths.max() <= (vocab - 1).bit_length() + 1 and (2.0**-used).sum() <= 1
        ids = np.concatenate([np.arange(vocab), rng.integers(0, vocab, 777)])
        block = token_store.encode_block([1], [len(ids)], ids, token_store.canonical_codes(lengths), lengths)
        assert (token_store.decode_block(block, token_store.decode_table(lengths))[2] == ids).all()


def test_spotsigs_every_column(spark):
    rng = np.random.default_rng(8)
    words = ["The", "of", "house", "tree", "Éclair", "stone", "and", "river", "x1", "don't", "日本", "a", "кошка"]
    docs = [(i * 3, " ".join(rng.choice(words, rng.integers(1, 80)))) for i in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "the of and"), (1003, "!!!"), (1004, docs[5][1]), (1 << 62, "far away " * 900)]
    for per in (250, 7):
        near = spotsigs.in_next_order(frame(spark, docs), "doc_id", "text", per_bucket=per)
        sizes = [r["count"] for r in near.groupBy("bucket").count().collect()]
        assert max(sizes) <= 2 * per + 2
    got = spotsigs.edited_pairs(frame(spark, docs))
    got = got.withColumns({"f": spotsigs.as_string(F.col("signatures")), "e": spotsigs.as_string(F.col("edited_signatures"))})
    have = {r["doc_id"]: tuple(r[c] for c in ("f", "e", "near_edited", "near_next", "copy_edited", "copy_next")) for r in got.collect()}
    assert have == brute.spots(docs, set(spotsigs.ANCHORS))


def test_languages_of_the_documents(spark):
    """Held-out accuracy over the driver's documents, and a very long text under that model."""
    got = contracts.op3_language_id(spark, DATA).join(common.documents(spark, DATA).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_stray_labels_stop_nothing(spark):
    rows = [(i, f"word{i % 7} and text", f"label{i}") for i in range(700)] + [(1000 + i, "der stein und das wasser", "de") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=20)
    assert len(model.languages) == 20 and model.predict("das wasser und der stein " * 5000)[0] == "de"


def test_main_text_of_the_pages(spark):
    """The driver's pages hold their main text in an article element: its blocks, taken plainly."""

    def plain(page):
        body = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|header|footer|figure|table|tr|td)\b[^>]*>", body[1]) if body else []
        texts = [" ".join(html_extract_unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks]
        return "\n".join(t for t in texts if t)

    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    model = html_extract.trained()
    same = [model.texts([r["html"] or ""])[0] == plain(r["html"]) for r in rows]
    assert sum(same) >= 0.95 * len(same)


def html_extract_unescape(text):
    import html

    return html.unescape(text)


def test_long_and_repeated_pages(spark):
    page = "<article>" + "<p>One sentence here. And another one.</p>" * 4000 + "</article>"
    df = spark.createDataFrame([(1, page), (1, page), (2, "<p>")], "page_id long, html string")
    got = sorted((r["page_id"], len(r["main_text"].split("\n"))) for r in html_extract.extract(df).collect())
    assert got == [(1, 4000), (1, 4000), (2, 1)] and html_extract.extract(df.limit(0)).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
