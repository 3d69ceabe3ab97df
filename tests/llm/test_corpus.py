"""Corpus operators against plain versions, with the odd rows that tables hold."""

import numpy as np
import pytest

from postflow.llm import embedding_dedup, license_scan, ngram_join, packing, quality_rules, sentencepiece_codec, span_dedup, suffix_dedup, toxicity, url_filter

from postflow.operators.storage import saved

from . import brute

WORDS = "the of and red plate ring small hot bolt gear widget anvil gizmo rod".split()


def corpus(seed=3, n=60):
    """Random texts with copies, near copies and shared passages, and odd rows."""
    r = np.random.default_rng(seed)
    say = lambda k: " ".join(r.choice(WORDS, k)) + "."
    passage = say(30)
    rows = []
    for i in range(n):
        t = " ".join(say(int(r.integers(3, 20))) for _ in range(int(r.integers(1, 8))))
        if i > 5 and r.random() < 0.4:
            t = rows[int(r.integers(0, i))][1]
            if r.random() < 0.6:
                w = t.split(" ")
                w[int(r.integers(0, len(w)))] = "changed"
                t = " ".join(w)
        if r.random() < 0.3:
            t += " " + passage
        rows.append((i, t))
    odd = [None, "", "   \n\t ", "word", "é" * 60, "x" * 5000, "a\nb\n\na\nb", "the " * 300]
    return rows + [(n + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark):
    """With a clashing extra column."""
    return spark.createDataFrame([(i, t, i, "pid") for i, t in corpus()], "doc_id bigint, text string, n bigint, pid string").repartition(3)


EMPTY = "doc_id bigint, text string"


def test_suffix_dedup(spark, docs):
    from pyspark.sql import functions as F

    found = suffix_dedup.dedup(docs).select("doc_id", "n_bytes", F.size("spans"), F.sha2("kept", 256))
    want = [(i, n, spans, sha) for i, n, _, spans, sha in brute.suffix_dedup(corpus())]
    assert sorted(map(tuple, found.collect())) == want
    assert suffix_dedup.dedup(spark.createDataFrame([], EMPTY)).count() == 0


def test_suffix_dedup_with_hot_keys(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    from pyspark.sql import functions as F

    found = suffix_dedup.dedup(docs).select("doc_id", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect())) == [(x[0], x[4]) for x in brute.suffix_dedup(corpus())]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, size, percent):
    assert sorted(map(tuple, ngram_join.join(docs, size, percent).collect())) == brute.ngram_join(corpus(), size, percent)


def test_ngram_join_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], EMPTY)).count() == 0
    rows = ngram_join.join(spark.createDataFrame([(None, "a b c d e f"), (1, None)], EMPTY)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in rows) == [(0, 2), (1, 0)]


def test_packing(docs):
    found = packing.pack(saved(packing.pieces(docs, max_len=64)), 64).toPandas().sort_values(["sequence_id", "offset"])
    end = found.offset + found.length
    same = found.sequence_id.eq(found.sequence_id.shift())
    assert (end <= 64).all() and (found.offset[~same] == 0).all() and (found.offset[same] == end.shift()[same]).all()
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 64) + 2
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in corpus():
        own = found[found.doc_id == i].sort_values("piece")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist()
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def first_fit(lengths, room):
    left = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(left) if r >= x), None)
        if at is None:
            left.append(room - x)
        else:
            left[at] -= x
    return len(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_beats_first_fit(seed):
    """Lengths of about half a bin are the hard ones."""
    lengths = np.random.default_rng(seed).integers(1, 100, 500)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    slots = packing.plan(histogram, 100)
    assert slots["sequence"].max() < first_fit(lengths.tolist(), 100)


def test_sentencepiece(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    found = sentencepiece_codec.encode(docs)
    text = dict(corpus())
    for r in found.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == sp.encode(text[r["doc_id"]] or "")
        assert r["parity"] and r["round_trip"]
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(found).collect()} == {i: t or "" for i, t in corpus()}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    r = np.random.default_rng(1)
    rows = []
    for i in range(120):
        v = r.normal(size=16)
        if i > 20 and r.random() < 0.6:
            v = np.array(rows[int(r.integers(0, i))][1]) + (r.normal(size=16) * 0.25 if r.random() < 0.7 else 0)
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0] * 16, None), (305, [1.0] * 5, 1), (306, [2.0] * 5, 1), (307, [1.0, None] + [1.0] * 14, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    assert sorted(map(tuple, embedding_dedup.near_dedup(df).collect())) == brute.embedding_dedup(rows)
    assert embedding_dedup.near_dedup(df.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/1?x"), (2, "http://a.example.com/en/2"), (3, "http://b.net/es/"), (4, "ftp://x.org#f"), (5, None), (6, "no scheme"), (7, "http://com/x"), (8, "http://net?es/")]
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[3] == ("b.net", "/es/", "net/es/", "block")
    assert [got[i][:3] for i in (4, 5, 6, 7, 8)] == [("x.org", "", None), ("", "", None), ("", "", None), ("com", "/x", "com/", ), ("net", "", None)]


def test_span_dedup(spark):
    rows = [(1, "One two three four five. Six seven eight nine ten. End."), (2, "Start here. One two three four five. Six seven eight nine ten. Other."), (3, None), (4, "One two three four five.  six Seven eight nine ten.")]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["kept"]) for r in span_dedup.dedup(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == {1: (3, 0, rows[0][1]), 2: (4, 2, "Start here. Other."), 3: (0, 0, ""), 4: (2, 2, "")}


def test_licenses(spark):
    rows = [(1, "Words first. Released under the MIT License. And more."), (2, None), (3, "Licensed under CC BY-NC 4.0."), (4, "licensed under the sun"), (5, license_scan.TEMPLATES["Apache-2.0 (notice)"].replace("express", "any"))]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == {1: "MIT", 2: None, 3: "CC-BY-NC-4.0 (short)", 4: None, 5: "Apache-2.0 (notice)"}


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    rows = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    text = dict(corpus())
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r)[1:6] == brute.quality_counts(text[r["doc_id"]])
    flat = quality_rules.train(docs, labels.limit(0))
    assert quality_rules.keep(docs, flat).columns == docs.columns


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    found = toxicity.op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    n, hit, right = found.agg(F.count("*"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * F.col("toxic")) / F.sum("toxic")).first()
    assert n > 500 and hit / n > 0.95 and right > 0.8
    empty = spark.createDataFrame([(1, None), (None, "")], EMPTY)
    assert [r["score"] < 0.5 for r in toxicity.score(empty, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)).collect()] == [True, True]


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) and rows.groupby("sequence_id").length.sum().max() <= 4096
