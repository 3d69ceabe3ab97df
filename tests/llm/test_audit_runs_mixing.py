"""Source divergence, periodic runs and mixing against plain versions, SQL and odd tables."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.llm import periodic_runs, source_divergence, source_mixing
from postflow.llm.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
R = np.random.default_rng(11)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, value in tables.items():
        con.register(name, value) if not isinstance(value, str) else con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{value}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_mixing_sources"])
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, D)) == by_sql(ORACLE[name], documents=f"{D}/documents.parquet")


TEXTS = ["a b a É ab", "A b", None, "", "a b zz" + "\x00é", "ab-ab AB Ébc 東京 b", "a " * 50, "one two"]


def odd(spark, n=120):
    """Null and repeated ids, texts, langs and sources, equal rows, and columns with names that operators use."""
    pick = lambda xs: xs[int(R.integers(len(xs)))]
    rows = [(pick([None, 1, 2, 3, 50]), pick(TEXTS), pick([None, "", "en", "de"]), pick([None, "", "a", "b", "ß", "Z"]), "x", 1, 2.5, 7) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string, source string, item string, n int, rank double, row int").repartition(3)


def test_divergence_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "PAIRS", 7)
    docs = odd(spark)
    found = rows_of(source_divergence.audit(docs))
    assert len(found) > 100 and found == by_sql(source_divergence.SQL, documents=docs.toPandas())
    assert {r[2] for r in found} == {"pair", "term"}
    assert source_divergence.audit(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b", None, None)], "doc_id bigint, text string, lang string, source string")
    assert source_divergence.audit(alone).count() == 0


def test_divergence_cuts_ties_in_order_of_bytes(spark):
    words = [f"{a}{b}" for a in ("z", "é", "東", "m") for b in "abcdefgh"]
    rows = [(" ".join(words), "en", "s") for _ in range(3)] + [("common words only here", "en", "t")] * 40
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [(r["item"], r["rank"]) for r in source_divergence.audit(df, top=5).where("part = 'term' and source = 's'").orderBy("rank").collect()]
    assert got == [(w, k + 1) for k, w in enumerate(sorted(words, key=str.encode)[:5])]


def test_letters():
    buf = np.frombuffer("Aé_bZ 9東".encode(), np.uint8)
    found, row = source_divergence.terms(buf, np.array([0, len(buf)]))
    assert found.to_pylist() == ["aé", "bz", "東"] and row.tolist() == [0, 0, 0]


def plain_runs(words):
    """All maximal runs (start, end, period), period by period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def sample():
    n, kind = int(R.integers(0, 300)), int(R.integers(0, 4))
    if kind == 0:
        return R.integers(0, 2, n)
    if kind == 1:
        return np.resize(R.integers(0, 3, int(R.integers(1, max(2, n // 3 + 1)))), n)
    if kind == 2:  # runs inside runs
        w = np.resize(np.r_[np.resize(R.integers(0, 4, int(R.integers(1, 4))), int(R.integers(1, 40))), 9], n)
        w[R.integers(0, max(n, 1), int(n > 0))] = 11
        return w
    w = R.integers(0, 30, n)
    for p in R.integers(1, 40, 3):
        s = int(R.integers(0, n + 1))
        w[s : s + 6 * p] = np.resize(R.integers(0, 20, p), len(w[s : s + 6 * p]))
    return w


def test_all_runs_are_found():
    many = 0
    for _ in range(300):
        docs = [sample() for _ in range(4)]
        offs = np.cumsum([0, *map(len, docs)])
        want = [(s + o, e + o, q) for d, o in zip(docs, offs, strict=False) for s, e, q in plain_runs(d.tolist())]
        got = sorted(map(tuple, periodic_runs.find_runs(np.concatenate(docs).astype(np.int32), offs).tolist()))
        assert got == sorted(want)
        many += sum(q >= periodic_runs.DIRECT for _, _, q in want)
    assert many > 300


def test_sets_are_sparse_in_periodic_regions():
    """Where a smaller scale has found a region, the set has no places; elsewhere it has one in t."""
    codes = np.r_[R.integers(0, 9, 1000), np.resize([1, 2], 5000), R.integers(0, 9, 1000)]
    ids = codes.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        ids = periodic_runs.mix64(ids * np.uint64(0x9E3779B97F4A7C15) + np.r_[ids[step:], np.zeros(step, np.uint64)])
    t, n = 64, len(codes)
    left = n - np.arange(n)
    blocked = left < t
    blocked[1001 : 6000 - t] = True
    place = periodic_runs.synchronising(ids, blocked, left, t)
    inner = place[(place > 1100) & (place < 5800)]
    assert len(inner) == 0 and len(place[place < 900]) >= 900 // t and len(place) < 250


def plain_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    told = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, D).select(*COLUMNS).collect())
    assert got == sorted(plain_row(*r) for r in docs) and sum(r[1] > 0 for r in got) > 10


def test_periodic_runs_on_odd_tables(spark):
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    rows = [(None, "a b " * 9), (None, None), (3, " x\ty\n" * 5), (3, "é " * 6), (3, "é " * 6), (4, ""), (5, "\x0b\x0c "), (6, long)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, plant string, start int").repartition(2)
    found = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(df).collect()}
    first = " ".join(f"w{i}" for i in range(997))
    assert found == {(None, "a b"): [(0, 18, 2)], (None, ""): [], (3, "x y"): [(0, 10, 2)], (3, "é"): [(0, 6, 1)], (4, ""): [], (5, ""): [], (6, first): [(0, 300_000, 997)]}
    assert periodic_runs.periodic_runs(df).count() == 8 and periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_ties_between_runs():
    runs = np.array([[0, 8, 2], [10, 14, 1], [20, 32, 3]])
    assert periodic_runs.best_of(runs) == 0 and periodic_runs.best_of(runs[::-1]) == 2
    assert periodic_runs.best_of(np.array([[0, 10**9, 3], [5, 10**9 + 6, 3]])) == 1


def test_mixing_on_odd_tables(spark):
    docs = odd(spark)
    found = source_mixing.mix(docs)
    again = source_mixing.mix(docs.repartition(5, "rank", "text"))
    assert rows_of(found) == rows_of(again) and found.count() == 125
    rows = found.collect()
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    assert sum(t for _, t in {(r["source"], r["target"]) for r in rows}) == pytest.approx(sum(r["size"] for r in rows))
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 3 * own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) + 1e-6
    assert source_mixing.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in source_mixing.mix(empty).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_the_mix_is_documents_as_often_as_taken(spark):
    docs = odd(spark).withColumn("mark", F.monotonically_increasing_id())
    mixed = source_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[(r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")))] += 1
    for r in source_mixing.mix(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    assert got == +want


def test_full_sources_pass_on_their_excess(spark):
    """a and d weigh 1, b 2, c 3; by weight alone c would have 515 words, but it has only 10."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (10, "b"), (10, "c"), (10, "d")])]
    got = {r["source"]: r["target"] for r in source_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {"a": 940.0, "b": 30.0, "c": 30.0, "d": 30.0}
