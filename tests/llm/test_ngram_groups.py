"""The n-gram join on large groups of near copies, whose members lie on both sides of the threshold."""

import re

import numpy as np
import pytest

from postflow.llm import ngram_join

from . import brute


def near_copies(n, seed=11):
    """Copies of three texts with 1 to 5 changed words, a line that all share, and texts that only share the line."""
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(r.choice(words, 12))
    bases = [list(r.choice(words, k)) for k in (90, 120, 150)]
    rows = []
    for i in range(n):
        w = list(bases[int(r.integers(0, 3))]) if i % 5 else list(r.choice(words, 60))
        for at in r.integers(0, len(w), int(r.integers(1, 6))):
            w[at] = words[int(r.integers(0, 400))] if i % 3 else words[at % 7]
        rows.append((i, " ".join([*w, line] if i % 2 else [line, *w])))
    return rows


def linked(rows, size, percent):
    """Components by the whole matrix of intersections."""
    ids, sets = {}, []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({ids.setdefault(tuple(w[k : k + size]), len(ids)) for k in range(len(w) - size + 1)})
    x = np.zeros((len(rows), len(ids)), np.float32)
    for i, own in enumerate(sets):
        x[i, list(own)] = 1
    both, n = (x @ x.T).astype(int), x.sum(1).astype(int)
    i, j = np.nonzero(100 * both >= percent * (n[:, None] + n - both))
    comp = brute.components([k for k, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(i, j, strict=True) if a < b])
    return sorted((k, int(m), comp[k]) for (k, _), m in zip(rows, n, strict=True))


@pytest.mark.parametrize(("n", "tile"), [(700, 4000), (2000, ngram_join.TILE)])
def test_large_groups(spark, n, tile):
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = linked(rows, 4, 85)
    assert 20 < len({c for _, _, c in want}) < n - 100
    assert sorted(map(tuple, ngram_join.join(docs, 4, 85, tile=tile).collect())) == want


@pytest.mark.parametrize("leaf", [8, 1000])
def test_region_in_cells_and_blocks(monkeypatch, leaf):
    monkeypatch.setattr(ngram_join, "ROWS", 16)
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    r = np.random.default_rng(2)
    tokens = [np.unique(r.integers(0, 60, int(r.integers(1, 50)))).astype(np.uint64) for _ in range(120)]
    n = np.array([len(t) for t in tokens])
    links = ngram_join.forest(np.arange(120), np.arange(120), n, tokens, 60)
    sets = [set(t.tolist()) for t in tokens]
    want = [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
    assert brute.components(range(120), links) == brute.components(range(120), want) and len(links) < 120


def test_cells_part_a_region_and_lose_no_link(monkeypatch):
    """Forty families of near copies, told apart by pivots: windows copy few classes, and every link lies inside a cell."""
    r = np.random.default_rng(5)
    sets = []
    for f in range(40):
        base = set((1000 * f + np.arange(60)).tolist()) | set(range(-20, 0))
        for _ in range(12):
            own = set(base)
            for k in r.choice(60, int(r.integers(0, 9)), replace=False):
                own.discard(1000 * f + int(k))
            sets.append(own)
    tokens = [np.sort(np.array(list(x), np.int64).astype(np.uint64)) for x in sets]
    n = np.array([len(t) for t in tokens])
    far = ngram_join.jaccard_distances(tokens, n, tokens[:96:6], n[:96:6])
    assert np.allclose(far[5, 1], 1 - len(sets[5] & sets[6]) / len(sets[5] | sets[6]))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    held = [set(c.tolist()) for c in ngram_join.cells(far, 80)]
    assert all(any(i in c and j in c for c in held) for i, j in near) and max(map(len, held)) < len(sets)
    compared = []
    plain = ngram_join.between
    monkeypatch.setattr(ngram_join, "between", lambda own, *a: compared.append(len(own)) or plain(own, *a))
    links = ngram_join.forest(np.arange(len(sets)), np.arange(len(sets)), n, tokens, 80)
    assert brute.components(range(len(sets)), links) == brute.components(range(len(sets)), near)
    assert len(compared) > 5 and sum(x * x for x in compared) < len(sets) ** 2 / 2
