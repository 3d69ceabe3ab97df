"""Parts of a batch that kernels see at once."""

import pyarrow as pa

from postflow.llm.kernels import slices


def test_slices_stay_under_a_megabyte_and_lose_no_row():
    texts = ["x" * 1000] * 3000 + ["y" * 3_000_000, None, ""]
    parts = list(slices(pa.RecordBatch.from_pydict({"text": pa.array(texts)}), "text"))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20 for p in parts)


def test_divergence_counts_a_large_batch_in_bounded_memory():
    """Batches of 16 MB once took 3,000 MB of an executor; counts are those of the batch as a whole."""
    import tracemalloc
    from collections import Counter

    from postflow.llm import source_divergence

    words = [f"w{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuvwxyz"]
    texts = [" ".join(words[(7 * i + j * j) % len(words)] for j in range(400)) for i in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "source": [f"s{i % 3}" for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    found = list(source_divergence.counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n, docs = Counter(), Counter()
    for x in found:
        for r in x.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert sum(n.values()) == 4_000_000 and len(n) <= 3 * 26 * 14
    for i in (0, 1, 2):
        got = Counter(w.translate(str.maketrans("", "", "0123456789")) for t in texts[i::3] for w in t.split())
        assert {k[1]: v for k, v in n.items() if k[0] == f"s{i}"} == got
        assert {k[1]: v for k, v in docs.items() if k[0] == f"s{i}"} == Counter(w for t in texts[i::3] for w in set(t.split()))
    assert sum(x.num_rows for x in found) == len(n) and peak < 80 << 20
