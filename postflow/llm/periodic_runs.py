r"""Periodic run detection with string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that cannot be extended keeping q. They
are found scale by scale, over all documents of a slice at once:

* Periods under 8 are detected apart from the sets, by comparing the words with themselves q places on.
* At scale t = 8, 16, 32, ... each window of t words has a fingerprint. A place i is in the synchronising set if the smallest fingerprint
  among the windows that begin in [i, i + t] is that of i or of i + t. Windows of period t / 4 or less count for nothing there: they lie
  in the highly periodic regions that smaller scales have found (a window of that kind is four periods long, so it is part of a run), which
  keeps the set sparse. Whether i is in the set depends on its 2 t words only.
* In a run of period q in [t, 2 t), some place of the set lies among the first t, and the place q words on has the same context of 2 t
  words and is the next one with it. So next places with equal contexts propose all periods of [t, 2 t); proposals that overlap are one,
  and are extended word by word to both sides.

Words get exact codes in each slice; contexts are told apart by 64 bits. Documents never cross tasks and no text is shuffled; the
arrays of a slice grow with its words, a few dozen bytes each.

Defined cases: a null text has no words; a row is a document of its own, whatever its id, null or repeated; a text of any length is
read whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, U64, mix64, ranges, slices, spelled, utf8

LEAST, TIMES, DIRECT = 6, 4, 8
FOUND = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_MUL = U64(0x9E3779B97F4A7C15)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge[::2], edge[1::2]


def small_periods(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Runs (start, end, period) of periods under DIRECT; a stretch may appear with multiples of its period too."""
    found = []
    for q in range(1, min(DIRECT, len(codes))):
        a, b = stretches((codes[q:] == codes[:-q]) & (doc[q:] == doc[:-q]))
        long = b - a + q >= max(LEAST, TIMES * q)
        found.append(np.stack([a[long], b[long] + q, np.full(int(long.sum()), q)], 1))
    return found


def smallest(found: list[np.ndarray]) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and end."""
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def synchronising(ids: np.ndarray, blocked: np.ndarray, left: np.ndarray, t: int) -> np.ndarray:
    """The places of the set at scale t; ids are the windows' fingerprints, blocked those that count for nothing, left the words from a place to its document's end."""
    value = np.where(blocked, _NONE, ids)
    low, step = value, 1
    while step < t:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    near, far = value[: len(value) - t], value[t:]
    low = np.minimum(low[: len(far)], far)
    return np.flatnonzero((left[: len(far)] >= 2 * t) & (low != _NONE) & ((near == low) | (far == low)))


def agreeing(codes: np.ndarray, at: np.ndarray, shift: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
    """How many words from `at` on (sign 1) or before it (sign -1), `limit` at most, equal those `shift` places on."""
    count, live, width = np.zeros(len(at), np.int64), np.flatnonzero(limit > 0), 16
    while len(live):
        step = np.arange(width)[None, :]
        rel = count[live][:, None] + step
        inside = rel < limit[live][:, None]
        place = at[live][:, None] + (rel if sign > 0 else -1 - rel)
        place = np.where(inside, place, 0)
        same = inside & (codes[place] == codes[np.where(inside, place + shift[live][:, None], 0)])
        whole = same.all(1)
        count[live] += np.where(whole, width, np.argmin(same, 1))
        live, width = live[whole], min(2 * width, max(16, (1 << 20) // max(1, len(live))))
    return count


def proposals(place: np.ndarray, context: np.ndarray, doc: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [a, b) that equal those q words on, and q in [t, 2 t): from next places with equal contexts, overlapping ones merged."""
    order = np.argsort(context, kind="stable")
    i, j = place[order[:-1]], place[order[1:]]
    fit = (context[order[:-1]] == context[order[1:]]) & (doc[i] == doc[j]) & (j - i >= t) & (j - i < 2 * t)
    i, q = i[fit], (j - i)[fit]
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (i[1:] > i[:-1] + 2 * t) | (doc[i[1:]] != doc[i[:-1]])][: len(i)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(i)] - 1
    return i[first], i[last[: len(first)]] + 2 * t, q[first]


def find_runs(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of documents whose words are codes[offs[d]:offs[d + 1]], by start and end."""
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), size)
    found = small_periods(codes, doc)
    known = smallest(found)
    base = offs[:-1][doc]  # where the place's document begins in the slice
    left = offs[1:][doc] - np.arange(len(codes))
    ids = mix64(codes.astype(U64) + U64(1))
    width, t = 1, DIRECT
    longer = lambda x, n: mix64(x * _MUL + np.r_[x[n:], np.zeros(min(n, len(x)), U64)])
    with np.errstate(over="ignore"):
        while True:
            stay = size[doc] >= TIMES * t
            if not stay.any():
                return smallest([known])
            if not stay.all():
                codes, doc, base, left, ids = codes[stay], doc[stay], base[stay], left[stay], ids[stay]
            while width < t:
                ids, width = longer(ids, width), 2 * width
            begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            shift = np.zeros(len(size), np.int64)  # from places of the slice to places here
            shift[doc[begins]] = base[begins] - begins
            whose = np.searchsorted(offs, known[:, 0], "right") - 1
            inner = (known[:, 2] <= t // 4) & (known[:, 1] - known[:, 0] >= t) & (size[whose] >= TIMES * t)
            edge = np.zeros(len(doc) + 1, np.int32)
            np.add.at(edge, known[inner, 0] - shift[whose[inner]], 1)
            np.add.at(edge, known[inner, 1] - t + 1 - shift[whose[inner]], -1)
            place = synchronising(ids, (np.cumsum(edge[:-1]) > 0) | (left < t), left, t)
            a, b, q = proposals(place, longer(ids, t)[place], doc, t)
            near = b - a >= (TIMES - 1) * q - 2 * t
            a, b, q = a[near], b[near], q[near]
            home = doc[a]
            start, end = base[a] - shift[home], base[a] - shift[home] + size[home]
            a, b = a - agreeing(codes, a, q, a - start, -1), b + agreeing(codes, b, q, end - b - q, 1)
            long = b - a >= (TIMES - 1) * q
            moved = shift[home[long]]
            known = smallest([known, np.stack([a[long] + moved, b[long] + q[long] + moved, q[long]], 1)])
            t *= 2


def best_of(runs: np.ndarray) -> int:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    ratio = (runs[:, 1] - runs[:, 0]) / runs[:, 2]
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()
    return min(near, key=lambda k: (-Fraction(int(runs[k, 1] - runs[k, 0]), int(runs[k, 2])), runs[k, 0], runs[k, 2])) if len(near) > 1 else near[0]


def planted(hashes: list[int | None], offs: np.ndarray) -> np.ndarray:
    """For each word the place of the word that stands there once runs are planted: words from a on repeat the first p of them."""
    at = np.arange(offs[-1])
    for d, h in enumerate(hashes):
        n = int(offs[d + 1] - offs[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[offs[d] + a : offs[d + 1]] = offs[d] + a + np.arange(n - a) % p
    return at


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of each row with a space between them."""
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    lens = ends - starts
    upto = np.cumsum(lens + ~head)
    out = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint8)
    for i in range(0, len(row), 1 << 18):
        part = slice(i, i + (1 << 18))
        out[ranges((upto - lens)[part], lens[part])] = buf[ranges(starts[part], lens[part])]
    cut = np.r_[0, upto][np.searchsorted(row, np.arange(n + 1))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(cut), pa.py_buffer(out)]).cast(pa.string())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: Column | None = None) -> DataFrame:
    """One row for each document: n_runs, the best run, all runs by start and period, and the text without what runs repeat.

    `plant` is a hash for each row, from which runs are planted before detection (see `planted`); null leaves a row as it is.
    """

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                buf, bounds = utf8(part.column("text"))
                words, row, starts, ends = spelled(buf, bounds, ~SPACE[buf])
                offs = np.searchsorted(row, np.arange(n + 1))
                at = planted(part.column("plant").to_pylist(), offs)
                codes, starts, ends = words.dictionary_encode().indices.to_numpy()[at], starts[at], ends[at]
                runs = find_runs(codes, offs)
                whose = np.searchsorted(offs, runs[:, 0], "right") - 1
                runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                edge = np.zeros(len(codes) + 1, np.int32)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 1], -1)
                kept = np.cumsum(edge[:-1]) == 0
                cut = np.searchsorted(whose, np.arange(n + 1))
                own = runs - np.stack([offs[whose], offs[whose], np.zeros_like(whose)], 1)
                best = np.full((n, 3), -1)
                for d in np.unique(whose).tolist():
                    mine = own[cut[d] : cut[d + 1]]
                    best[d] = mine[best_of(mine)]
                start, length, period = best[:, 0], best[:, 1] - best[:, 0], best[:, 2]
                none = period < 0
                best_columns = [pa.array(x, pa.int64(), mask=none) for x in (start, length, period, 1000 * length // np.where(none, 1, period))]
                spans = pa.StructArray.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1] - own[:, 0]), pa.array(own[:, 2])], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)
                collapsed = joined(buf, starts[kept], ends[kept], row[kept], n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(cut), pa.int64()), *best_columns, lists, collapsed], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.lit(None) if plant is None else plant).cast("bigint").alias("plant"))
    return own.mapInArrow(detect, FOUND)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, plant=F.crc32(F.col("doc_id").cast("string")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    told = F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", told, F.sha2("collapsed", 256).alias("collapsed_sha256"))
