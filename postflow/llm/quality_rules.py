"""Quality rules: counts for each text, and a linear-chain CRF that marks its lines as content or boilerplate.

The lines with a word form a chain of two states. A line's score is a sum of weights, one for each of its binned features; a 2x2 table
scores neighbours. Viterbi decoding gives the marks, and the share of a text's bytes on content lines decides whether it stays.

The CRF is fitted on the driver to at most `max_docs` labelled documents (the ones whose id hashes lowest): all lines start with the
label of their document; then the lines of low-quality documents that the first fit takes for content are relabelled (as long as one
boilerplate line is left) and the CRF is fitted again. Only binned features come to the driver, never texts.

Defined cases: a null text has no words and fails; without labelled rows of both kinds every line is content; a null id stays null;
repeated rows, and rows with one id and other texts, are judged each by its own text; of equal paths the first in order counts;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored by `judge` and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix64, per_row, segment_hash, slices, utf8, words

#: Upper ends of the feature bins. Fixed values of this operator.
BINS = (
    np.array([1, 3, 8, 20, 60]),  # words
    np.array([0.0, 0.05, 0.2, 0.5, 1.0]),  # symbols a word
    np.array([0.02, 0.1, 0.3, 0.6]),  # upper case among ASCII letters
    np.array([0.0, 0.1, 0.5]),  # exclamation marks a word
    np.array([0.0, 0.05, 0.3]),  # bars a word
    np.array([2.0, 3.5, 5.0, 7.0, 10.0, 15.0]),  # bytes a word
    np.array([0.0, 0.1, 0.3, 0.6]),  # words in repeated windows
    np.array([0.0, 0.05, 0.2]),  # digits a byte
    np.array([0.5]),  # another line is equal
    np.array([0.5]),  # ends like a sentence
)
BASE = np.cumsum([0, *(len(b) + 1 for b in BINS)])
_ASCII = np.arange(256)
UPPER = (_ASCII >= 65) & (_ASCII <= 90)
ALPHA = UPPER | ((_ASCII >= 97) & (_ASCII <= 122))
DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
SYMBOL = np.isin(_ASCII, np.frombuffer(b"#*$%&|<>", np.uint8))
STOP = np.isin(_ASCII, np.frombuffer(b".!?", np.uint8))
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


@dataclass
class Crf:
    weights: np.ndarray  # by feature bin, for content against boilerplate
    start: np.ndarray  # by state: 0 boilerplate, 1 content
    step: np.ndarray  # from state, to state


@dataclass
class Lines:
    stats: dict[str, np.ndarray]
    row: np.ndarray  # of each line with a word
    bins: np.ndarray
    size: np.ndarray  # bytes in words
    at: np.ndarray  # place among all lines of its text
    n_lines: np.ndarray


def measure(column: pa.Array) -> Lines:
    buf, offs = utf8(column)
    n = len(offs) - 1
    starts, ends, row, hashed = words(buf, offs)
    lead = (buf & 0xC0) != 0x80
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[starts] = 1
    in_word[ends] -= 1
    inside = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    counts = np.bincount(row, minlength=n)

    breaks = np.flatnonzero(buf == 10)
    at_doc = np.searchsorted(offs, breaks, "right") - 1
    begin = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((begin, np.concatenate([np.arange(n), at_doc])))
    begin, of = begin[order], np.concatenate([np.arange(n), at_doc])[order]
    last = np.r_[of[1:] != of[:-1], True] if n else np.zeros(0, bool)
    end = np.where(last, offs[of + 1], np.r_[begin[1:] - 1, 0][: len(begin)]) if n else begin
    n_lines = np.bincount(of, minlength=n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    line_of = np.searchsorted(begin, starts, "right") - 1
    n_in = np.bincount(line_of, minlength=len(begin))

    with np.errstate(over="ignore"):
        tri = np.zeros(max(len(hashed) - 2, 0), U64)
        if len(tri):
            tri = mix64((hashed[:-2] * U64(0x9E3779B97F4A7C15) + hashed[1:-1]) * U64(0xD6E8FEB86659FD93) + hashed[2:])
            tri ^= mix64(row[:-2].astype(U64) + U64(1))
    whole = np.flatnonzero(row[2:] == row[:-2]) if len(tri) else np.zeros(0, np.int64)
    covered = np.zeros(len(hashed), bool)
    if len(whole):
        order = np.argsort(tri[whole])
        key = tri[whole][order]
        same = key[1:] == key[:-1]
        again = whole[order[np.r_[same, False] | np.r_[False, same]]]
        for k in range(3):
            covered[again + k] = True

    live = np.flatnonzero(n_in > 0)
    with np.errstate(over="ignore"):
        key = segment_hash(buf, begin[live], end[live]) ^ mix64(of[live].astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, equal = np.zeros(len(live), bool), np.zeros(len(live), bool)
    later[order] = np.r_[False, same][: len(live)]
    equal[order] = (np.r_[False, same][: len(live)]) | (np.r_[same, False][: len(live)])

    stats = {
        "n_words": counts,
        "word_chars": per_row(lead & inside, offs[:-1], offs[1:]),
        "n_symbols": per_row(SYMBOL[buf], offs[:-1], offs[1:]),
        "n_dup_lines": np.bincount(of[live][later], minlength=n),
        "n_repeat_words": np.bincount(row[covered], minlength=n),
    }
    b, e = begin[live], end[live]
    n_word = n_in[live].astype(float)
    size = per_row(inside, b, e)
    count = lambda table: per_row(table[buf], b, e)
    stop = np.bincount(line_of[STOP[buf[ends - 1]]], minlength=len(begin))[live] if len(ends) else np.zeros(0)
    final = np.zeros(len(begin), np.int64)
    final[line_of] = ends - 1
    bins = np.empty((len(live), len(BINS)), np.int32)
    for k, x in enumerate(
        (
            n_word,
            count(SYMBOL) / n_word,
            count(UPPER) / np.maximum(count(ALPHA), 1),
            count(_ASCII == 33) / n_word,
            count(_ASCII == 124) / n_word,
            size / n_word,
            np.bincount(line_of[covered], minlength=len(begin))[live] / n_word,
            count(DIGIT) / np.maximum(size, 1),
            equal,
            STOP[buf[final[live]]] if len(live) else stop,
        )
    ):
        bins[:, k] = np.digitize(x, BINS[k], right=True) + BASE[k]
    return Lines(stats, of[live], bins, size, at[live], n_lines)


def chains(row: np.ndarray) -> list[np.ndarray]:
    """For each step, the places of the lines at that step, the longest chains first, so that each step is a prefix of the one before."""
    if not len(row):
        return []
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[begin, len(row)])
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")
    return [begin[:m] + t for t, m in enumerate(live)]


def decode(model: Crf, row: np.ndarray, bins: np.ndarray, block: int = 512) -> np.ndarray:
    """Viterbi: 1 for each content line.

    Chains are cut into blocks; each is decoded for both states before it, all blocks at once, and then the blocks of a chain are joined.
    So a chain of a million lines takes a few thousand rounds.
    """
    if not len(row):
        return np.zeros(0, np.int8)
    score = model.weights[bins].sum(1)
    emit = np.stack([np.zeros(len(score)), score], 1)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    of = np.cumsum(place % block == 0) - 1  # the block of each line
    steps = chains(of)
    best = np.zeros((len(row), 2, 2))  # by line, state before its block, own state
    back = np.zeros((len(row), 2, 2), np.int8)
    for t, at in enumerate(steps):
        if t == 0:
            enter = np.where((place[at] == 0)[:, None, None], model.start[None, None, :], model.step[None, :, :])
            best[at] = enter + emit[at][:, None, :]
        else:
            way = best[at - 1][:, :, :, None] + model.step
            back[at] = way.argmax(2)
            best[at] = way.max(2) + emit[at][:, None, :]
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    tail = np.r_[head[1:] - 1, len(row) - 1]
    rounds = chains(row[head])
    total, came = np.zeros((len(head), 2)), np.zeros((len(head), 2), np.int8)
    for t, k in enumerate(rounds):
        if t == 0:
            total[k] = best[tail[k], 0]
        else:
            way = total[k - 1][:, :, None] + best[tail[k]]
            came[k] = way.argmax(1)
            total[k] = way.max(1)
    last, before = np.zeros(len(head), np.int8), np.zeros(len(head), np.int8)
    for t in range(len(rounds) - 1, -1, -1):
        k = rounds[t]
        more = len(rounds[t + 1]) if t + 1 < len(rounds) else 0
        last[k[more:]] = total[k[more:]].argmax(1)
        if more:
            last[k[:more]] = before[rounds[t + 1]]
        before[k] = came[k, last[k]]
    state = np.zeros(len(row), np.int8)
    state[tail] = last
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        state[at - 1] = back[at, before[of[at]], state[at]]
    return state


def fit(row: np.ndarray, bins: np.ndarray, state: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> Crf:
    """Gradient ascent (Adam) on the log likelihood of the given states; forward-backward runs over all chains at once."""
    steps, n = chains(row), len(row)
    theta = np.zeros(BASE[-1] + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    firsts = steps[0]
    linked = np.flatnonzero(np.r_[False, row[1:] == row[:-1]])
    for it in range(1, rounds + 1):
        w, start, step = theta[: BASE[-1]], theta[BASE[-1] : BASE[-1] + 2], theta[-4:].reshape(2, 2)
        emit = np.stack([np.zeros(n), w[bins].sum(1)], 1)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t, at in enumerate(steps):
            a[at] = emit[at] + (start if t == 0 else np.logaddexp.reduce(a[at - 1][:, :, None] + step, 1))
        for t in range(len(steps) - 1, 0, -1):
            at = steps[t]
            b[at - 1] = np.logaddexp.reduce(step + (emit[at] + b[at])[:, None, :], 2)
        logz = np.logaddexp.reduce(a + b, 1)
        p = np.exp(a + b - logz[:, None])
        pair = np.exp(a[linked - 1][:, :, None] + step + (emit[linked] + b[linked])[:, None, :] - logz[linked][:, None, None])
        g = np.zeros_like(theta)
        np.add.at(g, bins.ravel(), np.repeat(state - p[:, 1], bins.shape[1]))
        g[BASE[-1]] = (state[firsts] == 0).sum() - p[firsts, 0].sum()
        g[BASE[-1] + 1] = (state[firsts] == 1).sum() - p[firsts, 1].sum()
        seen = np.bincount(state[linked - 1] * 2 + state[linked], minlength=4)
        g[-4:] = seen - pair.sum(0).ravel()
        g = g / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-9)
    return Crf(theta[: BASE[-1]], theta[BASE[-1] : BASE[-1] + 2], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 5000, doc_id: str = "doc_id", text: str = "text") -> Crf:
    """Fits the CRF to labelled documents, `max_docs` of those that there are at most; those with more than `max_lines` lines are left out of the fit (and judged like all)."""
    flat = Crf(np.ones(BASE[-1]), np.zeros(2), np.zeros((2, 2)))
    told = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    told = told.groupBy("doc_id").agg(F.max("good").alias("good")).join(docs.select(F.col(doc_id).cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = measure(part.column("text"))
                begin = np.searchsorted(x.row, np.arange(part.num_rows + 1))
                packed = [x.bins[i:j].astype(np.int32).tobytes() for i, j in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "good": part.column("good"), "bins": pa.array(packed, pa.binary())})

    width = 4 * len(BINS)
    found = own.join(F.broadcast(told), "doc_id").mapInArrow(lines, "doc_id bigint, good int, bins binary").where(F.octet_length("bins") <= max_lines * width).toArrow().sort_by("doc_id")
    blobs, good = found["bins"].to_pylist(), found["good"].to_numpy()
    row = np.repeat(np.arange(len(blobs)), [len(b) // width for b in blobs])
    bins = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, len(BINS))
    if not len(row) or len(set(good[row])) < 2:
        return flat
    state = good[row].astype(np.int64)
    model = fit(row, bins, state)
    guess = decode(model, row, bins)
    spared = np.bincount(row, (guess == 0) & (state == 0)) > 0
    state = np.where((state == 0) & (guess == 1) & spared[row], 1, state)
    return fit(row, bins, state)


def verdicts(column: pa.Array, model: Crf, min_share: float) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The measured lines, the state of each, and by text: base_failed, content share and kept."""
    x = measure(column)
    n, s = len(column), x.stats
    state = decode(model, x.row, x.bins)
    share = np.bincount(x.row, x.size * state, n) / np.maximum(np.bincount(x.row, x.size, n), 1)
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return x, state, failed, share, ~failed & (share >= min_share)


def judge(docs: DataFrame, model: Crf, min_share: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the counts, base_failed, content_share, marks (a letter for each line: C, B, or - without a word) and kept."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, state, failed, share, kept = verdicts(part.column("text"), model, min_share)
                marks = np.full(int(x.n_lines.sum()), ord("-"), np.uint8)
                first = np.cumsum(x.n_lines) - x.n_lines
                marks[first[x.row] + x.at] = np.where(state == 1, ord("C"), ord("B"))
                cut = np.r_[0, np.cumsum(x.n_lines)].astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id")}
                    | {k: pa.array(v.astype(np.int64)) for k, v in x.stats.items()}
                    | {
                        "base_failed": pa.array(failed),
                        "content_share": pa.array(share),
                        "marks": pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(marks.tobytes())]),
                        "kept": pa.array(kept),
                    }
                )

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(rate, f"doc_id bigint, {STATS}, base_failed boolean, content_share double, marks string, kept boolean")


def keep(docs: DataFrame, model: Crf, min_share: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, in one pass."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(verdicts(part.column(text), model, min_share)[-1]))

    return docs.mapInArrow(sift, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
