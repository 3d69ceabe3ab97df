"""Exact substring dedup over the whole corpus: suffix order, previous and next smaller documents, earliest copy kept.

A byte goes if a `size`-byte string that covers it also starts in a document with a smaller id. Strings are cut from the texts as
"runs": neighbouring windows whose smallest k-gram hash is the same. Equal windows have the same smallest hash, so all copies of a
window meet in the bucket of that hash. Four passes over the document partitions do the work:

1. Each partition sends its distinct hashes; it hears which of them other documents hold too (most are nobody else's).
2. For those, it sends a digest of each distinct run and the smallest id that has it. It hears which runs an earlier document has in
   full, and which are first of their kind but meet other runs with the same hash.
3. The latter's bytes go to a bucket, which puts their windows in suffix order; a window has an earlier copy if, within the stretch
   that shares `size` bytes, the longest-previous-factor test finds a smaller document before it (previous smaller) or after it
   (next smaller) in suffix order.
4. Each partition marks the bytes of its documents.

A hash that more than HOT distinct runs hold (a line that thousands of documents place in other surroundings) is split by content: in
step 2 its runs go out as single windows, keyed by their own bytes, for which the smallest id says all. Runs are told apart by 128 bits.

A partition is read in slices of SLICE bytes; a longer text is cut into pieces that overlap by `size` - 1 bytes, so memory follows the
runs and not the text. Which windows a run has is only a matter of transport: any cut gives the same answer.

Defined cases: a null text is empty; a null id counts as larger than every id; documents with the same id do not match each other;
texts shorter than `size` stay whole, texts of any length are read whole; of equal passages with different ids the smallest id's stays,
with equal ids all stay; an empty table gives an empty result; other columns are ignored, whatever their names, but for those carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .kernels import BYTE, CHUNK, U64, mix64, per_row, ranges, segment_hash, utf8

HOT = 2000
SLICE = 2 << 20
NO_ID = np.iinfo(np.int64).max
FULL, CHECK = 1, 2
OWN = np.dtype([("same", "<u8"), ("more", "<u8"), ("doc", "<i8")])
RUN = np.dtype([("same", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("len", "<i4")])
SPAN = np.dtype([("more", "<u8"), ("a", "<i4"), ("b", "<i4")])
SECOND = mix64(BYTE ^ U64(0x5851F42D4C957F2D))
RUNS = "bucket int, pid int, key binary, info binary, bytes binary"
SPANS = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def kgram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on, built by doubling."""
    out = np.zeros(max(len(buf) - k + 1, 0), U64)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), CHUNK):
            level = {1: BYTE[buf[a : min(a + CHUNK, len(out)) + k - 1]]}
            n = 1
            while 2 * n <= k:
                h = level[n]
                level[2 * n] = h[:-n] * U64(0xA24BAED4963EE407 + 4 * n) + h[n:]
                n *= 2
            h, at = level[n], n
            while at < k:
                n = 1 << ((k - at).bit_length() - 1)
                more = level[n][at:]
                h = h[: len(more)] * U64(0x9FB21C651E98DF25 + 4 * n) + more
                at += n
            out[a : a + CHUNK] = mix64(h)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n, m = 1, h
    while 2 * n <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (w - n)], m[w - n :]) if w > n else m


class Runs:
    """The runs of a buffer of documents: first and last window start, row, smallest hash (key), hash of the run's bytes (same)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, size: int):
        self.buf, self.size = buf, size
        found, i = [], 0
        while i < len(offs) - 1:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
            if offs[j] - offs[i] <= SLICE:
                found.append(self.cut(offs[i : j + 1], i))
            else:
                found += [self.cut(np.array([a, min(a + SLICE + size - 1, offs[j])]), i) for a in range(int(offs[i]), int(offs[j]) - size + 1, SLICE)]
            i = j
        none = np.zeros(0, np.int64)
        self.start, self.last, self.row, self.key, self.same = (np.concatenate(x) for x in zip(*found, (none, none, none, none.astype(U64), none.astype(U64)), strict=True))

    def cut(self, offs: np.ndarray, row: int) -> tuple[np.ndarray, ...]:
        """The runs of the rows from `row` on, whose bytes lie at offs."""
        size, base = self.size, offs[0]
        buf, offs = self.buf[base : offs[-1]], offs - base
        k = max(1, size * 24 // 50)
        h = kgram_hash(buf, k)
        w, n = size - k + 1, len(buf) - size + 1
        edge = np.zeros(len(buf) + 1, np.int8)
        fits = np.diff(offs) >= size
        edge[offs[:-1][fits]] = 1
        edge[offs[1:][fits] - size + 1] = -1
        valid = np.cumsum(edge, dtype=np.int8)[: max(n, 0)].astype(bool)
        starts, keys, prev, prev_ok = [np.zeros(0, np.int64)], [np.zeros(0, U64)], U64(0), False
        for a in range(0, max(n, 0), CHUNK):
            m, ok = sliding_min(h[a : min(a + CHUNK, n) + w - 1], w), valid[a : a + CHUNK]
            new = np.r_[not prev_ok or m[0] != prev, ~ok[:-1] | (m[1:] != m[:-1])] & ok
            at = np.flatnonzero(new)
            starts.append(at + a)
            keys.append(m[at])
            prev, prev_ok = m[-1], ok[-1]
        start, key = np.concatenate(starts), np.concatenate(keys)
        of = np.searchsorted(offs, start, "right") - 1
        last = np.minimum(np.r_[start[1:] - 1, n], offs[of + 1] - size) if len(start) else start
        end = last + size
        with np.errstate(over="ignore"):
            same, at = h[start] + key * U64(3), start + k
            for _ in range(3):
                same = mix64(same) + h[np.minimum(at, end - k)]
                at = at + k
            same += (end - start).astype(U64)
        long = np.flatnonzero(end - start > 4 * k)
        if len(long):
            same[long] = segment_hash(buf, start[long], end[long])
        return start + base, last + base, of + row, key, mix64(same)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and row of each window of the chosen runs."""
        count = self.last[of] - self.start[of] + 1
        return ranges(self.start[of], count), np.repeat(self.row[of], count)


@dataclass
class Entries:
    """All that a partition has of shared keys: runs, and windows where the key is hot."""

    key: np.ndarray
    same: np.ndarray  # 128 bits with more
    more: np.ndarray
    start: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    heads: np.ndarray  # of each distinct entry, one with the smallest id
    of: np.ndarray  # for each entry, its place among the heads

    @property
    def least(self) -> np.ndarray:
        return self.doc[self.heads][self.of] if len(self.of) else self.doc


def pair_key(key: np.ndarray, same: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key + same * U64(0x9E3779B97F4A7C15))


def first_of(pair: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct (pair, more), in order, the index of an entry with the smallest id; and for each entry its place among them."""
    order = np.lexsort((ids, more, pair))
    if not len(order):
        return order, order
    p, m = pair[order], more[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (m[1:] != m[:-1])]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def suffix_order(text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the given starts, cut at `size` bytes, and the cut suffixes as rows of 8-byte words."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    steps = sorted({*range(0, max(size - 7, 1), 8), max(size - 8, 0)})
    words = np.zeros((len(steps), len(starts)), U64)
    for k, s in enumerate(steps):
        for j in range(min(8, size)):
            words[k] = (words[k] << U64(8)) | padded[starts + s + j].astype(U64)
    return np.lexsort(words[::-1]), words


def previous_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place, the nearest place before it with a smaller value, or -1. What lies between is skipped by the pointers found so far."""
    at = np.arange(-1, len(rank) - 1)
    open_ = np.flatnonzero((at >= 0) & (rank[at] >= rank))
    while len(open_):
        at[open_] = at[at[open_]]
        to = at[open_]
        open_ = open_[(to >= 0) & (rank[to] >= rank[open_])]
    return at


def longest_previous(order: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix, how many of its leading words the longest previous factor has: a string that starts in a document with a smaller id.

    In suffix order the best such factor starts at the previous or at the next place with a smaller document.
    """
    out = np.zeros(len(doc), np.int64)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)[order]
    before = previous_smaller(rank)
    after = len(rank) - 1 - previous_smaller(rank[::-1])[::-1]
    for other in (before, after):
        some = np.flatnonzero((other >= 0) & (other < len(rank)))
        mine, its = order[some], order[other[some]]
        same, shared = np.ones(len(some), bool), np.zeros(len(some), np.int64)
        for w in words:
            same &= w[mine] == w[its]
            shared += same
        out[mine] = np.maximum(out[mine], shared)
    return out


def remains(buf: np.ndarray, offs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each row, its removed spans (the union of [first, last), relative to the row) and the bytes that are left."""
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32, out=edge[:-1]) > 0
    del edge
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1]
    closes[:-1] &= ~gone[1:]
    heads = offs[:-1][offs[:-1] < offs[-1]]
    opens[heads] = gone[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    closes[tails] = gone[tails]
    b, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offs, b, "right") - 1
    per = np.bincount(row, minlength=len(offs) - 1)
    left = per_row(~gone, np.zeros(len(offs), np.int64), offs)
    spans = pa.StructArray.from_arrays([pa.array(b - offs[row]), pa.array(e - offs[row])], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), spans)
    return spans, pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(buf[~gone].tobytes())])


def dedup(docs: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_bytes, the removed spans (byte offsets, ascending, apart) and the kept bytes.

    carry names columns of the documents to take along, as carry_0, carry_1, ...
    """
    along = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *along)
    plan = ex.layout(own)
    n_keys = n_buckets = plan.buckets
    parted = ex.dealt(own, "doc_id", plan.parts, "text")
    shape = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def load(table: pa.Table) -> tuple[np.ndarray, Runs, np.ndarray]:
        buf, offs = utf8(table["text"])
        ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return ids, Runs(buf, offs, size), offs

    def extract(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, runs, _ = load(table)
        doc = ids[runs.row]
        order = np.lexsort((doc, runs.same, runs.key))
        if not len(order):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        key, same, doc = runs.key[order], runs.same[order], doc[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_run = new_key | np.r_[True, same[1:] != same[:-1]]
        again = ~new_run & np.r_[False, doc[1:] != doc[:-1]]
        at = np.flatnonzero(new_key)
        return key[at], np.add.reduceat(new_run.astype(np.int64), at) + np.maximum.reduceat(again.astype(np.int64), at)

    def entries(table: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, Entries]:
        """The bytes and offsets of the partition's documents, and what it has of shared keys."""
        ids, runs, offs = load(table)
        keys = np.unique(runs.key)
        flag = ex.told(replies, 0, ex.bucket_of(keys, n_keys))[np.searchsorted(keys, runs.key)]
        plain = np.flatnonzero(flag == 1)
        w_start, w_row = runs.windows(np.flatnonzero(flag == 2))
        w_hash = segment_hash(runs.buf, w_start, w_start + size)
        key, same = np.r_[runs.key[plain], w_hash], np.r_[runs.same[plain], w_hash]
        start, last = np.r_[runs.start[plain], w_start], np.r_[runs.last[plain], w_start]
        doc = ids[np.r_[runs.row[plain], w_row]]
        more = segment_hash(runs.buf, start, last + size, SECOND)
        return runs.buf, offs, Entries(key, same, more, start, last, doc, *first_of(pair_key(key, same), more, doc))

    def send_ids(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("key", pa.binary()), ("info", pa.binary())]).empty_table()
        _, _, e = entries(table, replies)
        info = np.zeros(len(e.heads), OWN)
        info["same"], info["more"], info["doc"] = e.same[e.heads], e.more[e.heads], e.doc[e.heads]
        return ex.by_group(ex.bucket_of(e.key[e.heads], n_buckets), {"key": e.key[e.heads], "info": info}, "bucket", {"pid": group[0].as_py()})

    def answer_ids(_: tuple, table: pa.Table) -> pa.Table:
        """FULL where another partition has the run in a smaller document; CHECK where this is the smallest, but other runs have the key."""
        key, info = ex.gather(table, "key", np.uint64), ex.gather(table, "info", OWN)
        heads, of = first_of(pair_key(key, info["same"]), info["more"], info["doc"])
        kinds = np.sort(key[heads])
        lo, hi = np.searchsorted(kinds, key, "left"), np.searchsorted(kinds, key, "right")
        flags = np.where(info["doc"] > info["doc"][heads][of], FULL, np.where(hi - lo > 1, CHECK, 0)).astype(np.uint8)
        return ex.send_flags(table, flags, [len(x.as_py()) // 8 for x in table["key"]], 1)

    def send_runs(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("key", pa.binary()), ("info", pa.binary()), ("bytes", pa.binary())]).empty_table()
        buf, _, e = entries(table, replies)
        heads = e.heads[ex.told(replies, 1, ex.bucket_of(e.key[e.heads], n_buckets)) == CHECK]
        bucket = ex.bucket_of(e.key[heads], n_buckets)
        order = np.argsort(bucket, kind="stable")
        heads, bucket = heads[order], bucket[order]
        size_ = e.last[heads] + size - e.start[heads]
        info = np.zeros(len(heads), RUN)
        info["same"], info["more"], info["doc"], info["len"] = e.same[heads], e.more[heads], e.doc[heads], size_
        out = ex.by_group(bucket, {"key": e.key[heads], "info": info}, "bucket", {"pid": group[0].as_py()})
        cut = np.r_[np.unique(bucket, return_index=True)[1], len(bucket)]
        text = [buf[ranges(e.start[heads[i:j]], size_[i:j])].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
        return out.append_column("bytes", pa.array(text, pa.binary()))

    def judge(_: tuple, table: pa.Table) -> pa.Table:
        key, info = ex.gather(table, "key", np.uint64), ex.gather(table, "info", RUN)
        pid = table["pid"].to_numpy()[ex.origin(table, "key", 8)]
        text = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        length = info["len"].astype(np.int64)
        at = np.cumsum(length) - length
        count = length - size + 1
        of = np.repeat(np.arange(len(key)), count)
        start = ranges(at, count)
        order, words = suffix_order(text, start, size)
        hit = longest_previous(order, words, info["doc"][of]) == len(words)
        rel = start - at[of]
        b = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & (of[1:] == of[:-1])])
        e = np.flatnonzero(hit & ~np.r_[hit[1:] & (of[1:] == of[:-1]), False])
        span = np.zeros(len(b), SPAN)
        span["more"], span["a"], span["b"] = info["more"][of[b]], rel[b], rel[e]
        return ex.to_parts(pid[of[b]], pair_key(key, info["same"])[of[b]], span, 2)

    def mark(_: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        buf, offs, x = entries(table, replies)
        told = ex.told(replies, 1, ex.bucket_of(x.key[x.heads], n_buckets))
        whole = np.flatnonzero((told[x.of] == FULL) | (x.doc > x.least)) if len(x.of) else x.of
        known, span = ex.reply_arrays(replies, 2, SPAN)
        pair = pair_key(x.key, x.same)
        lo, hi = np.searchsorted(known, pair, "left"), np.searchsorted(known, pair, "right")
        at, of = ranges(lo, hi - lo), np.repeat(np.arange(len(pair)), hi - lo)
        own = span["more"][at] == x.more[of]
        at, of = at[own], of[own]
        first = np.r_[x.start[whole], x.start[of] + span["a"][at]]
        last = np.r_[x.last[whole], x.start[of] + span["b"][at]] + size
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        spans, kept, i = [], [], 0
        while i < len(offs) - 1:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + 4 * SLICE, "right")) - 1)
            p, q = np.searchsorted(first, offs[i]), np.searchsorted(first, offs[j])
            some, left = remains(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], first[p:q] - offs[i], last[p:q] - offs[i])
            spans.append(some)
            kept.append(left)
            i = j
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array(np.diff(offs)),
                "spans": pa.chunked_array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.chunked_array(kept, pa.binary()),
            }
            | {c: table[c] for c in table.column_names if c.startswith("carry_")}
        )

    def round_(replies: DataFrame, f, schema: str) -> DataFrame:
        return parted.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(f, schema)

    shared = ex.shared_keys(parted, extract, n_keys, HOT)
    owners = round_(shared, send_ids, ex.ASKS).groupBy("bucket").applyInArrow(answer_ids, ex.REPLY)
    heard = shared.unionByName(owners)
    spans = round_(heard, send_runs, RUNS).groupBy("bucket").applyInArrow(judge, ex.REPLY)
    return round_(heard.unionByName(spans), mark, SPANS + shape)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
