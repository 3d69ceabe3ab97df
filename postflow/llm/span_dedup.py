"""Substring dedup by sliding sentence spans.

Every run of `size` consecutive sentences (a shorter text: all of its sentences) with `min_words` words or more is hashed over its
lower-cased words. Spans that occur more than once in the corpus are joined globally, and a sentence goes if any span that covers it has
an earlier occurrence: in a document with a smaller id, or earlier in the same document. A sentence ends after . ! or ? at the end of a
word, or at a line break; it owns the white space after it.

Keys travel as described in exchange.py, so a span that thousands of documents share costs one entry for each partition.

Defined cases: a null text is empty and has no sentences; a null id counts as larger than every id; of rows with the same id, the smaller
text counts as earlier; rows with null ids are dealt and ordered by a hash of their text; repeated rows keep one copy; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .kernels import U64, chain_hash, mix64, sentence_breaks, utf8, words

NO_ID = np.iinfo(np.int64).max
OUT = "doc_id bigint, n_sentences bigint, n_removed bigint, kept string"


@dataclass
class Spans:
    ids: pa.Array
    buf: np.ndarray
    offs: np.ndarray
    begin: np.ndarray  # first byte of each sentence
    row: np.ndarray  # of each sentence
    key: np.ndarray  # of each span
    first: np.ndarray  # its first sentence
    length: np.ndarray  # its sentences


def parse(table: pa.Table, size: int, min_words: int) -> Spans:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    buf, offs = utf8(table["text"])
    starts, ends, row, hashed = words(buf, offs, lower=True)
    last = np.flatnonzero(sentence_breaks(buf, starts, ends, row))
    head = np.r_[0, last[:-1] + 1][: len(last)].astype(np.int64)
    n_words = last - head + 1
    own = chain_hash(hashed, head, n_words)
    of = row[head]
    count = np.bincount(of, minlength=len(offs) - 1)
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    length = np.minimum(size, count[of])
    ok = place + length <= count[of]
    first, length = np.flatnonzero(ok), length[ok]
    key, total = np.zeros(len(first), U64), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        for k in range(size):
            on = np.flatnonzero(length > k)
            key[on] = mix64(key[on] * U64(0x9E3779B97F4A7C15) + own[first[on] + k])
            total[on] += n_words[first[on] + k]
    keep = total >= min_words
    ids = table["doc_id"].combine_chunks()
    return Spans(ids, buf, offs, starts[head], of, key[keep], first[keep], length[keep])


def first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of the first occurrence of each, and for each entry the place among the distinct keys."""
    return np.unique(keys, return_index=True, return_inverse=True)


def dedup(docs: DataFrame, size: int = 2, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_sentences, n_removed and the kept text."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shape = ex.layout(own)
    n, parted = shape.buckets, ex.dealt(own, "doc_id", shape.parts, "text")

    def extract(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(parse(table, size, min_words).key, return_counts=True)

    def shared(x: Spans, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shared keys, the first entry of each, and for every entry its place among them or -1."""
        keys, first, inverse = first_seen(x.key)
        both = ex.told(replies, 0, ex.bucket_of(keys, n)) > 0
        place = np.full(len(keys), -1)
        place[both] = np.arange(both.sum())
        return keys[both], first[both], place[inverse] if len(keys) else np.zeros(0, np.int64)

    def send(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("key", pa.binary()), ("info", pa.binary())]).empty_table()
        x = parse(table, size, min_words)
        keys, first, _ = shared(x, replies)
        doc = x.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)[x.row[x.first[first]]]
        return ex.by_group(ex.bucket_of(keys, n), {"key": keys, "info": doc}, "bucket", {"pid": group[0].as_py()})

    def answer(_: tuple, table: pa.Table) -> pa.Table:
        key, doc = ex.gather(table, "key", np.uint64), ex.gather(table, "info", np.int64)
        pid = table["pid"].to_numpy()[ex.origin(table, "key", 8)]  # tells null ids apart
        order = np.lexsort((pid, doc, key))
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        later = np.zeros(len(key), np.uint8)
        later[order] = ~new
        return ex.send_flags(table, later, [len(x.as_py()) // 8 for x in table["key"]], 1)

    def cut(_: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        x = parse(table, size, min_words)
        keys, first, place = shared(x, replies)
        later = ex.told(replies, 1, ex.bucket_of(keys, n)) > 0
        repeated = place >= 0
        gone = repeated & (later[np.maximum(place, 0)] if len(keys) else False)
        other = repeated.copy()
        other[first] = False
        at = np.flatnonzero(gone | other)
        edge = np.zeros(len(x.row) + 1, np.int64)
        np.add.at(edge, x.first[at], 1)
        np.add.at(edge, x.first[at] + x.length[at], -1)
        removed = np.cumsum(edge[:-1]) > 0
        n_rows = len(x.offs) - 1
        end = np.where(np.r_[x.row[1:] != x.row[:-1], True][: len(x.row)], x.offs[x.row + 1], np.r_[x.begin[1:], 0][: len(x.row)]) if len(x.row) else x.begin
        mark = np.zeros(len(x.buf) + 1, np.int8)
        np.add.at(mark, x.begin[removed], 1)
        np.add.at(mark, end[removed], -1)
        keep = np.cumsum(mark[:-1], dtype=np.int8) == 0
        left = np.r_[0, np.cumsum(keep)][x.offs].astype(np.int32)
        return pa.table(
            {
                "doc_id": x.ids,
                "n_sentences": pa.array(np.bincount(x.row, minlength=n_rows)),
                "n_removed": pa.array(np.bincount(x.row[removed], minlength=n_rows)),
                "kept": pa.Array.from_buffers(pa.string(), n_rows, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(x.buf[keep].tobytes())]),
            }
        )

    first = ex.shared_keys(parted, extract, n)
    owners = parted.groupBy("pid").cogroup(first.groupBy("pid")).applyInArrow(send, ex.ASKS).groupBy("bucket").applyInArrow(answer, ex.REPLY)
    return parted.groupBy("pid").cogroup(first.unionByName(owners).groupBy("pid")).applyInArrow(cut, OUT)


def op8_span_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_sentences", "n_removed", F.octet_length("kept").cast("bigint").alias("n_kept_bytes"), F.sha2("kept", 256).alias("kept_sha256"))
