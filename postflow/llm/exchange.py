"""Key exchange between document partitions and key buckets.

Corpus-wide questions ("which keys occur in several documents?") are answered without moving a row per key: documents are dealt to
partitions by a hash of their id, each partition sends its distinct keys to key buckets as packed arrays, and the buckets answer
each partition with packed arrays. A key costs one entry for each partition that holds it, however many documents share it, so a key
that a third of all documents hold still loads no task. The number of partitions and buckets follows the bytes of the texts (`layout`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASKS = "bucket int, pid int, key binary, info binary"
REPLY = "pid int, kind int, bucket int, key binary, info binary"
PART_BYTES, LARGE = 4 << 20, 10 << 30
SHORT = 5  # bytes of a key in the first round; two keys that agree there and in their bucket only look shared


@dataclass(frozen=True)
class Layout:
    """How many document partitions and key buckets an exchange has."""

    parts: int
    buckets: int


def layout(df: DataFrame, column: str = "text") -> Layout:
    """Partitions and buckets by the bytes of a column, whatever the number of shuffle partitions.

    A partition holds about PART_BYTES. Beyond LARGE bytes of input it grows with their root, so that the rows of the exchange (one for
    each partition and bucket) grow with the input and not with its square; operators read a partition in slices.
    """
    total = df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    parts = max(1, math.ceil(total / (PART_BYTES * max(1.0, math.sqrt(total / LARGE)))))
    return Layout(parts, math.ceil(parts / 3))


def dealt(df: DataFrame, key: str, parts: int, spread: str | None = None) -> DataFrame:
    """Adds pid, the document partition of a row, by its key; rows with a null key are dealt by the column `spread`."""
    at = F.xxhash64(key) if spread is None else F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.xxhash64(key))
    return df.withColumn("pid", F.pmod(at, F.lit(parts)).cast("int"))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def by_group(of: np.ndarray, arrays: dict[str, np.ndarray], name: str, fixed: dict[str, int]) -> pa.Table:
    """One row for each value in `of`, with the arrays' entries of that value as packed bytes, in their order."""
    order = np.argsort(of, kind="stable")
    ids, at = np.unique(of[order], return_index=True)
    cut = np.r_[at, len(of)]
    cols = {name: pa.array(ids, pa.int32())} | {k: pa.array(np.full(len(ids), v), pa.int32()) for k, v in fixed.items()}
    for k, values in arrays.items():
        values = values[order]
        cols[k] = pa.array([values[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())
    return pa.table(cols)


def gather(table: pa.Table, column: str, kind: np.dtype | type | str) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def origin(table: pa.Table, column: str, width_: int) -> np.ndarray:
    """The row of the table that each packed entry is from."""
    return np.repeat(np.arange(table.num_rows), [len(x.as_py()) // width_ for x in table[column]])


def shorten(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).view(f"V{SHORT}").ravel()


def lengthen(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(blob, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def shared_keys(parted: DataFrame, extract: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n: int, hot: int = 1 << 62) -> DataFrame:
    """Replies of kind 0, from n buckets: for each key that a partition has, in order, whether another document has it too, and whether it is hot.

    extract gives a partition's distinct keys, ascending, and how often each counts there: 1 for one document, more for several. A key
    is hot when its counts (each 255 at most) add up to more than `hot`. Read the replies with `told`.
    """

    def send(group: tuple, table: pa.Table) -> pa.Table:
        keys, count = extract(table)
        return by_group(bucket_of(keys, n), {"key": shorten(keys), "info": np.minimum(count, 255).astype(np.uint8)}, "bucket", {"pid": group[0].as_py()})

    def answer(_: tuple, table: pa.Table) -> pa.Table:
        key = lengthen(b"".join(table["key"].to_pylist()))
        count = gather(table, "info", np.uint8).astype(np.int64)
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        total = np.empty_like(count)
        total[order] = np.add.reduceat(count[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        flags = (total > 1).astype(np.uint8) + (total > hot)
        return send_flags(table, flags, [len(x.as_py()) // SHORT for x in table["key"]], 0)

    return parted.groupBy("pid").applyInArrow(send, ASKS).groupBy("bucket").applyInArrow(answer, REPLY)


def send_flags(asked: pa.Table, flags: np.ndarray, counts: list[int], kind: int) -> pa.Table:
    """For each row asked, the flags (0 to 3) of its entries as two bit arrays."""
    cut = np.r_[0, np.cumsum(counts)].astype(np.int64)
    pack = lambda bit: [np.packbits(flags[i:j] >> bit & 1).tobytes() for i, j in zip(cut, cut[1:], strict=False)]
    return pa.table(
        {
            "pid": asked["pid"].combine_chunks(),
            "kind": pa.array(np.full(asked.num_rows, kind), pa.int32()),
            "bucket": asked["bucket"].combine_chunks(),
            "key": pa.array(pack(0), pa.binary()),
            "info": pa.array(pack(1), pa.binary()),
        }
    )


def told(replies: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The flags of a partition's entries, given the bucket that each entry was sent to."""
    out = np.zeros(len(bucket), np.uint8)
    if not len(bucket):
        return out
    order = np.argsort(bucket, kind="stable")
    rows = replies.filter(pa.compute.equal(replies["kind"], kind)).sort_by("bucket")
    count = np.bincount(bucket)
    count = count[count > 0]
    flags = np.zeros(len(bucket), np.uint8)
    for bit, column in enumerate(("key", "info")):
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=c) for x, c in zip(rows[column], count, strict=True)]
        flags += np.concatenate(bits) << bit
    out[order] = flags
    return out


def to_parts(pid: np.ndarray, key: np.ndarray, info: np.ndarray, kind: int) -> pa.Table:
    """Keyed replies: to each partition its keys and what there is to say about each."""
    return by_group(pid, {"key": key, "info": info}, "pid", {"kind": kind, "bucket": 0}).select(["pid", "kind", "bucket", "key", "info"])


def reply_arrays(replies: pa.Table, kind: int, info_type: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """A partition's keyed replies of a kind, sorted by key."""
    rows = replies.filter(pa.compute.equal(replies["kind"], kind)) if replies.num_rows else replies
    key, info = gather(rows, "key", np.uint64), gather(rows, "info", info_type)
    order = np.argsort(key, kind="stable")
    return key[order], info[order]


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key among the sorted keys, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
