"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Documents are encoded where they lie; each ends with an end id, and only those longer than a sequence are cut. How a bin can be filled
depends on lengths alone, so packing plans on the histogram of lengths, which has as many rows as a sequence has tokens however large
the corpus is. For each bin, the longest length left is set, and a bitset subset-sum program over the lengths left (with their numbers)
finds the fullest feasible combination; the combination is taken as often as its lengths last and removed. Each piece then finds its
place from its rank among the pieces of its length: ranks come from counts by (length, partition), so no task sees all of a length.

Defined cases: a null text is empty and still has its end id; equal ids, null ids and repeated rows are separate pieces, so that their
number and order among equal lengths does not matter; texts of any length are cut, never dropped; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postflow.operators.storage import saved

from .kernels import ranges, slices, utf8, words
from .word_ids import WordIds

MAX_LEN = 4096
END = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_WORKER: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(spec: str) -> WordIds:
    if spec not in _WORKER:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        _WORKER[spec] = WordIds(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    return _WORKER[spec]


def pieces(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, and the ids (little-endian unsigned 32 bit) if wanted.

    The tokenizer file must drop white space, so that a text's ids are those of its words.
    """
    with open(tokenizer or default_tokenizer()) as f:
        spec = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        word_ids = _encoder(spec)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = utf8(part.column("text"))
                starts, ends, row, hashed = words(buf, offs)
                flat, count = word_ids(hashed, lambda i, b=buf, s=starts, e=ends: b[s[i] : e[i]].tobytes().decode())
                n = part.num_rows
                total = np.bincount(row, count, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
                full = total + 1
                begin = np.cumsum(full) - full
                ids = np.full(int(full.sum()), end_id, "<u4")
                ids[ranges(begin, total)] = flat
                many = -(-full // max_len)
                of = np.repeat(np.arange(n), many)
                piece = ranges(np.zeros(n, np.int64), many)
                start = piece * max_len
                length = np.minimum(full[of] - start, max_len)
                raw = memoryview(ids).cast("B")
                cuts = [raw[4 * a : 4 * (a + k)] for a, k in zip((begin[of] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(of)),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start),
                        "length": pa.array(length),
                        "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                        "ids": pa.array([c.tobytes() for c in cuts] if with_ids else [None] * len(cuts), pa.binary()),
                    }
                )

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = own.mapInArrow(encode, PIECES)
    return found if with_ids else found.drop("ids")


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """The combination of lengths (each at most as often as it is left) with the largest sum up to room: subset sums as bits.

    Longer lengths come first, and no shorter ones are looked at once at most `slack` of the room is left over.
    """
    reach, full, taken = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            taken.append((length, step, reach))
            reach |= (reach << (length * step)) & full
            left -= step
            step *= 2
        if reach >> (room - min(slack, room)):
            break
    at, used = reach.bit_length() - 1, {}
    for length, step, before in reversed(taken):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + step
            at -= length * step
    return used


def filled(histogram: dict[int, int], max_len: int, slack: int) -> tuple[list[tuple[int, ...]], int]:
    """Sequences filled one after the other, and how many there are: each starts with the longest length left and gets the fullest combination of the rest.

    A combination is taken as often as its lengths last, so the work follows the number of lengths and not that of pieces.
    """
    counts = {k: v for k, v in histogram.items() if v}
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        longest = max(counts)
        left = {k: v - (k == longest) for k, v in counts.items() if v > (k == longest)}
        use = fullest(left, max_len - longest, slack)
        use[longest] = use.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in use.items())
        offset = 0
        for k in sorted(use, reverse=True):
            rows.append((k, taken[k], sequence, use[k], offset))
            offset += k * use[k]
            taken[k] += use[k] * times
            counts[k] -= use[k] * times
            if not counts[k]:
                del counts[k]
        sequence += times
    return rows, sequence


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: slots by (length, first rank), with the first sequence, pieces a sequence and first offset.

    If minimum bin slack needs more sequences than the sum of lengths does, it is tried again with some slack allowed early on, which saves
    short lengths for later; the plan with the fewest sequences counts.
    """
    bound = -(-sum(k * v for k, v in histogram.items()) // max_len)
    best, n = filled(histogram, max_len, 0)
    for part in (100, 50, 25):
        if n > bound:
            best, n = min((best, n), filled(histogram, max_len, max_len // part), key=lambda x: x[1])
    table = np.array(sorted(best), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(found: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces; the pieces are read more than once and should be saved."""
    parted = found.withColumn("pid", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int"))
    counts = saved(parted.groupBy("length", "pid").agg(F.count("*").alias("n")))
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_len)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "pid", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "pid").orderBy("doc_id", "piece"))
    ranked = parted.withColumn("own", own).join(base, ["length", "pid"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("own", "base", "pid")
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 40
        keys = slots["length"] * span + slots["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            rel, each = rank - slots["rank"][at], slots["each"][at]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(slots["sequence"][at] + rel // each, schema[0].type), "offset": pa.array(slots["offset"][at] + rel % each * length, schema[1].type)})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields)
    return ranked.mapInArrow(put, f"{shape}, sequence_id bigint, offset bigint")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    found = saved(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
