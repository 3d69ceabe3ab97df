"""A table of phrases against texts, in one pass for any number of phrases.

Texts and phrases are reduced to their words (lower case, anything else a single space), so that a phrase is found where its words stand
whole, one after the other. The phrases go into an Aho-Corasick automaton, which reads a text once whatever their number; the plan does
not grow with them. Phrases are data: they are taken in chunks of at most CHUNK characters, each an automaton of a known size and a pass
of its own, so a table of any size is handled.

Defined cases: a null text has no words; a phrase without words is found nowhere; equal phrases are each found; overlapping finds count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20  # characters of phrases in one automaton
WORDS = r"[^\p{L}\p{N}_]+"
_BUILT: dict[int, tuple] = {}


def spelled(text: Column) -> Column:
    """The words of a text, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORDS, " ")), F.lit(" "))


def chunks(phrases: DataFrame, limit: int) -> list[list[tuple[int, str]]]:
    """The phrases (phrase_id, phrase), spelled, in lists of at most about `limit` characters; the driver holds one at a time while it plans."""
    rows = phrases.select(F.col("phrase_id").cast("bigint").alias("phrase_id"), spelled(F.col("phrase")).alias("phrase")).where("length(trim(phrase)) > 0")
    total = rows.agg(F.sum(F.length("phrase"))).first()[0] or 0
    n = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("phrase_id", "phrase"), F.lit(n))
    return [[tuple(r) for r in rows.where(part == k).collect()] for k in range(n)]


def found_in(texts: DataFrame, phrases: DataFrame, key: str, text: str, limit: int = CHUNK) -> DataFrame:
    """(key, phrase_id, times): how often each text has each phrase that it has."""
    kind = texts.schema[key].dataType.simpleString()
    own = texts.select(F.col(key).alias("key"), spelled(F.col(text)).alias("text"))
    passes = [own.mapInArrow(_search(chunk, k), f"key {kind}, phrase_id bigint, times bigint") for k, chunk in enumerate(chunks(phrases, limit)) if chunk]
    if not passes:
        return own.limit(0).select("key", F.lit(None).cast("bigint").alias("phrase_id"), F.lit(None).cast("bigint").alias("times")).withColumnRenamed("key", key)
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("key", key)


def _search(chunk: list[tuple[int, str]], number: int):
    mark = hash(tuple(chunk))

    def automaton():
        import ahocorasick

        if _BUILT.get(number, (None,))[0] != mark:
            owners: dict[str, list[int]] = {}
            for phrase_id, phrase in chunk:
                owners.setdefault(phrase, []).append(phrase_id)
            built = ahocorasick.Automaton()
            for phrase, ids in owners.items():
                built.add_word(phrase, tuple(ids))
            built.make_automaton()
            _BUILT[number] = (mark, built)
        return _BUILT[number][1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            at, ids, times = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen: dict[int, int] = {}
                for _, owners in machine.iter(text):
                    for phrase_id in owners:
                        seen[phrase_id] = seen.get(phrase_id, 0) + 1
                at += [i] * len(seen)
                ids += seen.keys()
                times += seen.values()
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(times, pa.int64())], ["key", "phrase_id", "times"])

    return search
