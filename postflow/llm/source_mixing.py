r"""Mixing sources to target weights by systematic sampling.

A source's target is its share by weight of all words, at most `most` times the words it has; what it cannot take is shared among the
others by weight until none is above. The sources, in order of (words / weight), fill up one after the other, so two running totals tell
which are full. Every document of a source is expected target / words times. In each source, these expected copies are added up over
its documents, longest first, one random offset (a hash of seed and source) is added, and a document is taken once for each integer that
its stretch of the sum crosses. Along documents of falling length, every prefix is taken to within one copy of what is expected, so the
words taken differ from the target by the source's longest document at most.

All of it is Column expressions: words are counted by a pattern, sums over a source come from ranges of (source, length, id), so that a
source with a third of all documents is spread over tasks. Only (id, source, words, hash) is shuffled, never a text. Reruns agree, as
offsets are hashes and the order is total.

Defined cases: a null text is empty, of size 0, and takes no words; null is a source of its own, last in order; rows with one id are
documents of their own, told apart by size and text (equal rows are interchangeable); a source without words has target 0 and
takes nothing; an empty table gives an empty result; further columns are ignored by `mix` and kept by `mixed`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved

from .prefix import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, 13


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size) to those with target (double) and copies (double), the expected copies of each document.

    Sources, ordered by code point with null last, weigh as `weights` says, over and over.
    """
    big = lambda c: F.col(c).cast("decimal(20,0)")
    table = saved(sizes)
    n = table.count()
    numbered = running(table, [], [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, n)
    parts = math.lcm(*weights)
    weight, slope = F.create_map(*(F.lit(x) for i, w in enumerate(weights) for x in (i, w))), F.create_map(*(F.lit(x) for i, w in enumerate(weights) for x in (i, parts // w)))
    at = (F.col("place") % len(weights)).cast("int")
    weighed = numbered.select("source", "source_size", "place", weight[at].cast("bigint").alias("weight"), (slope[at].cast("decimal(10,0)") * big("source_size")).alias("slope"))
    ordered = saved(running(weighed, [], [F.col("slope"), F.col("place")], {"before_size": F.col("source_size"), "before_weight": F.col("weight")}, n))
    total, shares = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    total, shares = F.lit(total or 0).cast("decimal(20,0)"), F.lit(shares or 0).cast("decimal(20,0)")
    full = big("source_size") * most * (shares - big("before_weight")) <= big("weight") * (total - big("before_size") * most)
    told = ordered.withColumn("full", full)
    gone = told.where("full").agg(F.coalesce(F.sum(big("source_size") * most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = total - F.lit(gone[0]).cast("decimal(38,0)"), shares - F.lit(gone[1]).cast("decimal(20,0)")
    target = F.when(F.col("full"), (big("source_size") * most).cast("double")).otherwise((big("weight") * rest).cast("double") / left.cast("double"))
    found = told.withColumn("target", target)
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size").cast("double"))
    return found.select("source", "source_size", "target", copies.alias("copies"))


def offset(seed: int):
    """A number in [0, 1) for each source: 48 bits of a hash of seed and source; null hashes as the seed alone."""
    text = F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies and taken (copies times size); with `row`, that column too."""
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("tie"),
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
    )
    sized = saved(own)
    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    aimed = saved(aimed.select(F.col("source").alias("of"), "source_size", "target", "copies", offset(seed).alias("shift")))
    ranked = running(sized, ["source"], [F.col("size").desc(), F.col("doc_id"), F.col("tie"), F.col("row")], {"rank": F.lit(1)}, sized.count())
    upto = lambda k: F.floor(k * F.col("each") + F.col("shift"))
    found = ranked.join(aimed.withColumnRenamed("copies", "each"), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", upto(F.col("rank") + 1) - upto(F.col("rank")))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([] if row is None else [F.col("row").alias(row)]))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the documents' rows, each as often as it is taken."""
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = mix(rows, row="__row", **settings).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    repeated = rows.join(found, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies")))
    return repeated.select(*docs.columns)


def op13_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, place, place % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS shares, coalesce(sum(3 * source_size) OVER r, 0) AS before_size, coalesce(sum(weight) OVER r, 0) AS before_weight
  FROM w WINDOW r AS (ORDER BY source_size * (6 // weight), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (shares - before_weight) <= weight * (total - before_size) AS filled FROM o),
l AS (SELECT *, total - coalesce(sum(3 * source_size) FILTER (WHERE filled) OVER (), 0) AS rest, shares - coalesce(sum(weight) FILTER (WHERE filled) OVER (), 0) AS left_over FROM c),
t AS (SELECT *, CASE WHEN filled THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / left_over::DOUBLE END AS target FROM l),
f AS (SELECT *, CASE WHEN filled THEN 3.0::DOUBLE ELSE target / source_size::DOUBLE END AS each,
  ('0x' || substr(sha256('13' || coalesce(':' || source, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift FROM t),
k AS (SELECT d.doc_id, d.source, d.size, f.source_size, f.target, each, shift, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id)::DOUBLE AS k FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
n AS (SELECT *, (floor(k * each + shift) - floor((k - 1) * each + shift))::BIGINT AS copies FROM k)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM n
"""
