"""Near-duplicate clustering: each record joins its earliest adjacent head, or becomes a head.

Records have a key (earlier keys come first), a block (company and normalised title: only records of one block can be the same posting),
a 64-bit hash of the description as hi and lo (null: no description) and three discriminators: country, city and seniority.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.operators.storage import saved

TILE = 32768  # classes of a block that one task walks
KIND = ("block", "hi", "lo", "country", "city", "seniority")


def conflict(a: Column, b: Column) -> Column:
    """Two known values that differ; an unknown one (null or empty) never conflicts."""
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def city_tokens(city: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(city), F.lit("[a-z0-9]+"), 0))


def city_conflict(a: Column, b: Column) -> Column:
    """Neither city's words contain the other's: "New York" and "New York City" are one place. A city without words is unknown."""
    x, y = city_tokens(a), city_tokens(b)
    apart = (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)
    return F.coalesce(apart & (F.size(x) > 0) & (F.size(y) > 0), F.lit(False))


def classes_of(records: DataFrame) -> DataFrame:
    """(class, rep, ...): records that agree in all that is compared, and the earliest of each.

    They are adjacent to each other and to the same others, so they end in the same cluster: m copies cost one class, not m * m pairs.
    """
    return records.groupBy(F.sha2(F.to_json(F.struct(*KIND)), 256).alias("class")).agg(F.min("key").alias("rep"), *(F.first(c).alias(c) for c in KIND))


class Compared:
    """Records of one or more blocks as arrays: hashes as 64-bit words, discriminators as codes, the words of cities as bit rows."""

    def __init__(self, table: pa.Table):
        code = lambda c: table[c].combine_chunks().dictionary_encode()

        def known(column: str) -> np.ndarray:
            """A code for each value; -1 for unknown ones."""
            coded = code(column)
            values = np.array([-1 if not x else k for k, x in enumerate(coded.dictionary.to_pylist())] + [-1])
            return values[coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)]

        self.rep = table["rep"].to_numpy()
        half = lambda c: table[c].fill_null(0).to_numpy().astype(np.uint64)
        self.value = (half("hi") << np.uint64(32)) | half("lo")
        self.blank = pa.compute.is_null(table["hi"]).to_numpy()
        self.country, self.level = known("country"), known("seniority")
        coded = code("city")
        words = [sorted(set(re.findall("[a-z0-9]+", (x or "").lower()))) for x in coded.dictionary.to_pylist()] + [[]]
        self.city = coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)
        place = {w: k for k, w in enumerate(sorted({w for x in words for w in x}))}
        self.bits = np.zeros((len(words), max(1, -(-len(place) // 64))), np.uint64)
        for k, x in enumerate(words):
            for w in x:
                self.bits[k, place[w] // 64] |= np.uint64(1) << np.uint64(place[w] % 64)

    def cities_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether neither of two cities' words contain the other's, for codes x against codes y; a city without words is unknown."""
        a, b = self.bits[x], self.bits[y]
        rest, other = np.zeros((len(x), len(y)), bool), np.zeros((len(x), len(y)), bool)
        for k in range(self.bits.shape[1]):
            rest |= (a[:, k][:, None] & ~b[:, k]) != 0
            other |= (b[:, k] & ~a[:, k][:, None]) != 0
        return rest & other & a.any(1)[:, None] & b.any(1)

    def adjacent(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Which records x are adjacent to which records y (places): no discriminator conflicts, and the hashes are close or one is unknown."""
        differ = lambda z: (z[x][:, None] != z[y]) & (z[x][:, None] >= 0) & (z[y] >= 0)
        close = (np.bitwise_count(self.value[x][:, None] ^ self.value[y]) <= most) | self.blank[x][:, None] | self.blank[y]
        cx, at_x = np.unique(self.city[x], return_inverse=True)
        cy, at_y = np.unique(self.city[y], return_inverse=True)
        return close & ~differ(self.country) & ~differ(self.level) & ~self.cities_apart(cx, cy)[at_x][:, at_y]


ACROSS = 4096  # records compared at once with STEP others
STEP = 256


def first_adjacent(c: Compared, heads: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """For each record y the place of its first adjacent head in `heads`, -1 if there is none."""
    out = np.full(len(y), -1)
    for i in range(0, len(y), ACROSS):
        part = slice(i, i + ACROSS)
        for j in range(0, len(heads), STEP):
            live = np.flatnonzero(out[part] < 0)
            if not len(live):
                break
            near = c.adjacent(heads[j : j + STEP], y[part][live], most)
            hit = near.any(0)
            out[i + live[hit]] = heads[j + near.argmax(0)[hit]]
    return out


def walk(c: Compared, order: np.ndarray, most: int) -> np.ndarray:
    """For the records of a block, earliest first, the place of each one's head: the first head it is adjacent to, or itself.

    The earliest STEP records that are still open settle among themselves; those that become heads then take what they can of the rest.
    """
    head = np.full(len(order), -1)
    left = np.arange(len(order))
    while len(left):
        now, left = left[:STEP], left[STEP:]
        near = c.adjacent(order[now], order[now], most)
        heads: list[int] = []
        for k, place in enumerate(now):
            first = next((h for h in heads if near[h, k]), None)
            head[place] = order[place] if first is None else order[now[first]]
            if first is None:
                heads.append(k)
        found = first_adjacent(c, order[now[heads]], order[left], most)
        head[left] = found
        left = left[found < 0]
    return head


FIELDS = ("rep", *KIND)


def clustered(records: DataFrame, max_distance: int = 12, tile: int = TILE) -> DataFrame:
    """(key, head) of every record: the heads of a walk through each block, earliest record first.

    Classes of blocks of up to `tile` are walked inside one task. A larger block goes round by round: its earliest `tile` open classes are
    walked, and only their heads are sent to the parts of the block that are still open, which keep what is not adjacent to any. Every
    round settles a tile at least, and a block of near copies is settled by its first heads: no pair of records ever becomes a row.
    """
    classes = saved(classes_of(records))
    rows = classes.count()
    sized = saved(classes.join(classes.groupBy("block").agg(F.count("*").alias("n")), "block").select("n", *FIELDS))
    alone = sized.where("n = 1").select("rep", F.col("rep").alias("head"))
    small = sized.where((F.col("n") > 1) & (F.col("n") <= tile)).drop("n").withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(max(1, rows // tile))))
    told = [alone, _walked(small, "bundle", max_distance)]
    open_ = sized.where(F.col("n") > tile).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / tile)).cast("int"))
    while not open_.isEmpty():
        early = open_.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("rep"))).where(F.col("nth") <= tile).select(*FIELDS)
        settled = saved(_walked(early, "block", max_distance))
        told.append(settled)
        heads = early.join(settled.where("rep = head").select("rep"), "rep", "left_semi")
        rest = open_.join(settled.select("rep"), "rep", "left_anti")
        parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / tile).cast("int") - 1)).alias("part")
        sent = saved(heads.join(open_.select("block", "n").distinct(), "block").select(*FIELDS, parts))
        found = saved(rest.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(_taken(max_distance), "rep bigint, head bigint"))
        told.append(found.where("head is not null"))
        open_ = saved(rest.join(found.where("head is null").select("rep"), "rep", "left_semi"))
    heads = saved(reduce(DataFrame.unionByName, told))
    named = classes.select("class", "rep").join(heads, "rep").select("class", "head")
    return records.select("key", F.sha2(F.to_json(F.struct(*KIND)), 256).alias("class")).join(named, "class").select("key", "head")


def _walked(df: DataFrame, by: str, most: int) -> DataFrame:
    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("rep", "ascending")])
        c = Compared(table)
        block = table["block"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
        heads = [walk(c, np.arange(i, j), most) for i, j in zip(cut, cut[1:], strict=False)]
        return pa.table({"rep": pa.array(c.rep, pa.int64()), "head": pa.array(c.rep[np.concatenate([np.zeros(0, np.int64), *heads]).astype(np.int64)], pa.int64())})

    return df.groupBy(by).applyInArrow(settle, "rep bigint, head bigint")


def _taken(most: int):
    def take(rest: pa.Table, heads: pa.Table) -> pa.Table:
        """The open records of a part with the first new head each is adjacent to; null for those that stay open."""
        heads = heads.sort_by("rep").select(list(FIELDS))
        c = Compared(pa.concat_tables([heads, rest.select(list(FIELDS))]))
        n = heads.num_rows
        found = first_adjacent(c, np.arange(n), np.arange(n, len(c.rep)), most)
        return pa.table({"rep": pa.array(c.rep[n:], pa.int64()), "head": pa.array(c.rep[found], pa.int64(), mask=found < 0)})

    return take


def _dealt(records: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """The classes of records with how many records each has (times), and the same in tiles, bundled for tasks.

    A block's classes are dealt into parts of about `tile`, and each two parts are compared inside one task.
    """
    classes = saved(records.groupBy(F.sha2(F.to_json(F.struct(*KIND)), 256).alias("class")).agg(F.min("key").alias("rep"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in KIND)))
    parts = classes.groupBy("block").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("k"))
    dealt = classes.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat_ws("-", F.least("part", i), F.greatest("part", i)))
    spread = dealt.select(*FIELDS, "times", "part", F.explode(pairs).alias("tile"))
    return classes, spread.withColumn("bundle", F.pmod(F.xxhash64("block", "tile"), F.lit(max(1, classes.count() // (2 * tile)))))


def _compared(table: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(x, y, near, own) for all the tiles of a sorted bundle, some records x at a time: which are adjacent to which records y, none to itself; own: x and y are of one part."""
    c = Compared(table)
    codes = [table[x].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in ("block", "tile")]
    part = table["part"].to_numpy()
    cut = np.flatnonzero(np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]), True]) if table.num_rows else np.zeros(1, np.int64)
    for i, j in zip(cut, cut[1:], strict=False):
        m = i + int(np.searchsorted(part[i:j], part[i], "right"))  # two different parts are compared with each other only
        x, y = (np.arange(i, m), np.arange(m, j)) if m < j else (np.arange(i, j), np.arange(i, j))
        for a in range(0, len(x), STEP):
            near = c.adjacent(x[a : a + STEP], y, most)
            if m == j:
                near[np.arange(len(near)), a + np.arange(len(near))] = False
            yield x[a : a + STEP], y, near, m == j


TILED = [("block", "ascending"), ("tile", "ascending"), ("part", "ascending"), ("rep", "ascending")]


def linked(records: DataFrame, max_distance: int = 12, tile: int = 2048) -> DataFrame:
    """(key, rep, links) of every record: the earliest record of its class, and how many others it is adjacent to.

    A block gives a row for each class and part, however many of its pairs are adjacent.
    """
    classes, bundled = _dealt(records, tile)

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by(TILED)
        times, links = table["times"].to_numpy(), np.zeros(table.num_rows, np.int64)
        for x, y, near, own in _compared(table, max_distance):
            if not own:
                links[y] += times[x] @ near
            links[x] += near @ times[y]
        return pa.table({"rep": table["rep"].combine_chunks().cast(pa.int64()), "links": pa.array(links, pa.int64())})

    counted = bundled.groupBy("bundle").applyInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("class", "rep", "times").join(counted, "rep").select("class", "rep", (F.col("links") + F.col("times") - 1).alias("links"))
    return records.select("key", F.sha2(F.to_json(F.struct(*KIND)), 256).alias("class")).join(named, "class").select("key", "rep", "links")


def pairs(records: DataFrame, max_distance: int = 12, tile: int = 2048) -> DataFrame:
    """(u, v), u < v: every two records that are adjacent.

    Only classes are compared; a task gives the adjacent ones some rows of a tile at a time. Joins then put the records of each class in,
    those of a large one in parts, so that no task holds or makes all the pairs of a class.
    """
    classes, bundled = _dealt(records, tile)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(TILED)
        rep, times = table["rep"].to_numpy(), table["times"].to_numpy()
        for x, y, near, own in _compared(table, max_distance):
            i, j = np.nonzero(near & (x[:, None] < y) if own else near)
            yield pa.record_batch({"a": pa.array(rep[x[i]], pa.int64()), "b": pa.array(rep[y[j]], pa.int64()), "times": pa.array(times[y[j]], pa.int64())})

    found = bundled.groupBy("bundle").applyInArrow(find, "a bigint, b bigint, times bigint")
    copies = classes.where("times > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), "times")
    parts = F.ceil(F.col("times") / tile)
    members = saved(records.select("key", F.sha2(F.to_json(F.struct(*KIND)), 256).alias("class")).join(classes.select("class", "rep", "times"), "class").select("key", "rep", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part")))
    sides = found.unionByName(copies).select("a", "b", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"))
    one = sides.join(members.select(F.col("rep").alias("a"), F.col("key").alias("x")), "a")
    both = one.join(members.select(F.col("rep").alias("b"), "part", F.col("key").alias("y")), ["b", "part"]).where("a <> b OR x < y")
    return both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
