r"""Source divergence audit by count-cell ranking: how the words of each (lang, source) differ from its lang and from its other sources.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; a lang keeps its V terms that are in at least `MIN_DOCS` of its
documents. A kept term that occurs `count` times in a group with N kept occurrences has p = 1 + floor(10^9 (count + 1) / (N + V)), and
f(p, q) = floor((p - q)^2 / q); everything is integers. f depends on counts alone, so it is evaluated once a cell and never once a term:

* part `term` (group against lang): terms are grouped by (group count, lang count); cells with equal values merge, and cumulative
  multiplicities tell which values reach the first `top` ranks; only these are expanded to their terms, in UTF-8 order.
* part `pair` (group against each other source of its lang): the sum over all V terms is that of cells with a zero count on either side,
  which the group's own histogram of counts gives, and a correction for terms that both have. Terms with the same counts in all their
  sources are one cell of that correction, weighed by their number.

Texts are counted where they lie, about a MB at a time: tasks send one row for each (lang, source, term) they hold. No task sees the terms of a group
together, and what is joined by lang has a row for each distinct count or source. The result of `pair` has, by definition, a row for
each two sources of a lang.

Defined cases: null text, lang and source are ''; ids are not read, so repeated rows are documents of their own; groups without terms
take part with count 0; a lang without kept terms gives pairs with value 0 and no term rows; a text of any length is read whole; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.operators.storage import saved

from .kernels import LOWER, ranges, released, slices, utf8

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
PAIRS = 1 << 18  # pairs of entries that a task evaluates at once
HELD = 1 << 17  # counted rows that a task holds before it merges them
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The terms of a batch, lower-cased, and the row of each; terms never cross rows."""
    inside = LETTER[buf]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    begins = offs[:-1][offs[:-1] < offs[-1]]
    head[begins] = inside[begins]
    starts = np.flatnonzero(head)
    cut = np.flatnonzero(head[inside]).astype(np.int64)  # places among the letters alone
    letters = LOWER[buf[inside]]
    cut = np.r_[cut, len(letters)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(letters)]), np.searchsorted(offs, starts, "right") - 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each (lang, source) has each term, and in how many documents; a task sends a (lang, source, term) again only when it holds too many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in slices(batch, "text"):
            held += counted_slice(part)
            if sum(x.num_rows for x in held) > HELD:
                held = merged(held)
                if sum(x.num_rows for x in held) > HELD // 2:
                    yield from held
                    held = []
    yield from merged(held)
    released()


def merged(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not held:
        return []
    sums = pa.Table.from_batches(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches()


def counted_slice(part: pa.RecordBatch) -> list[pa.RecordBatch]:
    found, row = terms(*utf8(part.column("text")))
    if not len(row):
        return []
    coded = found.dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    seen, times = np.unique(row * size + code, return_counts=True)  # a term in a document
    at, inverse = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
    n, docs = np.zeros(len(at), np.int64), np.bincount(inverse, minlength=len(at))
    np.add.at(n, inverse, times)
    g = at // size
    columns = [
        lang.dictionary.take(pa.array(g // len(source.dictionary))).cast(pa.string()),
        source.dictionary.take(pa.array(g % len(source.dictionary))).cast(pa.string()),
        coded.dictionary.take(pa.array(at % size)).cast(pa.string()),
        pa.array(n),
        pa.array(docs.astype(np.int64)),
    ]
    return [pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])]


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each (lang, source, kept term) that occurs: n, the lang's total, and whether the row is its term's first in the lang."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    counts = own.mapInArrow(counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
    return told.where(F.col("docs") >= min_docs).drop("docs")


def whole(c: Column | str, digits: int = 20) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), null if the total is 0."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 1), whole(F.nullif(total, F.lit(0)))) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shared_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two groups, the correction for terms that both have, from profiles: the (gid, p, p0) of a term's groups, and how many terms have them."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["a", "b"], as_index=False).sum()

    held: list[pd.DataFrame] = []
    for batch in batches:
        lists = batch.column("profile")
        cut = lists.offsets.to_numpy()
        gid, p, p0 = (lists.values.field(c).to_numpy() for c in ("gid", "p", "p0"))
        size = np.diff(cut)
        other, begin = np.repeat(size, size), np.repeat(cut[:-1], size)  # for each entry: how many its profile has, and where they begin
        times = np.repeat(batch.column("times").to_numpy(), size)
        base = cut[0] if len(cut) else 0
        done = np.cumsum(other)
        i = 0
        while i < len(other):
            j = max(i + 1, int(np.searchsorted(done, done[i] - other[i] + PAIRS, "right")))
            x = np.repeat(np.arange(i, j) + base, other[i:j])
            y = ranges(begin[i:j], other[i:j])
            x, y = x[x != y], y[x != y]
            value = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
            held.append(summed([pd.DataFrame({"a": gid[x], "b": gid[y], "shared": value * times[x - base]})]))
            i = j
            if sum(map(len, held)) > PAIRS:
                held = [summed(held)]
                if len(held[0]) > PAIRS // 2:
                    yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
    if held:
        yield pa.RecordBatch.from_pandas(summed(held), preserve_index=False)
    released()


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """Both parts: lang, source, part, item, value, rank."""
    kept = saved(term_counts(docs, lang, source, text, min_docs))
    cells = saved(kept.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("times")))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("head").alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("group_n"), F.sum("times").alias("has"))
    zero = lambda *names: [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    groups = docs.select(filled(lang).alias("lang"), filled(source).alias("source")).distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *zero("lang_n", "v", "group_n", "has"))
    groups = saved(groups.withColumn("p0", share(F.lit(0), F.col("group_n") + F.col("v"))).withColumn("gid", F.monotonically_increasing_id()))
    own = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n") + F.col("v")))
    return by_term(kept, own, top).unionByName(by_pair(kept, own, groups))


def by_term(kept: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    """The terms of the first ranks of each group."""
    valued = cells.withColumn("q", share(F.col("total"), F.col("lang_n") + F.col("v"))).where("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    first = merged.withColumn("nth", F.row_number().over(group)).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("times").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = first.withColumn("before", before).where(F.col("before") < top)
    chosen = valued.join(reached.select("lang", "source", "value"), ["lang", "source", "value"]).select("lang", "source", "n", "total", "value")
    expanded = kept.join(chosen, ["lang", "source", "n", "total"])
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def by_pair(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of sources of a lang."""
    big = lambda c: whole(c, 38)
    entry = kept.join(groups, ["lang", "source"]).select("lang", "term", F.struct("gid", share(F.col("n"), F.col("group_n") + F.col("v")).alias("p"), "p0").alias("entry"))
    profiles = entry.groupBy("lang", "term").agg(F.sort_array(F.collect_list("entry")).alias("profile")).where(F.size("profile") > 1)
    shared = profiles.groupBy("profile").agg(F.count("*").alias("times")).mapInArrow(shared_part, "a bigint, b bigint, shared bigint")
    own = cells.groupBy("lang", "gid", "p").agg(F.sum("times").alias("times"))
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q"))
    sides = F.array(
        F.struct(F.col("gid").alias("a"), F.col("other").alias("b"), (big(apart(F.col("p"), F.col("q"))) * whole("times", 10)).alias("part")),
        F.struct(F.col("other").alias("a"), F.col("gid").alias("b"), (big(apart(F.col("q"), F.col("p"))) * whole("times", 10)).alias("part")),
    )
    lone = own.join(other, "lang").where("gid <> other").select(F.explode(sides).alias("s")).select("s.*")
    sums = lone.unionByName(shared.select("a", "b", big("shared").alias("part"))).groupBy("a", "b").agg(F.sum("part").alias("part"))
    left = groups.select("lang", "source", "v", F.col("gid").alias("a"), F.col("has").alias("a_has"), F.col("p0").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("has").alias("b_has"), F.col("p0").alias("q"))
    both = left.join(right, "lang").where("a <> b").join(sums, ["a", "b"], "left")
    neither = big(apart(F.col("p"), F.col("q"))) * whole(F.col("v") - F.col("a_has") - F.col("b_has"))
    value = F.coalesce(F.coalesce(F.col("part"), F.lit(0)) + neither, F.lit(0)).cast("bigint")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
ln AS (SELECT lang, sum(total)::HUGEINT AS lang_n, count(*) AS v FROM l GROUP BY lang),
g AS (SELECT k.lang, k.source, coalesce(lang_n, 0) AS lang_n, coalesce(v, 0) AS v, coalesce(x.group_n, 0)::HUGEINT AS group_n
  FROM (SELECT DISTINCT lang, source FROM d) k LEFT JOIN ln USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY ALL) x USING (lang, source)),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.group_n + g.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (l.total + 1) // (g.lang_n + g.v))::BIGINT AS q
  FROM g JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
