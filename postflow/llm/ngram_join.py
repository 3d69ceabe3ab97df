"""N-gram Jaccard join: documents whose word-shingle sets have Jaccard similarity >= t, joined exactly by pivots and regions.

1. Filter. A partner of a document with n shingles holds all but n - ceil(t n) of them. So among the missing + 1 + n/10 shingles that
   hash lowest, at least 1 + n/10 must also occur in another document. Partitions exchange these shingles (exchange.py); documents that
   fail have no partner. Equal sets become one class. Of the classes, all shingles are exchanged: shingles that no other class holds are
   dropped, which leaves s of n, and a pair can only be linked if both have at least t/(1+t) (n + n') left.
2. Regions. In the whole metric space almost all documents lie at distance 1 from any pivot, so every window would copy everything.
   Regions are therefore gathered around pivots by rare shingles: partners share one of the rarest of their probes, the pivot of a
   probe is the class whose probes are most common around it, and a class belongs to the regions of its probes' pivots. Each class is
   first compared with the pivot that it shares most rare probes with; classes within 1 - t are linked to it, and a region whose classes
   are all connected by then has nothing more to say.
3. Recursion. A region of more than LEAF classes is cut into Voronoi cells of pivots drawn from it: by Spark (`divided`) where it is too
   large for one task, inside the task (`cells`) else. A class goes home to its nearest pivot p, and is copied into the cell of another pivot q if its distance to q is at most the distance to p plus 2 (1 - t), and
   at most the radius of q's cell plus 1 - t: by the triangle inequality, no partner of a class at home in q lies beyond. Cells that are
   still too large are cut again; a region that its windows do not part (all of its classes are about equally far from each other) is
   compared block by block.
4. A region or pair of blocks is joined exactly in one task (`forest`), which gives a spanning forest of its links, never pairs.

A component is named by its smallest document id. Nothing is sampled or capped.

Defined cases: a null text, and one without words, has no shingles and links with nothing; fewer words than a shingle make one shingle;
a null id links with nothing; rows with the same id and text count as one, as do all rows with one id; texts of any length are read
whole; ties between pivots go to the smallest id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from postflow.operators.storage import saved

from . import exchange as ex
from .components import components, followed
from .kernels import U64, mix64, ranges, shingles, slices, utf8, words

TILE = 1 << 20  # shingles that a task compares at once
PIVOTS = 16  # of a region that is cut
LEAF = 64  # classes that are compared without cutting further
ROWS = 1024  # of a block inside a task
SETS = "doc_id bigint, n bigint, same binary, tokens binary"


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its n shingles a document may lack in a partner."""
    return n - -(-percent * n // 100)


def n_probes(n: np.ndarray, s: np.ndarray, percent: int) -> np.ndarray:
    """How many of the s usable shingles of a document of n, the ones that hash lowest, it probes with."""
    return np.minimum(s, s - (n - missing(n, percent)) + 1 + -(-n // 10))


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """How many probes partners have in common at least, whatever the partner's size."""
    smallest = -(-percent * n // 100)
    return np.minimum(1 + -(-smallest // 10), smallest - missing(smallest, percent))


class Sets:
    """The shingle sets of a partition's documents."""

    def __init__(self, table: pa.Table, size: int, percent: int):
        table = table.filter(pa.compute.is_valid(table["doc_id"])).sort_by("doc_id")
        self.table, self.ids = table, table["doc_id"].combine_chunks().to_numpy()
        rows, tokens, at = [np.zeros(0, np.int64)], [np.zeros(0, U64)], 0
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                _, _, row, hashed = words(*utf8(part.column("text")), lower=True)
                row, token = shingles(hashed, row, size, part.num_rows)
                rows.append(row + at)
                tokens.append(token)
                at += part.num_rows
        self.row, self.token = np.concatenate(rows), np.concatenate(tokens)
        self.n = np.bincount(self.row, minlength=len(self.ids))
        self.begin = np.cumsum(self.n) - self.n
        self.may_lack = missing(self.n, percent)
        self.n_probe = n_probes(self.n, self.n, percent)
        self.probe = ranges(self.begin, self.n_probe)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.token[self.probe], return_counts=True)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def linked(home: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """The links (a, b) among pairs (a, b, s) of a class and the pivot of its region, from their whole sets.

    A pivot's classes are dealt into slices of about `tile` shingles, each with the pivot's set once; slices are bundled into tasks of that size.
    """
    weights = home.groupBy("b").agg(F.sum("s").alias("weight"))
    bundles = max(1, -(-(weights.agg(F.sum("weight")).first()[0] or 0) // tile))
    n_slices = F.ceil(F.col("weight") / F.lit(tile)).cast("int")
    own = home.join(weights, "b").select("b", F.col("a").alias("rep"), F.pmod(F.xxhash64("a"), n_slices).cast("int").alias("slice"))
    pivots = weights.select("b", F.col("b").alias("rep"), F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"))
    rows = own.unionByName(pivots).join(sets.select("rep", "n", "tokens"), "rep").withColumn("bundle", F.pmod(F.xxhash64("b", "slice"), F.lit(bundles)))

    def compare(_: tuple, table: pa.Table) -> pa.Table:
        b, part, rep, n = (table[c].to_numpy() for c in ("b", "slice", "rep", "n"))
        tokens = table["tokens"].combine_chunks()
        order = np.lexsort((rep != b, part, b))
        a, pivot, centre, size = [], [], None, 0
        for i in order.tolist():
            own = np.frombuffer(tokens[i].as_buffer(), U64)
            if rep[i] == b[i]:
                centre, size = own, n[i]
            elif common(own, centre) * (100 + percent) >= percent * (n[i] + size):
                a.append(rep[i])
                pivot.append(b[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(pivot, pa.int64())})

    return rows.groupBy("bundle").applyInArrow(compare, "a bigint, b bigint")


def overlaps(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets as 0/1 rows over groups of shingles that the same sets hold, and how many shingles each group has; shingles of one set are left out."""
    lens = np.array([len(x) for x in tokens])
    token, row = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), lens)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, len(token)])
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix64(np.arange(1, len(tokens) + 1, dtype=U64))[row], at) if len(at) else np.zeros(0, U64)
    several = np.flatnonzero(count > 1)
    _, first, weight = np.unique(name[several], return_index=True, return_counts=True)
    first = several[first]
    held = count[first]
    out = np.zeros((len(tokens), len(first)), np.float32)
    out[row[ranges(at[first], held)], np.repeat(np.arange(len(first)), held)] = 1
    return out, weight.astype(np.float32)


def jaccard_distances(x: list[np.ndarray], n: np.ndarray, y: list[np.ndarray], m: np.ndarray) -> np.ndarray:
    """The distances of sets x (of n shingles in all) to sets y (of m); what is not among the usable shingles is in no intersection."""
    both = np.zeros((len(x), len(y)), np.float32)
    for left, right in shared_parts(x, y):
        both += left @ right.T
    both = both.astype(np.float64)
    return 1 - both / np.maximum(n[:, None] + m - both, 1)


def cells(far: np.ndarray, percent: int) -> list[np.ndarray]:
    """The Voronoi cells of pivots, with copies of boundary classes, as rows of far (class by pivot).

    A class is at home with its nearest pivot. A partner of a class at home in cell q is at most 1 - t from it, so its distance to q is at most
    that to its own nearest pivot plus 2 (1 - t), and at most the radius of the cell plus 1 - t.
    """
    eps = 1 - percent / 100 + 1e-6
    home = far.argmin(1)
    own = home[:, None] == np.arange(far.shape[1])
    radius = np.where(own, far, -1.0).max(0)
    inside = own | ((far <= far.min(1)[:, None] + 2 * eps) & (far <= radius + eps))
    return [np.flatnonzero(inside[:, k]) for k in range(far.shape[1]) if own[:, k].any()]


def forest(rep: np.ndarray, group: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of a region as all links of its classes would. Groups are connected already.

    A region of more than LEAF classes is cut into Voronoi cells, again and again; cells that their windows do not part are compared as they are.
    """
    order = np.argsort(n, kind="stable")
    rep, group, n, tokens = rep[order], np.unique(group[order], return_inverse=True)[1], n[order], [tokens[i] for i in order]
    links: list[tuple[int, int]] = []
    spread = mix64(rep.astype(U64))
    open_ = [np.arange(len(rep))]
    while open_:
        own = open_.pop()
        if group[own].min() == group[own].max():
            continue
        if len(own) <= LEAF:
            links += between(own, rep, group, n, tokens, percent)
            continue
        centres = own[np.sort(np.argsort(spread[own], kind="stable")[:PIVOTS])]
        far = np.concatenate([jaccard_distances([tokens[i] for i in own[a : a + ROWS]], n[own[a : a + ROWS]], [tokens[i] for i in centres], n[centres]) for a in range(0, len(own), ROWS)])
        parted = [own[cell] for cell in cells(far, percent)]
        if sum(len(x) ** 2 for x in parted) > 0.8 * len(own) ** 2:  # windows that copy too much save nothing
            links += between(own, rep, group, n, tokens, percent)
        else:
            open_ += parted
    return links


def between(own: np.ndarray, rep: np.ndarray, group: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of the classes `own` (places, by size) as all their links would; joined groups get one name."""
    links = []
    for a in range(0, len(own), ROWS):
        for b in range(a, len(own), ROWS):
            i, j = own[a : a + ROWS], own[b : b + ROWS]
            if percent * n[j[0]] > 100 * n[i[-1]] or (group[i].min() == group[j].max() and group[i].max() == group[j].min()):
                continue
            both = np.zeros((len(i), len(j)), np.float32)
            for x, y in shared_parts([tokens[k] for k in i], [tokens[k] for k in j] if a != b else None):
                both += x @ y.T
            link = both.astype(np.int64) * (100 + percent) >= percent * (n[i][:, None] + n[j])
            for k in np.flatnonzero((link & (group[i][:, None] != group[j])).any(1)):
                near = j[link[k]]
                near = near[group[near] != group[i[k]]]
                if len(near):
                    others, first = np.unique(group[near], return_index=True)
                    links += [(int(rep[i[k]]), int(rep[x])) for x in near[first]]
                    group[np.isin(group, others)] = group[i[k]]
    return links


def shared_parts(x: list[np.ndarray], y: list[np.ndarray] | None, budget: int = 1 << 22):
    """Matrices whose products add up to the sizes of the intersections of each x with each y (None: x itself), a range of shingles at a time."""
    both = x if y is None else x + y
    total = sum(map(len, both))
    cuts = max(1, -(-total * len(both) // budget))
    edges = [int(k * 2**64 // cuts) for k in range(1, cuts)]
    bounds = [np.r_[0, np.searchsorted(t, np.array(edges, U64)) if cuts > 1 else [], len(t)].astype(np.int64) for t in both]
    for k in range(cuts):
        rows, weight = overlaps([t[e[k] : e[k + 1]] for t, e in zip(both, bounds, strict=True)])
        if len(weight):
            left = rows[: len(x)] * weight
            yield left, rows if y is None else rows[len(x) :]


def compared(regions: DataFrame, percent: int, weight: int, tile: int) -> DataFrame:
    """Links (a, b) that join the groups of each region (region, rep, component, n, tokens). weight: the shingles of all regions."""
    bundles = max(1, -(-weight // tile))

    def judge(_: tuple, table: pa.Table) -> pa.Table:
        region = table["region"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(region, kind="stable")
        rep, group, n = (table[c].to_numpy()[order] for c in ("rep", "component", "n"))
        tokens = table["tokens"].combine_chunks().take(pa.array(order))
        at = np.r_[0, np.flatnonzero(np.diff(region[order])) + 1, len(order)]
        links = []
        for i, j in zip(at, at[1:], strict=False):
            _, once = np.unique(rep[i:j], return_index=True)
            mine = i + once
            if len(mine) > 1 and len(np.unique(group[mine])) > 1:
                links += forest(rep[mine], group[mine], n[mine], [np.frombuffer(tokens[k].as_buffer(), U64) for k in mine.tolist()], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return regions.withColumn("bundle", F.pmod(F.xxhash64("region"), F.lit(bundles))).groupBy("bundle").applyInArrow(judge, "a bigint, b bigint")


def mixed(regions: DataFrame) -> DataFrame:
    """(region, weight, classes) of the regions whose classes are not all in one group."""
    sums = regions.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("s").alias("weight"), F.count("*").alias("classes"))
    return sums.where("lo < hi").select("region", "weight", "classes")


def divided(regions: DataFrame, sets: DataFrame, percent: int, tile: int, level: int) -> DataFrame:
    """Each region (region, weight, rep, component, n, s) cut into the Voronoi cells of PIVOTS of its classes, boundary classes copied; sets has the tokens."""
    eps = 1 - percent / 100 + 1e-9
    drawn = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit(level), "rep"), "rep"))
    pivots = regions.select("region", "weight", "rep").withColumn("pivot", drawn).where(F.col("pivot") <= PIVOTS)
    n_slices = F.ceil(F.col("weight") / F.lit(tile)).cast("int")
    pivots = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1))).select("region", "slice", "rep", "pivot")
    dealt = regions.withColumn("slice", F.pmod(F.xxhash64("rep"), n_slices).cast("int")).select("region", "slice", "rep", F.lit(0).alias("pivot"))
    rows = dealt.unionByName(pivots).join(sets.select("rep", "n", "tokens"), "rep")

    def measure(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "ascending"), ("rep", "ascending")])
        rep, pivot, n = (table[c].to_numpy() for c in ("rep", "pivot", "n"))
        tokens = [np.frombuffer(x.as_buffer(), U64) for x in table["tokens"]]
        own, centres = np.flatnonzero(pivot == 0), np.flatnonzero(pivot > 0)
        far = np.empty((len(own), len(centres)))
        for k, c in enumerate(centres):
            both = np.array([common(tokens[i], tokens[c]) for i in own])
            far[:, k] = 1 - both / (n[own] + n[c] - both)
        home = far.argmin(1) if len(own) else np.zeros(0, np.int64)
        least = far[np.arange(len(own)), home]
        i, k = np.nonzero(far <= least[:, None] + 2 * eps)
        region = table["region"].combine_chunks().take(pa.array(own[i]))
        return pa.table({"region": region, "cell": pa.array(k, pa.int32()), "rep": pa.array(rep[own[i]]), "far": pa.array(far[i, k]), "home": pa.array(k == home[i])})

    near = saved(rows.groupBy("region", "slice").applyInArrow(measure, "region string, cell int, rep bigint, far double, home boolean"))
    radius = near.where("home").groupBy("region", "cell").agg(F.max("far").alias("radius"))
    inside = near.join(radius, ["region", "cell"]).where(F.col("home") | (F.col("far") <= F.col("radius") + eps))
    back = regions.select("region", "rep", "component", "n", "s", F.col("classes").alias("before"))
    return inside.join(back, ["region", "rep"]).select(F.concat_ws(".", "region", "cell").alias("region"), "rep", "component", "n", "s", "before")


def tiled(regions: DataFrame, tile: int) -> DataFrame:
    """Each region dealt into blocks of about half a tile, and every pair of blocks as a region."""
    k = F.ceil(2 * F.col("weight") / F.lit(tile)).cast("int")
    dealt = regions.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat_ws("-", "region", F.least("block", i), F.greatest("block", i)))
    return dealt.select(F.explode(pairs).alias("region"), "rep", "component", "n", "s")


def joined(regions: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links that join the groups of all regions (region, rep, component, n, s), recursively."""
    found, level = [], 0
    ready = None
    regions = regions.withColumn("before", F.lit(None).cast("bigint"))
    while True:
        regions = saved(regions.join(saved(mixed(regions)), "region"))  # saved, so that the join alone shuffles and can split a large region
        small = regions.where(F.col("weight") <= tile).select("region", "rep", "component", "n", "s")
        ready = small if ready is None else ready.unionByName(small)
        large = regions.where(F.col("weight") > tile)
        compact = large.where(F.col("classes") > 0.7 * F.col("before"))
        ready = ready.unionByName(tiled(compact, tile))
        regions = large.where(F.col("before").isNull() | (F.col("classes") <= 0.7 * F.col("before")))
        if regions.isEmpty():
            break
        level += 1
        regions = divided(regions, sets, percent, tile, level)
    ready = ready.join(sets.select("rep", "tokens"), "rep")
    weight = ready.agg(F.sum("s")).first()[0] or 0
    return compared(ready, percent, weight, tile)


def join(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id. percent: the least similarity, in hundredths; tile: the shingles that a task compares at once."""
    sets, members = classed(docs, size, percent, doc_id, text, tile)
    alone = sets.where("same is null").select("doc_id", "n", F.col("doc_id").alias("component"))  # most documents, which need no join
    linked = sets.where("same is not null").join(members, "same").select("doc_id", "n", "component")
    return alone.unionByName(linked).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, order: str, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates, and of each group of them the one with the smallest `order`, then doc_id; all columns but doc_id.

    doc_id tells rows apart; a null one links with nothing. Rows without words with the same `order` and text are one. Only texts that share
    enough shingles with others are shuffled a second time.
    """
    columns = [c for c in docs.columns if c != doc_id]
    sets, members = classed(docs, size, percent, doc_id, text, carry=tuple(columns))
    carried = dict(zip(columns, (f"carry_{i}" for i in range(len(columns))), strict=True))
    out = [F.col(at).alias(c) for c, at in carried.items()]
    linked = sets.where("same is not null")
    first = F.min(F.struct(F.col(carried[order]).alias("order"), "doc_id")).alias("first")
    stay = saved(linked.select("doc_id", carried[order], "same").join(members, "same").groupBy("component").agg(first).select("first.doc_id"))
    kept = linked.join(stay, "doc_id", "left_semi").select(out)
    alone = sets.where("same is null and (n > 0 or doc_id is null)").select(out)
    wordless = sets.where("same is null and n = 0 and doc_id is not null").groupBy(carried[order], carried[text]).agg(F.min_by(F.struct(*out), "doc_id").alias("row"))
    return alone.unionByName(kept).unionByName(wordless.select("row.*"))


def classed(docs: DataFrame, size: int, percent: int, doc_id: str, text: str, tile: int = TILE, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, same) of each document, same being null where it has no partner, and the component of each class of equal sets (same, component).

    carry names columns of the documents to take along, as carry_0, carry_1, ...
    """
    own_text = text if docs.schema[text].dataType == StringType() else None  # taken along as it is, not twice
    along = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry) if c != own_text]
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *along)
    shape_of_sets = StructType.fromDDL(SETS)
    for i, c in enumerate(carry):
        shape_of_sets.add(f"carry_{i}", docs.schema[c].dataType)
    shape = ex.layout(own)
    n_buckets, parted = shape.buckets, ex.dealt(own, "doc_id", shape.parts, "text")

    def extract(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return Sets(table, size, percent).keys()

    def survive(_: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        x = Sets(table, size, percent)
        keys, _n = x.keys()
        shared = ex.told(replies, 0, ex.bucket_of(keys, n_buckets)) > 0
        probes = x.token[x.probe]
        hits = np.bincount(x.row[x.probe], shared[np.searchsorted(keys, probes)] if len(keys) else None, len(x.ids)) if len(probes) else np.zeros(len(x.ids))
        alive = np.flatnonzero((x.n > 0) & (hits >= x.n_probe - x.may_lack))
        same, tokens = np.full(len(x.ids), None, object), np.full(len(x.ids), None, object)
        seen = set()
        with np.errstate(over="ignore"):
            other = mix64(x.token + U64(0x9E3779B97F4A7C15))
        for i in alive.tolist():
            part = slice(x.begin[i], x.begin[i] + x.n[i])
            own = np.array([x.n[i], np.add.reduce(x.token[part]), np.add.reduce(other[part])], U64).tobytes()
            same[i] = own
            if own not in seen:
                seen.add(own)
                tokens[i] = x.token[part].tobytes()
        carried = lambda rows: {f"carry_{i}": rows["text" if c == own_text else f"carry_{i}"] for i, c in enumerate(carry)}
        lost = pa.compute.invert(pa.compute.is_valid(table["doc_id"]))
        n_lost = pa.compute.sum(lost).as_py() or 0
        out = {"doc_id": pa.array(x.ids, pa.int64()), "n": pa.array(x.n, pa.int64()), "same": pa.array(same, pa.binary()), "tokens": pa.array(tokens, pa.binary())}
        found = pa.table(out | carried(x.table))
        if n_lost:
            nameless = table.filter(lost).set_column(table.schema.get_field_index("doc_id"), "doc_id", pa.array(np.arange(n_lost)))
            n = Sets(nameless, size, percent).n
            found = pa.concat_tables([found, pa.table({"doc_id": pa.nulls(n_lost, pa.int64()), "n": pa.array(n, pa.int64()), "same": pa.nulls(n_lost, pa.binary()), "tokens": pa.nulls(n_lost, pa.binary())} | carried(nameless))])
        return found

    replies = ex.shared_keys(parted, extract, n_buckets)
    sets = saved(parted.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(survive, shape_of_sets))
    classes = saved(sets.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("tokens").alias("tokens")))

    shape = ex.layout(classes, "tokens")
    n_classes, usable = shape.buckets, ex.dealt(classes.select("rep", "n", "tokens"), "rep", shape.parts)

    def whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(ex.gather(table, "tokens", U64), return_counts=True)

    def thin(_: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, _n = whole(table)
        shared = keys[ex.told(replies, 0, ex.bucket_of(keys, n_classes)) > 0]
        rows = [np.frombuffer(x.as_buffer(), U64) for x in table["tokens"]]
        rows = [x[ex.lookup(shared, x) >= 0] for x in rows]
        n, s = table["n"].to_numpy(), np.array([len(x) for x in rows], np.int64)
        keep = pa.array(s >= n - missing(n, percent))
        out = {"rep": table["rep"].combine_chunks(), "n": pa.array(n), "s": pa.array(s), "tokens": pa.array([x.tobytes() for x in rows], pa.binary())}
        return pa.table(out).filter(keep)

    asked = ex.shared_keys(usable, whole, n_classes)
    rivals = saved(usable.groupBy("pid").cogroup(asked.groupBy("pid")).applyInArrow(thin, "rep bigint, n bigint, s bigint, tokens binary"))

    may_lack = F.col("n") - F.ceil(F.col("n") * percent / 100)
    n_low = F.least("s", F.col("s") - (F.col("n") - may_lack) + 1 + F.ceil(F.col("n") / 10)).cast("int")
    lowest = rivals.withColumn("p", n_low).select("rep", "n", "s", F.expr("substring(tokens, 1, 8 * p)").alias("tokens"))

    def probes(batches):
        for batch in batches:
            n, s = batch.column("n").to_numpy(), batch.column("s").to_numpy()
            p = n_probes(n, s, percent)
            k = p - least_common(n, percent) + 1
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens")]
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])), "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), p)), "n": pa.array(np.repeat(n, p)), "s": pa.array(np.repeat(s, p)), "k": pa.array(np.repeat(k, p))})

    low = lowest.mapInArrow(probes, "token bigint, rep bigint, n bigint, s bigint, k bigint")
    low = low.join(low.groupBy("token").agg(F.count("*").alias("df")), "token")
    rarest = F.row_number().over(Window.partitionBy("rep").orderBy("df", "token"))
    low = low.withColumn("rank", rarest).where("rank <= k and df > 1").select("token", "rep", "n", "s", F.avg("df").over(Window.partitionBy("rep")).alias("score"))
    low = saved(low)
    best = F.max(F.struct("score", (-F.col("rep")).alias("minus"), "n", "s"))
    pivots = low.groupBy("token").agg(best.alias("p")).select("token", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.s").alias("pivot_s"))
    fits = (F.col("n") + F.col("pivot_n")) * percent <= F.least("s", "pivot_s") * (100 + percent)
    members = saved(low.join(pivots, "token").groupBy("rep", "pivot").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("s").alias("s"), F.first(fits).alias("fits")))
    home = members.where("fits and rep <> pivot").groupBy("rep").agg(F.max(F.struct("m", (-F.col("pivot")).alias("minus"), "s")).alias("h")).select(F.col("rep").alias("a"), (-F.col("h.minus")).alias("b"), "h.s")
    links = saved(linked(home, rivals, percent, tile))

    # classes with one name are connected: that of the pivot they are linked to, or of that pivot's own
    groups = followed(links.select(F.col("a").alias("node"), F.col("b").alias("to")))
    regions = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    regions = regions.select(F.col("pivot").cast("string").alias("region"), "rep", F.coalesce("to", "rep").alias("component"), "n", "s")
    links = links.union(joined(saved(regions), rivals, percent, tile))

    found = components(links).select(F.col("node").alias("rep"), "component")
    return sets, classes.select("same", "rep").join(found, "rep", "left").select("same", F.coalesce("component", "rep").alias("component"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)
