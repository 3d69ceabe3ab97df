"""Embedding near-dedup: exact cosine links inside each label, by PCA-ordered tiled comparison.

Equal vectors count as one with a multiplicity. The unit vectors are turned into PCA order (a rotation keeps cosines); two vectors with
cosine >= t differ by at most sqrt(2 - 2t) in their first coordinate, so each label is cut into cells of that width and only equal and
neighbouring cells meet. Cells are dealt into blocks of about BLOCK vectors, and each pair of blocks is one tile. In a tile, products
are summed over the leading coordinates first; a pair is given up when the sum so far plus the product of its suffix norms cannot reach
the threshold. What is left is decided by the cosine of the given vectors in double precision. A tile returns a count for each of its
vectors and a spanning forest of its links, never the links themselves, so a dense group costs no more rows than a sparse one.

The rotation comes from at most SAMPLE vectors (those whose id hashes lowest); any rotation gives the same links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with
nothing; vectors of different lengths do not link; rows with the same id are separate vectors; equal vectors count as links of each other;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved

from .components import components

BLOCK = 1500
STRIP = 256
SAMPLE = 4096
FINE = 1e-100
CHUNKS = (8, 16, 32, 64, 128, 256, 512)
PREPARED = "vec_id bigint, label string, dim int, same binary, cell int, vector binary"
TILE = "a bigint, b bigint, n bigint"


def doubles(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of an array column in double precision; None where a vector can link with nothing."""
    out: list[np.ndarray | None] = []
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    at = 0
    for n in sizes:
        v = flat[at : at + n]
        at += n
        most = np.abs(v).max() if n else 0.0
        if not np.isfinite(most) or most == 0:
            out.append(None)
        elif FINE < most < 1 / FINE:
            out.append(v)
        else:  # squares would overflow or vanish; a power of two changes no cosine
            out.append(np.ldexp(v, -int(np.frexp(most)[1])))
    return out


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length in the sample, the principal axes as columns, the widest first."""
    rows = vectors.where("vector is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for v in doubles(rows["vector"].combine_chunks()) if rows.num_rows else []:
        if v is not None:
            found.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {n: np.linalg.eigh(np.cov(np.stack(x).T) if len(x) > 1 and n > 1 else np.eye(n))[1][:, ::-1] for n, x in found.items()}


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine(x[i], y[j]) >= threshold, STRIP rows of x at a time."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    dim, least = x.shape[1], threshold - 1e-9
    tail = lambda w, d: np.sqrt(np.einsum("ij,ij->i", w[:, d:], w[:, d:]))
    cuts = [c for c in CHUNKS if c < dim] + [dim]
    tails_u, tails_v = [tail(u, c) for c in cuts], [tail(v, c) for c in cuts]
    found = []
    for a in range(0, len(x), STRIP):
        rows = slice(a, a + STRIP)
        total = u[rows, : cuts[0]] @ v[:, : cuts[0]].T
        i, j = np.nonzero(total + np.outer(tails_u[0][rows], tails_v[0]) >= least)
        total, i = total[i, j], i + a
        for k in range(1, len(cuts)):
            if not len(i):
                break
            part = slice(cuts[k - 1], cuts[k])
            if len(i) * 8 > len(u[rows]) * len(v):  # most pairs are still open: their next products as one matrix, else one by one
                total = total + (u[rows, part] @ v[:, part].T)[i - a, j]
            else:
                total = total + np.einsum("ij,ij->i", u[i, part], v[j, part])
            keep = total + tails_u[k][i] * tails_v[k][j] >= least
            i, j, total = i[keep], j[keep], total[keep]
        sure = [np.einsum("ij,ij->i", x[i[k : k + 50_000]], y[j[k : k + 50_000]]) / (nx[i[k : k + 50_000]] * ny[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)]
        keep = np.concatenate(sure) >= threshold if sure else np.zeros(0, bool)
        found.append((i[keep], j[keep]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the same components."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def near_dedup(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id and kept."""
    own = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"), F.col(label).cast("string").alias("label"))
    axes = rotation(own)
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6))) * (1 + 1e-9)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = doubles(batch.column("vector"))
            dim, same, cell, raw = [], [], [], []
            for v in vs:
                dim.append(0 if v is None else len(v))
                raw.append(None if v is None else v.tobytes())
                same.append(None if v is None else hashlib.blake2b(raw[-1], digest_size=16).digest())
                cell.append(0 if v is None else int(np.floor(v @ (axes[len(v)][:, 0] if len(v) in axes else np.eye(len(v))[0]) / np.linalg.norm(v) / width)))
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "dim": pa.array(dim, pa.int32()), "same": pa.array(same, pa.binary()), "cell": pa.array(cell, pa.int32()), "vector": pa.array(raw, pa.binary())}
            )

    ready = own.mapInArrow(prepare, PREPARED)
    able = ready.where("same is not null and label is not null and vec_id is not null")
    kind = ["label", "dim", "same"]
    classes = saved(able.groupBy(*kind).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("cell").alias("cell"), F.first("vector").alias("vector")))
    sizes = classes.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("k"))
    after = sizes.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("k").alias("k_next"))
    before = sizes.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("k").alias("k_last"))
    place = ["label", "dim", "cell"]
    sizes = sizes.join(after, place, "left").join(before, place, "left").fillna(0, ["k_next", "k_last"])
    dealt = classes.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("rep"), "k").cast("int"))
    tile = lambda cell, x, y, step: F.struct(cell.alias("at"), x.alias("x"), y.alias("y"), F.lit(step).alias("step"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    block, cell = F.col("block"), F.col("cell")
    tiles = F.concat(
        F.transform(upto("k"), lambda i: tile(cell, F.least(block, i), F.greatest(block, i), 0)),
        F.transform(upto("k_next"), lambda i: tile(cell, block, i, 1)),
        F.transform(upto("k_last"), lambda i: tile(cell - 1, i, block, 1)),
    )
    spread = dealt.withColumn("tile", F.explode(tiles)).select("label", "dim", "tile", "cell", "block", "rep", "many", "vector")

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        dim, at = group[1].as_py(), group[2].as_py()
        table = table.sort_by("rep")
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, dim)
        block, cell, rep, many = (table[c].to_numpy() for c in ("block", "cell", "rep", "many"))
        alone = at["step"] == 0 and at["x"] == at["y"]
        left = np.flatnonzero((block == at["x"]) & (cell == at["at"]))
        right = left if alone else np.flatnonzero((block == at["y"]) & (cell == at["at"] + at["step"]))
        base = axes.get(dim, np.eye(dim))
        i, j = close_pairs(x[left], x[right], base, threshold)
        i, j = left[i], right[j]
        if alone:
            i, j = i[i < j], j[i < j]
        count = np.bincount(i, many[j], len(rep)).astype(np.int64) + np.bincount(j, many[i], len(rep)).astype(np.int64)
        links = forest(len(rep), i, j)
        busy = np.flatnonzero(count)
        a, b = np.array([p[0] for p in links], np.int64), np.array([p[1] for p in links], np.int64)
        return pa.table({"a": pa.array(np.r_[rep[busy], rep[a]]), "b": pa.array([None] * len(busy) + rep[b].tolist(), pa.int64()), "n": pa.array(np.r_[count[busy], np.zeros(len(a), np.int64)])})

    seen = saved(spread.groupBy("label", "dim", "tile").applyInArrow(compare, TILE))
    counts = seen.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(seen.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    told = classes.select(*kind, "rep", "many").join(counts, "rep", "left").join(joined, "rep", "left")
    rows = ready.select("vec_id", "label", "dim", "same").join(told.withColumnRenamed("rep", "class"), kind, "left")
    linked = F.col("class").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("component", "class")).otherwise(F.col("vec_id"))
    links = F.when(linked, F.col("many") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    return rows.select("vec_id", links.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
