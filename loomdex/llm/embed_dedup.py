"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are grouped into classes of equal vectors first, by 128 bits of hash. The second-moment matrix of all unit vectors
gives the axes; representatives are sorted by grid cells of the leading axes, whose width is the largest distance that
linked vectors may have along any axis, and cut into blocks by their rank among all, so that there are as many blocks as
the vectors fill, however many tasks there are. Blocks meet if they hold adjoining cells and the boxes of their leading
coordinates are near enough for a link. A pair of blocks is compared by stretches of leading dimensions: partial products
plus the product of the norms of what is left bound the cosine from above; what cannot reach the threshold stops there,
and each stretch multiplies only rows and columns that still have a pair. Pairs that are left are decided by the cosine of
the original vectors in double precision, so links are exact. A pair of blocks returns link counts and a spanning forest of
its links, never the pairs themselves. A block is sent once with every PEERS blocks that it meets.

Vectors of each length are compared among themselves; vectors of different lengths have no cosine and do not link; more than
MOST_LENGTHS lengths are an error. Null vectors, vectors with null or non-finite components, and zero and empty vectors link
with nothing: n_links 0, component_id = vec_id, kept. Repeated rows count as vectors of their own, as equal vectors do. A null
vec_id gives n_links 0, a null component and kept false. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shared import arrow_rows, bounded, components, cut, forest, tidy

THRESHOLD = 0.95
#: Vectors in a block.
BLOCK = 4096
#: Leading axes that make the grid: so many, and one more for every tenfold of blocks beyond 100.
GRID_AXES = 2
#: Leading coordinates whose least and greatest values are kept for each block.
BOX_AXES = 8
#: Blocks that meet another one in one task.
PEERS = 8
#: Different lengths beyond so many are an error: each has axes and tiles of its own.
MOST_LENGTHS = 64
#: Dimensions after which a tile is pruned.
STAGES = (16, 32, 64, 128, 256, 512)
#: Pairs decided at once, one by one; denser stretches are decided by one product of their rows and columns.
SPARSE = 0.02


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors, as columns, of the mean outer product of all unit vectors; largest eigenvalue first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for pdf in frames:
            if len(pdf):
                u = unit(np.stack(pdf["v"].to_numpy()))
                total += u.T @ u
        yield pd.DataFrame({"at": range(dims), "row": list(total)})

    parts = vectors.select("v").mapInPandas(tidy(run), "at int, row array<double>")
    sums = parts.groupBy("at").agg(*[F.sum(F.col("row")[i]).alias(f"s{i}") for i in range(dims)])
    moment = np.zeros((dims, dims))
    for r in sums.collect():  # dims rows
        moment[r["at"]] = r[1:]
    _, vectors_ = np.linalg.eigh((moment + moment.T) / 2)
    return vectors_[:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of a and b with cosine >= threshold, in stretches; i < j if a and b are the same block."""
    ua, ub = unit(a), unit(b)
    za, zb = (ua @ rotation).astype(np.float32), (ub @ rotation).astype(np.float32)
    dims = a.shape[1]
    stops = [s for s in STAGES if s < dims]
    left = {s: (np.linalg.norm(za[:, s:], axis=1), np.linalg.norm(zb[:, s:], axis=1)) for s in stops}
    # rounding of single-precision partial products is far below this
    floor = np.float32(threshold - 1e-4)
    for at in range(0, len(a), 256):
        rows, columns, done = np.arange(at, min(at + 256, len(a))), np.arange(len(b)), 0
        product, alive = np.zeros((len(rows), len(b)), np.float32), np.ones((len(rows), len(b)), bool)
        if same:
            alive &= rows[:, None] < columns[None, :]
        for s in stops:
            product += za[rows, done:s] @ zb[columns, done:s].T
            alive &= product + left[s][0][rows, None] * left[s][1][None, columns] >= floor
            done = s
            r, c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if len(r) < len(rows) or len(c) < len(columns):
                rows, columns, product, alive = rows[r], columns[c], product[np.ix_(r, c)], alive[np.ix_(r, c)]
            if not len(rows):
                break
        if not alive.size:
            continue
        i, j = np.nonzero(alive)
        if len(i) <= SPARSE * alive.size:
            for k in range(0, len(i), 1 << 14):
                p, q = rows[i[k : k + (1 << 14)]], columns[j[k : k + (1 << 14)]]
                keep = np.einsum("nd,nd->n", ua[p], ub[q]) >= threshold
                yield p[keep], q[keep]
        else:
            i, j = np.nonzero(alive & (ua[rows] @ ub[columns].T >= threshold))
            yield rows[i], columns[j]


def blocks_of(reps: DataFrame, rotation: np.ndarray, threshold: float, block: int, grid_axes: int) -> DataFrame:
    """(block, cells array<array<int>>, lo, hi array<double>, ids, sizes, data binary): reps in order of their grid cells, cut by rank."""
    dims = len(rotation)
    used = min(grid_axes, dims)
    width = math.sqrt(2 * (1 - threshold)) * (1 + 1e-6) + 1e-9

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                z = unit(np.stack(pdf["v"].to_numpy())) @ rotation[:, : max(used, min(BOX_AXES, dims))]
                cells = np.floor(z[:, :used] / width).astype(int)
                yield pdf[["rep", "size"]].assign(cell=list(cells), z=list(z), raw=[np.asarray(v, "<f8").tobytes() for v in pdf["v"]])

    placed = reps.mapInPandas(tidy(place), "rep long, size long, cell array<int>, z array<double>, raw binary")
    by = [F.col("cell"), F.col("z")[0], F.col("rep")]
    # cut: ranges are found by sampling, and both reads must see the same rows in the same order
    spread = cut(placed.repartitionByRange(*by).sortWithinPartitions(*by))
    sizes = {r["p"]: r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # a row per partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = before.get(TaskContext.get().partitionId(), 0)
        for pdf in frames:
            number = (rank + np.arange(len(pdf))) // block
            rank += len(pdf)
            for n in np.unique(number).tolist():
                part = pdf[number == n]
                z = np.stack(part["z"].to_numpy())
                cells = np.unique(np.stack(part["cell"].to_numpy()), axis=0)
                yield pd.DataFrame({"block": [n], "cells": [[c.tolist() for c in cells]], "lo": [z.min(0)], "hi": [z.max(0)], "ids": [part["rep"].to_numpy("<i8").tobytes()], "sizes": [part["size"].to_numpy("<i8").tobytes()], "data": [b"".join(part["raw"])]})

    schema = "block long, cells array<array<int>>, lo array<double>, hi array<double>, ids binary, sizes binary, data binary"
    parts = spread.mapInPandas(tidy(pieces), schema)
    extreme = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(max(used, min(BOX_AXES, dims)))]).alias(c)
    packed = F.struct("ids", "sizes", "data")
    out = parts.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"), extreme(F.min, "lo"), extreme(F.max, "hi"), F.collect_list(packed).alias("parts"))
    return cut(out)


def links(reps: DataFrame, dims: int, threshold: float = THRESHOLD, block: int = BLOCK, grid_axes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rep, n_links) and (a, b): counts of vectors linked to each representative, and edges that connect what links connect.

    reps: (rep long, size long, v array<double>), distinct vectors of one length."""
    spark = reps.sparkSession
    rotation = axes(reps, dims)
    if grid_axes is None:
        grid_axes = GRID_AXES + max(0, math.ceil(math.log10(max(1, reps.count() / block / 100))))
    blocks = blocks_of(reps, rotation, threshold, block, grid_axes)
    meta = blocks.select("block", "cells", "lo", "hi")
    near = F.col("cell")
    around = meta.select(F.col("block").alias("p"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.explode("cells").alias("cell"))
    for i in range(min(grid_axes, dims)):
        around = around.withColumn(f"c{i}", F.explode(F.sequence(near[i] - 1, near[i] + 1)))
    cell = [f"c{i}" for i in range(min(grid_axes, dims))]
    around = around.select("p", "p_lo", "p_hi", *cell).distinct()
    there = meta.select(F.col("block").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.explode("cells").alias("cell"))
    there = there.select("q", "q_lo", "q_hi", *[near[i].alias(c) for i, c in enumerate(cell)])
    # unit vectors with this cosine are this far apart at most; boxes that are farther hold no link
    gaps = F.zip_with(F.zip_with("p_lo", "q_hi", lambda x, y: x - y), F.zip_with("q_lo", "p_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x)
    pairs = around.join(there, cell).where(F.col("p") <= F.col("q")).where(apart <= 2 * (1 - threshold) + 1e-9).select("p", "q").distinct()
    # a group of pairs: p, and some of the q that it meets
    pairs = cut(pairs.withColumn("peers", F.floor(F.col("q") / PEERS)))
    first = pairs.select("p", "peers").distinct().select(F.col("p").alias("block"), "p", "peers", F.lit(0).alias("side"))
    rows = first.union(pairs.select(F.col("q").alias("block"), "p", "peers", F.lit(1).alias("side")))
    tiles = rows.join(blocks.select("block", "parts"), "block").repartition("p", "peers").sortWithinPartitions("p", "peers", "side", "block")

    def unpacked(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = lambda k: b"".join(x[k] for x in parts)
        return np.frombuffer(whole("ids"), "<i8"), np.frombuffer(whole("sizes"), "<i8"), np.frombuffer(whole("data"), "<f8").reshape(-1, dims)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = number = None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.side == 0:
                    own, number = unpacked(r.parts), r.p
                    continue
                other = own if r.block == number else unpacked(r.parts)
                ids, sizes, vectors = zip(own, other, strict=True)
                counts = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)
                tree = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in compare(*vectors, rotation, threshold, r.block == number):
                    if len(i):
                        counts[0][:] += np.bincount(i, sizes[1][j], len(counts[0])).astype(np.int64)
                        counts[1][:] += np.bincount(j, sizes[0][i], len(counts[1])).astype(np.int64)
                        tree = forest(np.concatenate([tree[0], ids[0][i]]), np.concatenate([tree[1], ids[1][j]]))
                for mine, n in zip(ids, counts, strict=True):
                    yield pd.DataFrame({"a": mine[n > 0], "b": np.full(int((n > 0).sum()), -1), "n": n[n > 0]})
                yield pd.DataFrame({"a": tree[0], "b": tree[1], "n": np.zeros(len(tree[0]), np.int64)})

    with arrow_rows(spark, 4):
        found = cut(tiles.select("p", "side", "block", "parts").mapInPandas(tidy(run), "a long, b long, n long"))
    return found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links")), found.where("n = 0").select("a", "b")


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors."""
    bounded(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    lengths = sorted(r["d"] for r in v.where("fine").select(F.size("v").alias("d")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = v.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for dims in lengths:
        # 128 bits stand for a vector
        key = [F.xxhash64(F.lit(n), "v").alias(c) for n, c in enumerate(("k1", "k2"))]
        good = v.where(F.col("fine") & (F.size("v") == dims)).select("vec_id", "v", *key)
        classes = cut(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")))
        counts, edges = links(classes.select("rep", "size", "v"), dims, threshold, block)
        parts = components(edges)
        known = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        known = known.select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        linked = good.drop("v").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
        out = linked.unionByName(out)
    return out


#: The same rows in DuckDB's SQL, by all pairs.
SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as v from embeddings),
good as (select * from v where vec_id is not null and len(v) > 0 and len(list_filter(v, lambda x: coalesce(isfinite(x), false))) = len(v) and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) >= 0.95 else false end),
r as (select vec_id as a, vec_id as b from good union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as least from r group by a),
n as (select a, count(*) as n from l group by a)
select v.vec_id as vec_id, coalesce(n.n, 0) as n_links, coalesce(c.least, v.vec_id) as component_id, coalesce(v.vec_id = coalesce(c.least, v.vec_id), false) as kept
from v left join c on v.vec_id = c.a left join n on v.vec_id = n.a
"""
