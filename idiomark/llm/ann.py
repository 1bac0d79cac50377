"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half has its own codebook, fitted on a
bounded sample. A cell of the index is a pair of centroids, one of each half. A
query walks the pairs in order of summed squared distance (a heap over the two
sorted lists), until the cells it has met hold a share of all vectors, and its
nearest ones are found by exact distance to the original vectors. The share is
calibrated on the sample, so that walks there meet the wanted part of the true
neighbours: a small one where vectors cluster, a large one where they do not.

Cells are dealt to blocks of about `block` vectors; a cell with more is cut into
several blocks, so equal or crowded vectors do not meet in one task. A block
meets the queries that visit its cells, computes distances a slice at a time and
hands on each query's best `k`, so pairs of query and candidate never become
rows. A block that more than `query_block` queries visit meets them in parts, and
only such a block's vectors are copied, once for each part.

Defined cases: vectors that are null, zero, of another length than the most
frequent one, or that hold a null or a non-finite component take no part; ties
of distance go to the smaller id; fewer than k candidates give fewer rows;
repeated ids are vectors of their own, but a query's own id is never its
neighbour; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.llm.common import kept, read

OUT = "query_id long, vec_id long, score double"
#: So many rows of a list of blocks, 16 bytes each, are broadcast.
MOST_BROADCAST = 200_000


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.filter(fine & F.exists("v", lambda x: x != 0))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded starts; empty ones restart at the farthest rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = np.unique(x, axis=0)[rng.choice(len(np.unique(x, axis=0)), k, replace=False)]
    for _ in range(rounds):
        d = squared(x, c)
        near = d.argmin(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-d.min(1), kind="stable")[: int((n == 0).sum())]]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2.0 * x @ c.T + (c * c).sum(1)[None])


class Index:
    """Two codebooks; cell = first half's centroid * size of the second codebook + second half's."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [k_means(sample[:, : self.cut], centroids, seed), k_means(sample[:, self.cut :], centroids, seed + 1) if sample.shape[1] > 1 else np.zeros((1, 0))]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.cut], self.books[0]), squared(x[:, self.cut :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, sizes: dict[int, int], wanted: int) -> list[int]:
        """Non-empty cells by summed distance until they hold `wanted` vectors."""
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, out, held = [(float(a[ia[0]] + b[ib[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(ia[i]) * len(self.books[1]) + int(ib[j])
            if n := sizes.get(cell, 0):
                out.append(cell)
                held += n
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(ia) and y < len(ib) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (float(a[ia[x]] + b[ib[y]]), x, y))
        return out


def calibrated(index: Index, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> float:
    """Share of all vectors that walks must meet to find `recall` of the true k nearest, by brute force on the sample."""
    cells = index.cells(sample)
    u, n = np.unique(cells, return_counts=True)
    sizes, met = dict(zip(u.tolist(), n.tolist(), strict=True)), []
    asked = sample[:queries]
    d = squared(asked, sample)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    for row, (a, b) in enumerate(zip(*index.distances(asked), strict=True)):
        walk = index.walk(a, b, sizes, len(sample))
        reach = dict(zip(walk, np.cumsum([sizes[c] for c in walk]) / len(sample), strict=True))
        met += [reach[c] for c in cells[np.argsort(d[row], kind="stable")[: min(k, len(sample) - 1)]]]
    return float(np.quantile(met, recall, method="higher")) if met else 1.0


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Each query's k nearest of the vectors, by exact distance and then by id.

    A cheap form of the distance leaves the k smallest and all within its
    rounding error; those are measured component by component."""
    out = []
    norm = (vectors * vectors).sum(1)
    for q, i in zip(queries, ids, strict=True):
        mine = vec_ids != i
        d = norm - 2.0 * (vectors @ q) + q @ q
        d[~mine] = np.inf
        n = min(k, int(mine.sum()))
        if not n:
            continue
        edge = np.partition(d, n - 1)[n - 1]
        at = np.flatnonzero((d <= edge + 1e-9 * (abs(edge) + q @ q + norm.max())) & mine)
        exact = np.sqrt(((vectors[at] - q) ** 2).sum(1))
        order = np.lexsort((vec_ids[at], exact))[:n]
        out += [(int(i), int(vec_ids[at[o]]), float(exact[o])) for o in order]
    return out


def search(df: DataFrame, queries: DataFrame, k: int = 10, centroids: int = 32, recall: float = 0.95, sample: int = 20_000, block: int = 4096, query_block: int = 32_768, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows of df.

    The codebooks are fitted, and the walks' length calibrated for `recall`, on
    `sample` vectors, the first in seeded order. Every row is indexed."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = valid(df, id_col, vector_col)
    lengths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return empty
    dim, total = lengths[0]["n"], lengths[0]["count"]
    v = v.filter(F.size("v") == dim)
    drawn = v.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v").collect()
    drawn = np.asarray([r["v"] for r in drawn], np.float64)
    fitted = Index(drawn, centroids, seed)
    share = calibrated(fitted, drawn, k, recall)
    index = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf("long")
    def cell_of(vectors):
        import pyarrow as pa

        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.array(index.value.cells(x) if len(x) else np.zeros(0, np.int64))

    placed = kept(v.withColumn("cell", cell_of("v")))
    sizes = dict(placed.groupBy("cell").count().collect())  # one row per cell: centroids squared at most
    wanted = max(k + 1, math.ceil(share * total))
    # Small cells share a block; a large one has several.
    chunks, of_block, at, held = {}, {}, 0, 0
    for cell in sorted(sizes):
        n = -(-sizes[cell] // block)
        if n > 1 or held + sizes[cell] > block:
            at, held = at + 1, 0
        chunks[cell], of_block[cell] = n, at
        if n > 1:
            at += n
        else:
            held += sizes[cell]
    plan = spark.sparkContext.broadcast((sizes, chunks, of_block))

    @F.arrow_udf("long")
    def block_of(cells, ids):
        import pyarrow as pa

        _, n, first = plan.value
        return pa.array([first[c] + (hash((i, 17)) % n[c] if n[c] > 1 else 0) for c, i in zip(cells.to_pylist(), ids.to_pylist(), strict=True)], pa.int64())

    @F.arrow_udf("array<struct<block bigint, cells array<bigint>>>")
    def visits(vectors):
        import pyarrow as pa

        held, n, first = plan.value
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out = []
        for a, b in zip(*index.value.distances(x), strict=True):
            by: dict[int, list[int]] = {}
            for cell in index.value.walk(a, b, held, wanted):
                for c in range(n[cell]):
                    by.setdefault(first[cell] + c, []).append(cell)
            out.append([{"block": x, "cells": y} for x, y in by.items()])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.list_(pa.int64()))])))

    q = valid(queries, id_col, vector_col).filter(F.size("v") == dim)
    walked = kept(q.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), visits("v").alias("x")))
    asked = walked.select("query_id", "q", F.explode("x").alias("x")).select("query_id", "q", F.col("x.block").alias("block"), F.col("x.cells").alias("cells"))
    stored = placed.withColumn("block", block_of("cell", "vec_id"))
    # A block meets `query_block` queries or so at a time: only a block that more of them visit is copied.
    visited = walked.select(F.explode("x.block").alias("block")).groupBy("block").count()
    crowded = kept(visited.filter(F.col("count") > query_block).select("block", F.ceil(F.col("count") / query_block).cast("long").alias("parts")))
    if n := crowded.count():
        few = F.broadcast(crowded) if n <= MOST_BROADCAST else crowded
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        asked = asked.join(few, "block", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), parts)).drop("parts")
        stored = stored.join(few, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    else:
        asked, stored = (d.withColumn("part", F.lit(0).cast("long")) for d in (asked, stored))

    def meet(queries, vectors):
        import pandas as pd

        got: list[tuple[int, int, float]] = []
        if len(queries) and len(vectors):
            x, ids, cells = np.stack(vectors["v"].to_numpy()), vectors["vec_id"].to_numpy(), vectors["cell"].to_numpy()
            groups: dict[tuple, list[int]] = {}
            for row, c in enumerate(queries["cells"]):
                groups.setdefault(tuple(c), []).append(row)
            for visited, rows in groups.items():
                inside = np.isin(cells, visited)
                if inside.any():
                    got += nearest(np.stack([queries["q"].iloc[r] for r in rows]), queries["query_id"].to_numpy()[rows], x[inside], ids[inside], k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("part", "block").cogroup(stored.groupBy("part", "block")).applyInPandas(meet, OUT)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(e, e.filter(F.col("vec_id") % 100 == 0))
