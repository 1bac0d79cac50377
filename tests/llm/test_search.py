"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from idiomark.llm import ann


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    o = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return ids[o], d


def recall(rows, ids, x, k=10):
    place = {int(i): n for n, i in enumerate(ids)}
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    found = []
    for q, got in by.items():
        best, d = exact(ids, x, place[q], k)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and q not in [r["vec_id"] for r in got]
        assert all(abs(r["score"] - d[place[r["vec_id"]]]) < 1e-12 for r in got)
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        found.append(len(set(best.tolist()) & {r["vec_id"] for r in got}) / len(best))
    return float(np.mean(found))


def test_query_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    assert recall(ann.query(spark, small).collect(), ids, x) >= 0.9


def test_clusters_need_a_small_share(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 8
    x = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))).astype(np.float32).astype(np.float64)
    index = ann.Index(x, 16, 1)
    assert ann.calibrated(index, x, 10, 0.95) < 0.3
    ids = np.arange(4000)
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(d, d.filter(F.col("vec_id") % 100 == 0), centroids=16, block=200, query_block=16).collect()
    assert len(got) == 400 and recall(got, ids, x) >= 0.9


def test_walk_visits_cells_in_order_and_all_of_them():
    rng = np.random.default_rng(2)
    index = ann.Index(rng.standard_normal((500, 6)), 5, 1)
    a, b = (d[0] for d in index.distances(rng.standard_normal((1, 6))))
    sizes = {i * 5 + j: 1 for i in range(5) for j in range(5)}
    walk = index.walk(a, b, sizes, 10**9)
    cost = [a[c // 5] + b[c % 5] for c in walk]
    assert sorted(walk) == sorted(sizes) and cost == sorted(cost)


def test_ties_copies_and_invalid_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    odd = [(1000, None), (1001, [0.0] * 4), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan"), 1.0, 1.0, 1.0]), (1004, [float("inf"), 1.0, 1.0, 1.0]), (1005, [1.0, 2.0]), (1006, []), (None, [1.0] * 4)]
    d = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("cell", F.lit("x"))
    rows = ann.search(d, d.filter("vec_id in (0, 100, 1001)"), block=50).collect()
    by = {q: sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == q) for q in (0, 100)}
    assert {r["query_id"] for r in rows} == {0, 100} and {r["score"] for r in rows} == {0.0}
    assert [v for _, v in by[0]] == list(range(1, 11)) and [v for _, v in by[100]] == list(range(10))
    few = spark.createDataFrame(same[:3], "vec_id long, embedding array<double>")
    assert ann.search(few, few).count() == 6
    assert ann.search(d.limit(0), d).count() == 0 and ann.search(few.limit(1), few.limit(1)).count() == 0


def test_only_crowded_blocks_are_copied(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((900, 8)), 40 + rng.standard_normal((900, 8))])
    ids = np.arange(len(x))
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(tuple(r) for r in ann.search(d, d.filter("vec_id % 20 = 0"), centroids=4, block=100).collect())
    for most in (ann.MOST_BROADCAST, 0):
        monkeypatch.setattr(ann, "MOST_BROADCAST", most)
        parts = ann.search(d, d.filter("vec_id % 20 = 0"), centroids=4, block=100, query_block=7).collect()
        assert sorted(tuple(r) for r in parts) == whole
