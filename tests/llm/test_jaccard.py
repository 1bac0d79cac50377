"""The join against all pairs of shingle sets."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from idiomark.llm import jaccard

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shared, lists = defaultdict(int), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            for j in lists[g]:
                shared[j, i] += 1
            lists[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}


def near_copies(seed, sizes, n):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(30)]
    base = [[rng.choice(voc) for _ in range(k)] for k in sizes]
    rows = []
    for k in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p, r = rng.randrange(len(b)), rng.random()
            if r < 0.4:
                b[p] = rng.choice(voc)
            elif r < 0.7:
                b.insert(p, rng.choice(voc))
            elif len(b) > 1:
                b.pop(p)
        rows.append((k, (" " if k % 3 else "\n").join(b).upper() if k % 7 == 0 else " ".join(b)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "sizes", "n"), [(1, (3, 5, 6, 7, 8, 9, 10, 12, 14, 18, 25, 40), 300), (2, (30, 45, 60, 90, 200), 250)])
def test_random_near_copies(spark, seed, sizes, n):
    rows = near_copies(seed, sizes, n)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_documents(spark, small, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(spark, small).collect()}
    assert got == brute([(i, t) for i, t, _, _ in documents])


def test_a_shared_passage_links_nothing_else(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"u{k}x{j}" for j in range(rng.randint(2, 60)))) for k in range(150)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_lists_dealt_to_several_buckets(spark, monkeypatch):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = list(passage)
        words[rng.randrange(60)] = f"u{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"v{k}x{j}" for j in range(30))) for k in range(10)]
    monkeypatch.setattr(jaccard, "BUCKET", 40)
    monkeypatch.setattr(jaccard, "LEAST_BUCKETS", 64)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == brute(rows)


@pytest.mark.parametrize(("bucket", "block"), [(100, 600), (100, 7), (1_000_000, 5)])
def test_small_buckets_and_blocks(spark, monkeypatch, bucket, block):
    rng = random.Random(8)
    groups = [[f"g{g}w{k}" for k in range(80)] for g in range(3)]
    rows = []
    for k in range(120):
        words = list(groups[k % 3])
        words[rng.randrange(80)] = f"u{k}"
        if k % 5 == 0:
            words[rng.randrange(80)] = f"y{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "SPREAD", 0)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_rows_without_an_id_link(spark):
    words = [f"n{k}" for k in range(60)]
    rows = [(5, " ".join(words[:50])), (None, " ".join(words[5:55])), (3, " ".join(words[10:60])), (None, "alone")]
    got = [tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(3, 46, 3), (5, 46, 3), (None, 1, None), (None, 46, 3)]


def test_chains_and_copies(spark):
    words = [f"c{k}" for k in range(400)]
    chain = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(60)]
    rows = chain + [(1000 + k, chain[0][1]) for k in range(80)] + [(2000, "short one"), (2001, "Short ONE"), (2002, "short on e")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = jaccard.join(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[4]["n_shingles"] == 1 and by[5]["n_shingles"] == 1 and by[4]["component_id"] == 4
    assert jaccard.join(empty).count() == 0


def test_components_by_joins_and_within_a_task_agree(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 90)] + [(rng.randrange(200, 500), rng.randrange(200, 500)) for _ in range(200)] + [(-5, 7), (600, 601)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r["v"]: r["comp"] for r in jaccard.components(df).collect()}
    assert one == {r["v"]: r["comp"] for r in jaccard.components(df, small=0).collect()}
    assert one[90] == -5 and one[601] == 600 and jaccard.components(df.limit(0)).count() == 0


def test_prefixes_and_subsets_lose_no_pair():
    for a in range(1, 40):
        for b in jaccard.partners(a):
            if b < 1:
                continue
            o = jaccard.overlap(a, b)
            assert 100 * o >= 75 * (a + b - o) and (o == 0 or 100 * (o - 1) < 75 * (a + b - o + 1))
            assert o <= min(a, b) and jaccard.prefix(a) > a - o
    assert list(jaccard.partners(39)) == [b for b in range(1, 100) if 4 * min(39, b) >= 3 * max(39, b)]
    assert jaccard.boundary({5: 10, 8: 10, 30: 5}, 0.0) <= jaccard.boundary({5: 10, 8: 10, 30: 5}, 5.0)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 50)).astype(np.uint64)]))
        assert jaccard.differ(jaccard.parity(x), jaccard.parity(y)) <= len(np.setxor1d(x, y))


def test_shingles_do_not_cross_texts():
    a, b, c = jaccard.shingle_sets(pa.array(["a b c d e f", "A b\tc\nd e", None]))
    assert len(a) == 2 and len(b) == 1 and b[0] in a and len(c) == 0
