from __future__ import annotations

import re

from idiomark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing what is above the caps, source by source."""
    open_, total, out = set(sizes), share * sum(sizes.values()), {}
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return out


def check(rows, docs):
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water(size, weights)
    taken = {}
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.51


def test_targets_and_shares(spark, small, documents):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(d).collect()
    check(rows, [(i, t, s) for i, t, s, _ in documents])
    words = {i: len(WORD.findall(t or "")) for i, t, _, _ in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    other = mixing.mix(d, seed=1).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) != sorted((r["doc_id"], r["taken"]) for r in other)


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    check(rows, [(r[0], r[1], r[3]) for r in odd_rows])
    assert mixing.mix(empty).count() == 0


def test_all_empty_texts(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0)] * 2


def test_mixture_takes_what_it_says(spark, odd):
    m = mixing.mixture(odd)
    assert m.columns == odd.columns
    got, want = {}, {}
    for r in m.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        assert r["n_chars"] == len(r["text"] or "")
    for r in mixing.mix(odd).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert got == {s: n for s, n in want.items() if n}


def test_small_buckets_and_crowded_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "GROUP", 3)
    rows = [(i if i % 3 else None if i % 2 else 7, "w " * (i % 11), "ab"[i % 2]) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    check(got, rows)
    many = spark.createDataFrame([(1, "same text", "a")] * 700, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(many).collect()
    check(got, [(1, "same text", "a")] * 700)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(r["taken"] for r in mixing.mix(many).collect()) == sorted(r["taken"] for r in got)
