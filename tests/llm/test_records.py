"""URL filters, licence scans and media columns."""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from idiomark.llm import licenses, media, urls

DAY = datetime.date


@pytest.mark.parametrize(("module", "table"), [(urls, "pages"), (licenses, "documents")])
def test_sql_twin(spark, small, module, table):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df, r = module.query(spark, small), c.sql(module.SQL)
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    show = lambda v: str(v)[:10] if isinstance(v, DAY) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(show(x[n]) for n in names) for x in df.collect()) == sorted(tuple(show(x[r.columns.index(n)]) for n in names) for x in r.fetchall())


def test_native_plans(spark, small):
    for f in (urls.query, licenses.query):
        plan = f(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_intervals_and_as_of(spark):
    d = lambda n: DAY(2021, 1, 1) + datetime.timedelta(n)
    log = [("spam", "host:a.b.c", True, d(10)), ("spam", "host:a.b.c", True, d(12)), ("spam", "host:a.b.c", False, d(20)), ("spam", "host:a.b.c", False, d(21)), ("spam", "host:a.b.c", True, d(30)), ("allow", "domain:b.c", True, d(15)), ("allow", "domain:b.c", False, d(16)), ("x", "path:a.b.c/p", True, d(0)), ("x", None, True, d(0)), ("x", "host:q", True, None), ("y", "host:same", True, d(5)), ("y", "host:same", False, d(5))]
    entries = spark.createDataFrame(log, "list string, pattern string, added boolean, day date")
    got = {(r["since"], r["until"]) for r in urls.intervals(entries).filter("pattern = 'host:a.b.c'").collect()}
    assert got == {(d(10), d(20)), (d(30), None)}
    caps = [(1, "http://A.b.c/", d(9)), (2, "http://A.b.c/", d(10)), (3, "https://u:p@a.b.c:80/x?q", d(15)), (4, "http://a.b.c.", d(20)), (5, "http://a.b.c", d(99)), (6, "http://a.b.c/p/q#z", d(1)), (7, None, d(1)), (8, "no url", d(1)), (9, "http://a.b.c", None), (5, "http://a.b.c", d(99)), (None, "http://a.b.c", d(99)), (11, "http://same/", d(5))]
    rows = urls.evaluate(spark.createDataFrame(caps, "page_id long, url string, day date").withColumn("lists", F.lit("clash")), entries).collect()
    assert len(rows) == len(caps)
    by = {r["page_id"]: (r["lists"], r["blocked"]) for r in rows}
    assert by == {1: ("", False), 2: ("spam", True), 3: ("allow,spam", False), 4: ("", False), 5: ("spam", True), 6: ("x", True), 7: ("", False), 8: ("", False), 9: ("", False), None: ("spam", True), 11: ("", False)}
    assert urls.evaluate(spark.createDataFrame([], "page_id long, url string, day date"), entries).count() == 0


def brute_places(text):
    low = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for label, key in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])) for i in range(len(w)) if w[i : i + len(key)] == key]
    return len(w), found


def test_licences_against_brute_force(spark, odd):
    extra = ["CC BY cc by", "ALL RIGHTS RESERVED all rights reserved. General public license", "the mit License", "general public", "by cc", "Kall rights reserved", "cc-by 4.0", "Licensed under the Apache License, Version 2.0.", "all rights all rights reserved", "L\u0130CENSE \u212aopy general publ\u0130c license", "ALL R\u0130GHTS RESERVED \u00c9 all rights reserved", "\u212a by cc by"]
    base = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + k, t) for k, t in enumerate(extra)]
    df = spark.createDataFrame(base, "doc_id long, text string").withColumn("labels", F.lit("x"))
    for r, (i, text) in zip(sorted(licenses.scan(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(base, key=lambda b: (b[0] is None, b[0] or 0)), strict=True):
        n, found = brute_places(text)
        assert r["doc_id"] == i and r["n_words"] == n and sorted((s["first"], s["label"]) for s in r["spans"] if s["base"]) == sorted(found)
        assert 0 <= r["score"] <= 1 and (r["score"] == 1.0 or not found)
    labels = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in licenses.scan(df).collect()}
    assert labels[102] == {"mit"} and labels[107] == {"apache-2.0"}
    assert licenses.scan(df.limit(0)).count() == 0


def test_items_of_a_page():
    page = '<html><head><title>T</title><style>p{}</style></head><body><p>One <b>two</b></p><img src="a" alt="A &amp; B"><figure><img src="b"><img src="c"><figcaption>Both <i>here</i></figcaption></figure>tail<script>x("<p>")</script><figcaption>alone</figcaption><video src="v"></video><br>end <img>'
    got = [(x["kind"], x["text"] or x["src"], x["caption"]) for x in media.parse(page)]
    assert got == [("text", "T", None), ("text", "One two", None), ("media", "a", "A & B"), ("media", "b", "Both here"), ("media", "c", "Both here"), ("text", "tail", None), ("text", "alone", None), ("media", "v", None), ("text", "end", None)]
    assert media.parse(None) == [] and media.parse("") == [] and [x["caption"] for x in media.parse('<figure><img src="q"><figcaption>open')] == ["open"]


def test_round_trip_of_payloads():
    for text in (None, "", "a", "x" * 64, "x" * 65, "é" * 100, "\0" * 3):
        raw = (text or "").encode()
        p = media.payload(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw) and not p[len(raw) :].strip(b"\0") and len(p) - len(raw) <= 64
        assert media.samples(media.media(p)) == p
    with pytest.raises(ValueError, match="whole"):
        media.samples(media.media(b"x" * 64)[:-1])


def check_media(rows, texts):
    assert len(rows) == len(texts)
    feature = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert feature.setdefault(r["payload_sha256"], r["feature"]) == r["feature"] and str(r["doc_id"]) in r["caption"]


def test_media_query(spark, small, documents):
    check_media(media.query(spark, small).collect(), {i: t for i, t, _, _ in documents})


def test_media_of_hot_and_odd_rows(spark, tmp_path, odd):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(50)] + [(9000, None), (9001, "")]
    d = tmp_path / "d"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(d / "documents.parquet"))
    check_media(media.query(spark, str(d)).collect(), dict(rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert media.query(spark, str(tmp_path / "e")).count() == 0
    odd.write.parquet(str(tmp_path / "o" / "documents.parquet"))
    assert media.query(spark, str(tmp_path / "o")).count() == odd.count()
    items = spark.createDataFrame([(1, 0, "sha256:" + "0" * 64, "c"), (1, 1, None, "d")], "id long, position int, src string, caption string")
    r = media.resolve(items, media.features(spark.createDataFrame([], "digest string, media binary"))).orderBy("position").collect()
    assert [(x["position"], x["caption"], x["feature"]) for x in r] == [(0, "c", None), (1, "d", None)]


def test_url_lists_with_deeper_paths(spark):
    day = datetime.date(2021, 5, 1)
    entries = spark.createDataFrame([("p", "path:h.org/a/b/", True, day), ("u", "url:h.org/a/b/c/", True, day), ("d", "path:h.org/a/b/c", True, day)], "list string, pattern string, added boolean, day date")
    urls_of = {1: "https://h.org/a/b/c/d?q", 2: "https://h.org/a/b", 3: "https://h.org/a/bc", 4: "https://h.org/a/b/c/", 5: "https://h.org/", 6: "https://h.org//a/b/"}
    caps = spark.createDataFrame([(k, u, day) for k, u in urls_of.items()], "page_id long, url string, day date")
    got = {r["page_id"]: r["lists"] for r in urls.evaluate(caps, entries).collect()}
    assert got == {1: "d,p", 2: "p", 3: "", 4: "d,p,u", 5: "", 6: ""}


def test_whole_licence_texts(spark):
    texts = {t.label: t.text for t in licenses.TEMPLATES if t.label.startswith("text:")}
    rows = [(k, f"Copyright 2020 Someone\n\n{t}\n\ncode here " + "and more words " * 50) for k, t in enumerate(texts.values())]
    rows += [(100, "Permission is hereby granted, free of charge, to any person"), (101, " ".join(texts.values())), (102, "This permission notice shall be included")]
    rows += [(103, "general public license " * 400 + " ".join(texts.values()) + " cc by")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows + [(500 + k, "plain words only") for k in range(50)], "doc_id long, text string")).collect()}
    for k, label in enumerate(texts):
        assert label in {s["label"] for s in got[k]["spans"]} and got[k]["score"] == 1.0
    assert {s["label"] for s in got[100]["spans"]} == {"mit"} and not got[102]["spans"]
    assert set(texts) <= {s["label"] for s in got[101]["spans"]}
    n, found = brute_places(rows[-1][1])
    assert sorted((s["first"], s["label"]) for s in got[103]["spans"] if s["base"]) == sorted(found) and set(texts) <= {s["label"] for s in got[103]["spans"]}
