from __future__ import annotations

import io
import json
import sqlite3
import urllib.error

import pytest

from idiomark.operators import corpus, evaluate, mutation
from idiomark.plans import fixtures as fx
from idiomark.sources import readers, web, writers


def test_labelled(spark, tmp_path):
    p = tmp_path / "l.tsv"
    p.write_text("# note\n\nbd\tchat\tHallo\\NChum\tmit Tab\\n\nxx\tlog\tplain\n", encoding="utf-8")
    rows = [tuple(r) for r in readers.labelled(spark, str(p)).collect()]
    assert rows == [("bd", "chat", "Hallo\nChum\tmit Tab\\n"), ("xx", "log", "plain")]
    p.write_text("bd\tonly two\n", encoding="utf-8")
    with pytest.raises(Exception, match="malformed labelled row"):
        readers.labelled(spark, str(p)).collect()


def test_events(spark):
    d = readers.parsed_events(spark.createDataFrame(fx.EVENTS, "value string"))
    got = {(r["prompt"], r["session_id"]) for r in d.collect()}
    assert got == {("So öppis!", "s1"), ("hoi", None), ("hoi \u2013 du", None)}
    odd = [('{"a": "\\"prompt\\": \\"x\\"", "prompt": ["y"]}',), ('{"prompt": null}',), ('{"prompt": {"prompt": "x"}}',), (None,), ('"prompt"',)]
    assert not readers.parsed_events(spark.createDataFrame(odd, "value string")).collect()


def test_a_table_of_many_splits_is_not_moved(spark, tmp_path):
    at = str(tmp_path / "one.parquet")
    spark.range(200_000).repartition(1).write.option("parquet.block.size", 1 << 16).parquet(at)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
        d = spark.read.parquet(at)
        n = d.rdd.getNumPartitions()
        assert n >= spark.sparkContext.defaultParallelism and readers.dealt(d).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert readers.dealt(spark.read.parquet(at)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_pdf_texts_have_a_status(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good gsy")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    tool = tmp_path / "totext"
    tool.write_text("#!/bin/sh\ndata=$(cat)\ncase \"$data\" in bad*) exit 1;; esac\necho \"$1 $data\"\n")
    tool.chmod(0o755)
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in readers.pdf_texts(spark, str(tmp_path / "*.pdf"), str(tool)).collect()}
    assert got == {"a.pdf": ("-layout good gsy\n", readers.OK), "b.pdf": (None, readers.FAILED)}
    assert {r["status"] for r in readers.pdf_texts(spark, str(tmp_path / "*.pdf"), "no-such-command").collect()} == {readers.NO_TOOL}


def test_rulebooks(spark, tmp_path):
    (tmp_path / "a.md").write_text("Regle", encoding="utf-8")
    assert readers.resolve([str(tmp_path / "none"), str(tmp_path / "a.md")]) == (str(tmp_path / "a.md"), False)
    assert readers.resolve(["relative.md"], "relative.md") == (None, True)
    assert readers.resolve([], "~nobody-here/x") == (None, True)
    (tmp_path / "b.md").write_bytes(b"\xff\xfe" * 50)
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in readers.rulebook(spark, str(tmp_path / "*.md")).collect()}
    assert got == {"a.md": True, "b.md": False}
    for k in "ba":
        (tmp_path / "projects" / k / "memory").mkdir(parents=True)
        (tmp_path / "projects" / k / "memory" / "x.md").write_text(k)
    (tmp_path / "projects" / "c" / "memory").mkdir(parents=True)
    (tmp_path / "projects" / "c" / "memory" / "x.md").symlink_to(tmp_path / "projects" / "b" / "memory" / "x.md")
    assert [r["body"] for r in readers.overlays(spark, str(tmp_path), "x.md").collect()] == ["a", "b"]
    own = str(tmp_path / "projects" / "c" / "memory" / "x.md")
    assert [r["body"] for r in readers.overlays(spark, str(tmp_path), "x.md", own).collect()] == ["b", "a"]
    assert readers.configured(spark, [str(tmp_path / "a.md")]) == (str(tmp_path / "a.md"), False, None)
    try:
        spark.conf.set(readers.RULEBOOK_OPTION, "/mine.md")
        spark.conf.set(readers.OVERLAY_OPTION, own)
        assert readers.configured(spark, [str(tmp_path / "a.md")]) == ("/mine.md", True, own)
    finally:
        spark.conf.unset(readers.RULEBOOK_OPTION)
        spark.conf.unset(readers.OVERLAY_OPTION)


def test_spans_and_embedded_text():
    assert readers.function_spans(fx.SOURCE) == fx.SPANS
    src = f"A = {'x' * 250!r}\nB = 'short'\nC = 5\n"
    assert readers.embedded_text("m.py", src) == ("x" * 250, "A")
    assert readers.embedded_text("m.py", "B = 1\n") == ("B = 1\n", None) and readers.embedded_text("m.md", "t") == ("t", None)


def test_mutation_session(spark, tmp_path):
    p = str(tmp_path / "s.sqlite")
    with sqlite3.connect(p) as db:
        db.execute("create table work_items (job_id text)")
        db.execute("create table work_results (job_id text, test_outcome text)")
        db.execute("create table mutation_specs (job_id text, start_pos_row int)")
        db.executemany("insert into work_items values (?)", [(j,) for j, _ in fx.SPECS])
        db.executemany("insert into work_results values (?, ?)", fx.RESULTS)
        db.executemany("insert into mutation_specs values (?, ?)", fx.SPECS)
    items, results, specs = readers.mutation_session(spark, p)
    for name, table in zip(readers.SESSION, (items, results, specs), strict=True):
        table.write.parquet(str(tmp_path / f"landed/{name}.parquet"))
    landed = readers.mutation_session(spark, str(tmp_path / "landed"))
    assert sorted(landed[1].collect()) == sorted(results.collect()) and landed[2].count() == specs.count()
    parts = spark.read.format("sqlite_table").option("path", p).option("table", "work_items").option("rows", 7).load()
    assert parts.rdd.getNumPartitions() == -(-len(fx.SPECS) // 7) and parts.count() == len(fx.SPECS)
    s = mutation.scores(mutation.outcomes(specs, results, readers.spans(spark, fx.SOURCE)))
    total = mutation.passes(s).first()
    assert total["total"] == 57 and total["survived"] == 22 and not total["passed"]
    assert tuple(mutation.completeness(items, results).first()) == (57, 60, False)
    assert [r["name"] for r in mutation.ranked(s).collect()][0] in {n for _, _, n in fx.SPANS} | {mutation.MODULE}
    only = mutation.scores(mutation.outcomes(specs, results, readers.spans(spark, fx.SOURCE)), ["first"])
    assert {r["name"] for r in only.collect()} == {"first", None}


class Body(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_web_sources():
    calls, waits = [], []

    def opener(req, timeout):
        calls.append(req.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(req.full_url, 429, "", None, None)
        return Body(b"ok")

    assert web.get("http://x", open_url=opener, sleep=waits.append) == "ok" and waits == [6]
    pages = {1: 'a <a href="?q=x&amp;page=3">3</a><footer>no</footer>', 2: "b", 3: "c"}
    seen = []

    def fetch(url):
        seen.append(url)
        return pages[int(url.rpartition("page=")[2])] if "page=" in url else pages[1]

    rows = list(web.search_pages("gäng", {"url": "http://x/{}?"}, fetch, lambda s: None))
    assert [r[1] for r in rows] == [1, 2, 3] and "footer" not in rows[0][2] and "ga%CC%88ng" not in seen[0] and "g%C3%A4ng" in seen[0]
    assert [r[3] for r in web.search_pages("x", {"url": "{}"}, lambda u: 1 / 0, lambda s: None)] == ["ZeroDivisionError: division by zero"]
    answers = [{"query": {"categorymembers": [{"title": "A", "ns": 0}, {"title": "T", "ns": 1}]}, "continue": {"cmcontinue": "k"}}, {"query": {"categorymembers": [{"title": "B", "ns": 0}]}}]
    assert [t for _, t in web.category_members("C", {"url": "u"}, lambda u: json.dumps(answers.pop(0)), lambda s: None)] == ["A", "B"]
    assert list(web.extract("A", {"url": "u"}, lambda u: '{"query": {"pages": {"1": {"extract": "text"}}}}')) == [("A", "text", None)]
    assert list(web.extract("A", {"url": "u"}, lambda u: "no json"))[0][2] == "JSONDecodeError"


def test_registered_sources_have_rows_for_failures(spark):
    web.register(spark)
    d = spark.read.format("extracts").option("url", "http://127.0.0.1:9/api").option("values", '["A", "B"]').load()
    assert sorted((r["title"], r["text"] is None, r["error"] is not None) for r in d.collect()) == [("A", True, True), ("B", True, True)]


def test_article_files(spark, tmp_path):
    a = corpus.named(corpus.kept(corpus.scored(spark.createDataFrame(fx.ARTICLES, "title string, text string"))))
    writers.articles(a, str(tmp_path / "out"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "slug=bern_stadt"), wholetext=True).collect())
    assert text.startswith("# bern (stadt)\n# Source: https://als.wikipedia.org/wiki/bern_%28stadt%29\n")
    writers.injections(spark.createDataFrame([("x",)], "context string"), str(tmp_path / "j"))
    assert "additionalContext" in spark.read.text(str(tmp_path / "j")).first()[0]


def test_wilson_and_gate(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(130, 0, 110, 4)], "tp long, fp long, tn long, fn long")
    s = evaluate.summary(d).first()
    assert round(s["recall"], 4) == 0.9701 and s["precision"] == 1.0 and round(s["recall_low"], 4) == 0.9258 and s["precision_high"] == 1.0
    assert evaluate.gate(evaluate.summary(d)).first()["passed"]
    bad = spark.createDataFrame([(10, 1, 5, 9)], "tp long, fp long, tn long, fn long")
    assert evaluate.gate(evaluate.summary(bad), 1).first()["reasons"] == "recall, precision, false positives, false negatives, relations"
    none = spark.createDataFrame([(0, 0)], "a long, b long").select(*evaluate.wilson(F.col("a"), F.col("b"))).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_a_score_of_another_source_is_refused(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("j", "core")], "job_id string, scope string").withColumn("stamp", F.sha2(F.lit("old"), 256))
    assert mutation.measured(rows, "stamp", F.lit("old"), "scope", "core").count() == 1
    with pytest.raises(Exception, match="another source"):
        mutation.measured(rows, "stamp", F.lit("new")).collect()
    with pytest.raises(Exception, match="another scope"):
        mutation.measured(rows, "stamp", F.lit("old"), "scope", "all").collect()


def test_names_of_a_family_never_meet(spark):
    titles = ["a", "A", "a-2", "a", "a-2", "a-3", "b", "b", "b", "a-2-2", "?", "!", "artikel-2", "", "c-7", "C 7"]
    rows = [(t, "x" * k, float(100 - k)) for k, t in enumerate(titles)]
    d = spark.createDataFrame(rows, "title string, text string, score double").repartition(3)
    got = {r["text"]: r["slug"] for r in corpus.named(d).collect()}
    taken, want = set(), {}
    for t, text, _ in rows:
        base = "".join(c if c.isalnum() or c == "-" else "_" for c in t).strip("_") or "artikel"
        options = [base] + [f"{base}-{k}" for k in range(2, 99)]
        want[text] = min((x for x in options if x.lower() not in taken), key=options.index)
        taken.add(want[text].lower())
    assert got == want


def test_shared_sequences_of_a_long_text_of_unknown_words(spark):
    from idiomark.operators import overlap

    ours = spark.createDataFrame([("zzz " * 40_000 + "one two three four" + " zzz" * 40_000,), (None,), ("two three",)], "text string")
    theirs = spark.createDataFrame([("One two three four five",), ("",)], "text string")
    want = {(2, "one two"), (2, "two three"), (2, "three four"), (3, "one two three"), (3, "two three four"), (4, "one two three four")}
    assert {(r["n"], r["gram"]) for r in overlap.shared_sequences(ours, theirs).collect()} == want
    was, overlap.MOST_SEQUENCES = overlap.MOST_SEQUENCES, 1
    try:
        assert {(r["n"], r["gram"]) for r in overlap.shared_sequences(theirs, ours).collect()} == want
    finally:
        overlap.MOST_SEQUENCES = was
    assert overlap.shared_sequences(ours, theirs.limit(0)).count() == 0
