"""Each stage of the pipeline against its operator's decisions, on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from idiomark.llm import jaccard, langid, mixing, toxicity


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((name, docs, out))
        docs = out
    return seen


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_order_and_columns(spark, stages, small):
    assert [n for n, _, _ in stages] == ["toxicity", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(out.columns == columns for _, _, out in stages[:-1])
    assert all(out.count() for _, _, out in stages)


def test_filters_drop_what_their_operators_reject(spark, stages, small):
    _, before, after = stages[0]
    s = toxicity.scored(before, toxicity.fit(before, spark.read.parquet(f"{small}/labels.parquet")))
    assert ids(after) == ids(s.filter("score < 0.3"))
    _, before, after = stages[1]
    drawn = langid.lessons(before)
    s = langid.identify(before, langid.learn(drawn.rows, prior=drawn.prior), cover_name="cover")
    assert ids(after) == ids(s.filter((F.col("lang_pred") != "und") & (F.col("cover") >= langid.least_cover(drawn.rows))))


def test_texts_in_no_learned_language_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    strange = [
        "Il gatto si siede sulla sedia e guarda fuori dalla finestra mentre piove a dirotto sulla strada",
        "W Szczebrzeszynie chrzaszcz brzmi w trzcinie i Szczebrzeszyn z tego slynie od wielu lat",
        "def foo(self, bar): return [x for x in bar if x.baz() is not None]",
        "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0aGlz",
        "asdf qwer zxcv hjkl uiop bnmm fghj rtyu",
    ]
    planted = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(strange)], "doc_id long, text string")
    after = corpus_pipeline.drop_unknown_language(spark, docs.unionByName(planted, allowMissingColumns=True), small)
    assert ids(after) == ids(docs.filter(F.col("text").rlike(r"\p{L}")))


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    assert ids(after) == sorted({r["component_id"] for r in jaccard.join(before).collect()})
    assert after.join(before, after.columns).count() == after.count()


def test_rows_with_one_id_or_none_are_not_lost(spark, small):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b + " more"), (2, a), (None, a + " more"), (None, c), (None, c + " more"), (None, c)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small).collect()
    got = [(r["doc_id"], r["text"].split()[0]) for r in out]
    assert sorted(got, key=str) == [(1, "a0"), (1, "b0"), (None, "c0")]


def test_the_mix_and_its_pieces(stages):
    _, before, after = stages[3]
    want = mixing.mix(before).agg(F.sum("taken")).first()[0]
    assert after.select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == want
    _, before, pieces = stages[4]
    assert set(ids(before)) == set(ids(pieces))
    total = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in total) and sum(r["n"] == 2048 for r in total) >= len(total) - 1


def test_run_and_odd_rows(spark, small, stages, odd):
    assert corpus_pipeline.run(spark, small).count() == stages[-1][2].count()
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, odd, small)
        assert out.columns == (odd.columns if f is not corpus_pipeline.pack else stages[-1][2].columns), name
        assert f(spark, odd.limit(0), small).count() == 0, name
    pieces = corpus_pipeline.pack(spark, odd, small).collect()
    assert sum(r["start"] == 0 for r in pieces) == odd.count()
