"""Language identification and toxicity: held-out accuracy, gradients, defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from idiomark.llm import gru, langid, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_query(spark, small, documents):
    rows = {r["doc_id"]: r for r in langid.query(spark, small).collect()}
    assert len(rows) == len(documents) and all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    test = [(rows[i]["lang_pred"], lang) for i, _, _, lang in documents if held_out(i)]
    assert np.mean([a == b for a, b in test]) >= 0.95


def test_language_masks_by_hand():
    m = langid.learn([("aaab aaab aaab", "x"), ("bbba bbba bbba", "y"), ("cccd cccd cccd", "x"), ("cccd cccd cccd", "y")])
    hit, total, alpha = m.counts(["aaab", "cccd", "!!", "zzzz"])
    assert total.tolist() == [7, 7, 0, 7] and alpha.tolist() == [4, 4, 0, 4]
    assert hit[0, 0] == 7 and hit[0, 1] == 0 and hit[1].tolist() == [7, 7] and hit[3].tolist() == [0, 0]
    assert m.predict(["aaab", "bbba", None, "12", "zzzz"])[0] == ["x", "y", "und", "und", "y"]


def exact_counts(m, sets, text, lang):
    """n-grams of a text that exact sets of the taught n-grams hold."""
    hit = 0
    for order in langid.ORDERS:
        h, _ = langid.grams(langid.code_points([text])[0], order)
        hit += int(np.isin(h, sets[order][lang]).sum())
    return hit


def exact_sets(rows, least=3, share=0.25):
    """For each order and language the hashes of the n-grams that are the language's own, kept as sets."""
    langs, out = sorted({x for _, x in rows}), {}
    for order in langid.ORDERS:
        rate = {}
        for lang in langs:
            h, _ = langid.grams(langid.code_points([t for t, x in rows if x == lang])[0], order)
            u, c = np.unique(h, return_counts=True)
            rate[lang] = {int(a): (int(b), b / max(1, c.sum())) for a, b in zip(u, c, strict=True)}
        top = {}
        for lang in langs:
            for g, (_, r) in rate[lang].items():
                top[g] = max(top.get(g, 0.0), r)
        out[order] = {lang: np.array([g for g, (n, r) in rate[lang].items() if n >= least and r >= share * top[g]], np.uint64) for lang in langs}
    return out


def test_counts_against_exact_sets(documents):
    rows = [(t, lang) for i, t, _, lang in documents if t and lang and not held_out(i)]
    m, sets = langid.learn(rows), exact_sets(rows)
    texts = [t for i, t, _, _ in documents if t and held_out(i)]
    hit, total, _ = m.counts(texts)
    real = m.corrected(hit, total)
    want = np.array([[exact_counts(m, sets, t, lang) for lang in m.langs] for t in texts])
    assert (hit >= want).all(), "a Bloom filter misses nothing"
    assert (abs(real - want) <= 3 + 0.02 * total[:, None]).all() and (real.argmax(1) == want.argmax(1)).all()


def test_any_number_of_languages(spark):
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 40 * 150)]
    words = {f"l{k:03d}": ["".join(rng.choice(letters[40 * k : 40 * k + 40], 5)) for _ in range(6)] for k in range(150)}
    rows = [(n, " ".join(rng.choice(w, 30)), lang) for n, (lang, w) in enumerate(p for p in words.items() for _ in range(3))]
    m = langid.learn([(t, lang) for _, t, lang in rows])
    assert m.rows.shape[0] == 3 and m.rows.dtype == np.uint64
    assert m.predict([t for _, t, _ in rows])[0] == [lang for _, _, lang in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.identify(df, langid.fit(df)).collect()
    taught = {r["lang"] for r in got if not held_out(r["doc_id"])}
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] in taught)


def test_rare_languages_are_sampled_and_repeats_are_not(spark):
    rows = [(i, f"the and of that {i}", "en") for i in range(3000)] + [(5000 + i, f"der die das und {i}", "de") for i in range(8)] + [(9000 + i, "one text, many times", "fr") for i in range(500)]
    d = langid.lessons(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), sample=60, sample_chars=6000)
    langs = [x for _, x in d.rows]
    assert d.prior == "en" and langs.count("en") <= 20 and langs.count("de") == sum(not held_out(5000 + i) for i in range(8)) and 5 <= langs.count("fr") <= 20
    twice = langid.lessons(spark.createDataFrame(rows + [(7000, "le la les des", "it")] * 3, "doc_id long, text string, lang string"), sample=80, sample_chars=8000)
    assert sum(x == "it" for _, x in twice.rows) == (not held_out(7000)), "equal rows teach once"
    assert d.rows == langid.lessons(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), sample=60, sample_chars=6000).rows
    few = langid.lessons(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=60, sample_chars=300)
    assert sum(len(t) for t, _ in few.rows) <= 300


def test_language_segments_agree(monkeypatch):
    m = langid.learn([("the quick brown fox jumps " * 3, "en"), ("der schnelle braune fuchs springt " * 3, "de")])
    text = "the quick braune fox " * 400
    whole = m.counts([text])
    monkeypatch.setattr(langid, "SEGMENT", 100)
    cut = m.counts([text])
    assert abs(int(whole[0].sum()) - int(cut[0].sum())) <= 0.05 * int(whole[0].sum())


def test_language_of_odd_rows(spark, odd, empty):
    model = langid.learn([("the and of that with this", "en"), ("der die das und nicht ist", "de")])
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and langid.identify(odd, model).columns[-2:] == ["lang_pred", "score"]
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}


def test_gradients():
    net, rng = gru.Network(1), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    codes, buckets = toxicity.coded(["idiot", "a", "wörter", "xyz"])
    index, y, w = np.array([[0, 1, 2, -1], [3, 3, -1, -1], [2, 1, 0, 3]]), np.array([1.0, 0, 1]), np.array([1.0, 0.5, 2])
    _, g = net.gradients(codes, buckets, index, y, w)
    for k, p in net.p.items():
        flat, i = p.reshape(-1), int(rng.choice(np.argsort(-abs(g[k].reshape(-1)))[:3])) if p.size > 3 else 0
        was = flat[i]
        flat[i] = was + 1e-3
        up, _ = net.gradients(codes, buckets, index, y, w)
        flat[i] = was - 1e-3
        down, _ = net.gradients(codes, buckets, index, y, w)
        flat[i] = was
        assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-3, k


def test_windows_cover_every_word():
    offsets = np.array([0, 0, 5, 5 + 32, 37 + 33, 70 + 200])
    at, cuts = toxicity.windows(offsets)
    for a, b, c, d in zip(offsets[:-1], offsets[1:], cuts[:-1], cuts[1:], strict=True):
        assert set(at[c:d].reshape(-1)) - {-1} == set(range(a, b))
        assert d - c == (0 if a == b else 1 + max(0, -(-(b - a - 32) // 16)))
    words, index, off = toxicity.words_of(pa.array(["Ab, c!", None, "", "x" * 50]))
    assert [words[i] for i in index[:2]] == ["ab", "c"] and off.tolist()[:4] == [0, 2, 2, 2]
    assert all(len(words[i]) <= toxicity.CODES for i in index) and off[-1] > 3


def test_toxicity_learns_words_and_beginnings():
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("abdeinorst"), rng.integers(2, 8))) for _ in range(400)]

    def text(toxic):
        w = list(rng.choice(common, rng.integers(20, 120)))
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[k] = rng.choice(["idiot", "zqk" + "".join(rng.choice(list("aeio"), 3))])
        return " ".join(w)

    y = [int(k % 2) for k in range(300)]
    texts = [text(t) for t in y]
    m = toxicity.learn(texts, y, steps=150)
    test = [int(k % 2) for k in range(120)]
    s = m.scores(pa.array([text(t) for t in test]))
    assert np.mean((s >= 0.3) == np.array(test)) >= 0.93
    one = text(0)
    long = " ".join([one] * 30 + [text(1)] + [one] * 30)
    assert m.scores(pa.array([long]))[0] >= 0.3, "a window far inside a long text"


def test_toxicity_without_marks_learns_from_documents():
    rng = np.random.default_rng(7)
    common = ["".join(rng.choice(list("abdeinorst"), rng.integers(3, 8))) for _ in range(300)]
    ill = ["q" + "".join(rng.choice(list("xyzvwkjfh"), 7)) for _ in range(4000)]  # no word comes twice

    def text(toxic):
        w = list(rng.choice(common, rng.integers(30, 90)))
        if toxic:
            a = int(rng.integers(0, len(w) - 12))
            w[a : a + 12] = [ill.pop() for _ in range(12)]
        return " ".join(w)

    y = [int(k % 2) for k in range(120)]
    texts = [text(t) for t in y]
    words, index, offsets = toxicity.words_of(pa.array(texts))
    assert not {m for m in toxicity.telling(words, index, offsets, np.array(y), 10**6)}
    was, toxicity.telling = toxicity.telling, lambda *a, **k: set()
    try:
        m = toxicity.learn(texts, y, steps=200)
    finally:
        toxicity.telling = was
    test = [int(k % 2) for k in range(60)]
    s = m.scores(pa.array([text(t) for t in test]))
    assert np.mean((s >= 0.3) == np.array(test)) >= 0.9


def test_one_text_of_an_id_teaches(spark):
    docs = spark.createDataFrame([(1, "idiot you are")] * 300 + [(1, f"idiot {k}") for k in range(300)] + [(3, "clean words here")] * 50, "doc_id long, text string").repartition(3)
    seen = []
    was, toxicity.learn = toxicity.learn, lambda texts, labels: seen.append((texts, labels))
    try:
        toxicity.fit(docs, spark.createDataFrame([(1, 1), (3, 0), (4, 1), (3, None)], "doc_id long, toxic int"))
    finally:
        toxicity.learn = was
    assert [len(t) for t, _ in seen] == [2] and seen[0][1] == [1, 0]


def test_held_out_precision_and_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").filter("toxic in (0, 1)")
    s = toxicity.scored(docs.join(labels, "doc_id").select("doc_id", "text", "toxic"), toxicity.fit(docs, labels)).collect()
    rows = [(r["score"] >= 0.3, r["toxic"] == 1) for r in s if held_out(r["doc_id"])]
    hit = sum(a and b for a, b in rows)
    assert hit / max(1, sum(a for a, _ in rows)) >= 0.75 and hit / sum(b for _, b in rows) >= 0.75


def test_toxicity_query_and_odd_rows(spark, small, odd, empty, monkeypatch):
    rows = toxicity.query(spark, small).collect()
    assert len(rows) == 200 and all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    blank = toxicity.Scorer()
    got = toxicity.scored(odd, blank).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.0}
    model = toxicity.learn(["idiot you are"] * 5 + ["clean words here"] * 5, [1] * 5 + [0] * 5, steps=5)
    assert toxicity.scored(odd, model, name="s").count() == odd.count()
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")).network is None
    assert toxicity.learn(["a"], [1]).network is None
