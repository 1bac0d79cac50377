from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from idiomark.functions import lexicon as lx
from idiomark.functions import text as tx
from idiomark.functions import tokens as tk
from idiomark.operators import evaluate
from idiomark.operators.detect import detect, explain
from idiomark.plans import fixtures as fx


def test_lexicon_sizes_and_rules():
    b = lx.bernese()
    assert (len(lx.DECISIVE), len(lx.SUPPORTING), len(lx.WEAK)) == (249, 49, 32)
    assert (len(b.decisive), len(b.supporting), len(b.compounds)) == (274, 51, 367)
    assert not b.problems() and not lx.TRIAL.problems()
    assert len(b.supporting - b.weak) == 19
    assert "verstange" in b.supporting - b.weak and "mitenang" in b.decisive and "bärngütsch" not in b.decisive
    assert "sitzige" in b.decisive and "meinige" not in b.decisive
    assert not set(lx.PREFIXES) & lx.INSEPARABLE and not any(p.startswith("ge") for p in lx.PARTICIPLES)
    assert "agha" not in b.compounds and "ufgschribe" in b.compounds


def test_lexicon_table_agrees_with_the_rules(spark):
    rows = lx.table(spark).collect()
    b = lx.bernese()
    assert {r["form"] for r in rows if r["tier"] == "decisive" and r["origin"] != "prefixed"} == b.decisive
    assert {r["form"] for r in rows if r["tier"] == "supporting"} == b.supporting
    assert {r["form"] for r in rows if r["origin"] == "prefixed"} == b.compounds
    assert {r["form"] for r in rows if r["cased"]} == b.cased


@pytest.mark.parametrize(("chunk", "want"), [("a@b", True), ("http://x", True), ("pod-7d4b", True), ("x-y-7", True), ("Wo-n-i", False), ("Änis-Chräbeli", False), ("a.b", True), ("Ende.", False), (".a", False), ("a..b", False), ("7-x", False), ("z.B.", True), ("", False), ("é.ß", True), ("-5", True)])
def test_address(spark, chunk, want):
    assert spark.createDataFrame([(chunk,)], "c string").select(tx.is_address(F.col("c"))).first()[0] is want


def test_strip_agrees_with_plain_python(spark):
    def plain(text):
        def address(c):
            if "://" in c or "@" in c:
                return True
            _, hyphen, rest = c.partition("-")
            if hyphen and any(x.isdigit() for x in rest):
                return True
            return any(c[i] == "." and c[i - 1].isalnum() and c[i + 1].isalnum() for i in range(1, len(c) - 1))

        return "\n".join(" ".join("" if address(c) else c for c in line.split()) for line in text.splitlines())

    rng = random.Random(5)
    parts = ["a", "b.c", "x@y", " ", "  ", "\n", "\r\n", "\t", "-3", "ä", ".", "\x0b", "\x85", " ", "://", "\xa0", "7"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))),) for _ in range(600)] + [("",)]
    got = spark.createDataFrame(rows, "t string").select("t", tx.strip_addresses(F.col("t")).alias("s")).collect()
    assert not [(r["t"], r["s"], plain(r["t"])) for r in got if r["s"] != plain(r["t"])]


def test_tokens_agree_with_a_walk(spark):
    def walk(text):
        letter = lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Nl", "No")
        out, i = [], 0
        while i < len(text):
            if not letter(text[i]):
                i += 1
                continue
            j = i
            while j < len(text) and letter(text[j]):
                j += 1
            glued = (i and text[i - 1] in "0123456789_/+") or (j < len(text) and text[j] in "0123456789_/+")
            if not glued:
                k, line = i - 1, False
                while k >= 0 and text[k].isspace():
                    line |= text[k] in "\r\n"
                    k -= 1
                end = k < 0 or text[k] in ".!?:;\"'»«„“”‹›()[]…-*>•–—"
                out.append((text[i:j], 2 if end else 1 if line else 0))
            i = j
        return out

    rng = random.Random(6)
    parts = ["isch", "Chum", "a", " ", "\n", ". ", ", ", "_", "7", "/", "(", "ä", "²", "\t", "- ", "«", "!"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(500)]
    got = spark.createDataFrame(rows, "t string").select("t", tk.tokens(F.col("t")).alias("k")).collect()
    bad = [(r["t"], r["k"], walk(r["t"])) for r in got if [(x["w"], x["si"]) for x in r["k"]] != walk(r["t"])]
    assert not bad


def test_window(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit "
    rows = [(n, t) for n, t in fx.LONG] + [("short", "Chum mer luege"), ("null", None), ("hangul", "가" * 2667 + " gäng " + "가" * 40000)]
    d = tx.windowed(spark.createDataFrame(rows, "n string, t string"), F.col("t"))
    got = {r["n"]: r["window"] for r in d.collect()}
    assert all(w is None or len(w) <= tx.HEAD + tx.TAIL + 1 for w in got.values())
    assert got["null"] is None and got["short"] == "Chum mer luege"
    assert "gäng" in got["marker first"] and "gäng" in got["marker last"] and "gäng" not in got["marker inside"]
    assert got["hangul"]
    probes = []
    for delta in range(-16, 17):
        probes += [((filler * 200)[: tx.HEAD + delta] + "Verzeichnisch " + filler * 200,), (filler * 200 + " Verzeichnisch" + (filler * 200)[: tx.TAIL + delta],)]
    e = explain(spark.createDataFrame(probes, "t string"), F.col("t"))
    assert not [r for r in e.collect() if any(x["k"] == "isch" for x in r["tokens"])]


def test_detect_and_explain_agree(spark):
    rows = [(t,) for _, _, t in fx.PROBES] + [(None,)]
    d = spark.createDataFrame(rows, "t string")
    a = {r["t"]: (r["fire"], r["certain"]) for r in detect(d, F.col("t")).collect()}
    b = {r["t"]: (r["fire"], r["certain"]) for r in explain(d, F.col("t")).collect()}
    assert a == b and a[None] == (False, False)


def test_detector_stage_is_narrow(spark):
    d = detect(spark.createDataFrame([("x",)], "t string"), F.col("t"))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_agree_with_unicodedata(spark):
    rng = random.Random(8)
    parts = ["gäng", "g\u0061\u0308ng", "\uac00", "\u1100\u1161", "\U0001f642", "\u2019", "\u2013", "e\u0301\u0323", "\u212b", "\ufb01", "a", " ", "\u0344"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(400)] + [(None,)]
    d = spark.createDataFrame(rows, "t string").select("t", tx.nfc(F.col("t")).alias("c"), tx.nfd(F.col("t")).alias("d"))
    for r in d.collect():
        assert (r["c"], r["d"]) == ((None, None) if r["t"] is None else (unicodedata.normalize("NFC", r["t"]), unicodedata.normalize("NFD", r["t"])))


def test_an_emoji_does_not_hide_umlauts(spark):
    texts = ["So öppis! \U0001f642", "So öppis \u2013 gäll", "So o\u0308ppis", "\u201cgäng\u201d"]
    got = detect(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()
    assert all(r["fire"] and r["certain"] for r in got)


def test_a_filter_on_the_verdict_is_not_evaluated_twice(spark):
    d = detect(spark.createDataFrame([("x",)], "t string"), F.col("t"))
    count = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")
    assert count(d.filter("fire").select("t", "certain")) <= count(d)


def test_a_detector_over_many_relations_has_one_python_step(spark):
    d = spark.createDataFrame([("the and der que",)] * 3 + [("the thing",), (None,)], "t string")
    relations = evaluate.DIRECTIONALS + (evaluate.Relation("emptied", lambda t: F.lit(""), True), evaluate.Relation("same", lambda t: t))
    got = evaluate.metamorphic(d, "t", lx.TRIAL, relations)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" +-:*()0123456789").startswith("ArrowEvalPython") for line in plan.splitlines()) == 2
    rows = {r["relation"]: (r["n_rows"], r["violations"], r["failed"]) for r in got.collect()}
    assert set(rows) == {r.name for r in relations}
    assert rows["followed by a long log"] == (3, 0, True) and rows["append a pod name"] == (1, 0, True)
    assert rows["emptied"] == (3, 3, True) and rows["same"] == (4, 0, True)


def test_what_composition_merges_is_known(spark):
    second = {d[-1] for c in map(chr, range(0x110000)) if not 0xAC00 <= ord(c) < 0xD7A4 and len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", d) == c}
    second |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    d = spark.createDataFrame([(c,) for c in sorted(second)], "c string")
    assert d.filter(~F.col("c").rlike(tx.MERGING)).count() == 0 and len(second) > 100


def test_window_of_texts_that_shrink(spark):
    def plain(t):
        ends = lambda k: t[: k * tx.HEAD] + "\n" + t[-k * tx.TAIL :] if len(t) > k * (tx.HEAD + tx.TAIL) else t
        n = unicodedata.normalize("NFC", ends(tx.NARROW))
        if len(t) > tx.NARROW * (tx.HEAD + tx.TAIL) and len(n) < tx.HEAD + tx.TAIL:
            n = unicodedata.normalize("NFC", ends(tx.WIDE))
        return n

    units = {"marks": "a\u0308\u0304. ", "jamo": "\u1100\u1161\u11a8", "three to one": "\u03b1\u0313\u0301", "half": "a\u0308", "emoji": "\U0001f642 ", "plain": "1 "}
    rows = [(f"{n} {k}", (u * 60000)[:k] + "1" * 9) for n, u in units.items() for k in (5990, 11990, 11992, 13000, 47991, 50000)]
    d = tx.bounded(spark.createDataFrame(rows, "n string, t string"), F.col("t"), "w")
    want = spark.createDataFrame([(n, plain(t)) for n, t in rows], "n string, c string").select("n", tx.cut(F.col("c")).alias("c"))
    assert {r["n"]: r["w"] for r in d.collect()} == {r["n"]: r["c"] for r in want.collect()}


def test_generators_are_the_lexicon(spark):
    b = lx.bernese()
    made = lx.GENERATORS
    assert set(made) == {"plural_ig", "velarised", "prefixed", "suffixed"}
    d = lx.DECISIVE | made["plural_ig"](lx.DECISIVE)
    assert b.decisive == d | made["velarised"](d) and b.compounds == made["prefixed"](lx.PREFIXES, lx.PARTICIPLES)
    taken = spark.createDataFrame([("würklech",), ("blech",)], "k string").filter(made["suffixed"](F.col("k"))).collect()
    assert [r["k"] for r in taken] == ["würklech"]
