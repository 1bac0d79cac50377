from __future__ import annotations

from idiomark.operators import session
from idiomark.plans import fixtures as fx
from idiomark.streaming import session as stream

TURN = "session_id string, turn long, fire boolean, certain boolean"


def kinds(df, key):
    return {r["turn"]: r["payload_kind"] for r in df.filter(df.session_id == key).collect()}


def test_refresh_after_25_firing_turns(spark):
    d = session.deliver(spark.createDataFrame(fx.TURNS, TURN))
    long = kinds(d, "long")
    assert [t for t, k in sorted(long.items()) if k == "FULL"] == [1, 27, 53]
    assert kinds(d, "two") == {1: "FULL", 2: "CHECKLIST"}
    assert kinds(d, "late") == {1: "CHECKLIST", 2: "FULL", 4: "CHECKLIST"}
    assert kinds(d, "a_b_c") == {1: "FULL", 2: "CHECKLIST"}
    alone = [r for r in d.collect() if r["session_id"] is None]
    assert sorted((r["turn"], r["payload_kind"]) for r in alone) == [(1, "FULL"), (2, "FULL"), (3, "CHECKLIST")]


def test_silent_turns_do_not_age(spark):
    rows = [("s", 1, True, True), *[("s", t, False, False) for t in range(2, 40)], ("s", 40, True, True)]
    assert kinds(session.deliver(spark.createDataFrame(rows, TURN)), "s") == {1: "FULL", 40: "CHECKLIST"}


def test_without_a_valid_rulebook_nothing_is_emitted(spark):
    rows = [("s", t, True, True) for t in range(1, 40)]
    d = session.deliver(spark.createDataFrame(rows, TURN), valid=False, overridden=True)
    assert set(kinds(d, "s").values()) == {"POINTER"} and not [r for r in d.collect() if r["served_before"]]


def test_injection_json(spark):
    from pyspark.sql import functions as F

    line = spark.createDataFrame([("ä \"x\"",)], "c string").select(session.injection(F.col("c"))).first()[0]
    assert line == '{"hookSpecificOutput":{"hookEventName":"UserPromptSubmit","additionalContext":"ä \\"x\\""}}'


def test_stream_agrees_with_batch(spark, tmp_path):
    import time

    rows = fx.TURNS
    batch = session.deliver(spark.createDataFrame(rows, TURN), refresh=3)
    want = sorted((tuple(r) for r in batch.select("session_id", "turn", "certain", "emitted", "served_before", "payload_kind").collect()), key=str)
    assert [r for r in want if r[0] is None and r[5] == "FULL"]  # turns of no session
    src = str(tmp_path / "in")
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]):
        spark.createDataFrame(part, TURN).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files of one batch are taken in order of their time
    fired = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(src).filter("fire")
    from pyspark.sql import functions as F

    from idiomark.functions.text import session_key

    fired = fired.select(session_key(F.col("session_id")).alias("session_id"), "turn", "certain")
    q = stream.deliver(fired, refresh=3).writeStream.format("memory").queryName("delivered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    got = sorted((tuple(r) for r in spark.sql("select session_id, turn, certain, emitted, served_before, payload_kind from delivered").collect()), key=str)
    assert got == want


def test_stored_counters_are_read_as_they_were_written(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(None,), ("",), ("x",), ("-5",), (" 7 ",), ("99",)], "w string").select("w", session.stored_state(F.col("w")).alias("s"))
    got = {r["w"]: (r["s"]["served"], r["s"]["since"]) for r in d.collect()}
    assert got == {None: (False, 0), "": (True, 0), "x": (True, 0), "-5": (True, 0), " 7 ": (True, 7), "99": (True, 25)}


def test_a_resumed_session_goes_on_as_one_that_never_stopped(spark):
    rows = [("s", t, True, t % 4 != 1) for t in range(1, 70)]
    whole = {r["turn"]: (r["emitted"], r["served_before"]) for r in session.deliver(spark.createDataFrame(rows, TURN)).collect()}
    first, then = spark.createDataFrame(rows[:31], TURN), spark.createDataFrame(rows[31:], TURN)
    kept = session.stored(first)
    two = {r["turn"]: (r["emitted"], r["served_before"]) for part in (session.deliver(first), session.deliver(then, states=kept)) for r in part.collect()}
    assert two == whole


def test_a_failing_sink_loses_its_batch_only(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(f"s{k}", 1, True, True)], TURN).coalesce(1).write.mode("append").parquet(src)
    kept, lost = [], []

    def write(batch, number):
        rows = batch.collect()
        if number == 1:
            raise OSError("read-only")
        kept.extend(rows)

    rows = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(src)
    q = rows.writeStream.foreachBatch(stream.isolated(write, lambda n, e: lost.append((n, e)))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert len(kept) == 2 and lost == [(1, "OSError: read-only")]


def test_payload_texts(spark):
    from idiomark.operators import payload

    d = session.deliver(spark.createDataFrame([("s", 1, True, True), ("s", 2, True, True)], TURN))
    texts = lambda *a, **k: [r["context"] for r in payload.composed(d, *a, **k).orderBy("turn").collect()]
    full, short = texts(("/r.md", "Regle", True), ["Extra", " "], "LIST", tool="look")
    assert "Regle\nExtra\n" in full and "LIST" not in full and "LIST" in short and "loaded earlier" in short and "look <word>" in short
    assert all("LIST" in t for t in texts(("/r.md", "", False), [], "LIST", overridden=True)), "no pointer to a rulebook that cannot be read"
    assert "/r.md" in texts(("/r.md", "Regle", True), [], "LIST", overridden=True)[1] and all("LIST" in t for t in texts(None, ["Extra"], "LIST"))
