"""Per-session delivery: which firing turn gets the full payload.

The batch form takes the firing turns of each session in order; the streaming form in
idiomark.streaming.session keeps the same state per key. Sessions without an id
have no state. What travels is one small struct per firing turn, not its text.

A full payload goes out on the first certain turn, and again on the first certain
turn at least `refresh` + 1 firing turns later. So a session is told by the places
of its full payloads: a fold over the places of its certain turns finds these, and
every turn's columns follow from them without a second pass that grows an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiomark.functions.text import session_key

# Firing turns after which the full payload goes out again, days a session is kept.
REFRESH, KEEP_DAYS = 25, 14
FULL, POINTER, CHECKLIST, NONE = "FULL", "POINTER", "CHECKLIST", "NONE"


def payload(emitted: Column, overridden: bool = False) -> Column:
    return F.when(emitted, FULL).otherwise(POINTER if overridden else CHECKLIST)


def stored_state(written: Column, refresh: int = REFRESH) -> Column:
    """(served, since) that a stored counter stands for: null is a new session, and what is no number counts as 0."""
    n = F.coalesce(F.trim(written).try_cast("int"), F.lit(0))
    since = F.greatest(F.lit(0), F.least(n, F.lit(refresh)))
    return F.struct(written.isNotNull().alias("served"), F.when(written.isNotNull(), since).otherwise(0).cast("int").alias("since"))


def _keyed(turns: DataFrame, session: str, turn: str) -> DataFrame:
    return turns.filter("fire").select(session_key(F.col(session).cast("string")).alias("session_id"), F.col(turn).alias("turn"), "certain")


def without_session(fired: DataFrame, valid: bool = True) -> DataFrame:
    """Delivery of firing turns that belong to no session: every certain one gets the full payload; for streams, too."""
    alone = fired.filter(F.col("session_id").isNull())
    return alone.select("session_id", "turn", "certain", (F.col("certain") & F.lit(valid)).alias("emitted"), F.lit(False).alias("served_before"))


def _sessions(fired: DataFrame, refresh: int, valid: bool, states: DataFrame | None) -> DataFrame:
    """(session_id, turns, state, full): a session's turns in order, its state before, and the places of full payloads."""
    s = fired.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "certain"))).alias("turns"))
    if states is None:
        s = s.withColumn("state", F.struct(F.lit(False).alias("served"), F.lit(0).alias("since")))
    else:
        s = s.join(states.select("session_id", stored_state(F.col("written"), refresh).alias("state")), "session_id", "left")
        s = s.withColumn("state", F.coalesce("state", F.struct(F.lit(False).alias("served"), F.lit(0).alias("since"))))
    certain = F.array_compact(F.transform("turns", lambda t, i: F.when(t["certain"] & F.lit(valid), i)))
    due = F.when(F.col("state.served"), F.greatest(F.lit(0), F.lit(refresh) - F.col("state.since"))).otherwise(0)
    start = F.struct(due.cast("int").alias("due"), F.array().cast("array<int>").alias("full"))

    def step(acc, i):
        out = F.struct((i + refresh + 1).cast("int").alias("due"), F.concat(acc["full"], F.array(i.cast("int"))).alias("full"))
        return F.when(i >= acc["due"], out).otherwise(acc)

    return s.withColumn("full", F.aggregate(certain, start, step)["full"])


def deliver(turns: DataFrame, session: str = "session_id", turn: str = "turn", refresh: int = REFRESH, valid: bool = True, overridden: bool = False, states: DataFrame | None = None) -> DataFrame:
    """session_id, turn, certain, emitted, served_before, payload_kind of every firing turn.

    turns has fire and certain. Turns that do not fire neither age nor change a
    session. A null or empty session id is no session: every certain turn there gets
    the full payload. `states` (session_id, written) are counters stored earlier."""
    fired = _keyed(turns, session, turn)
    s = _sessions(fired, refresh, valid, states)
    n, full = F.size("turns"), F.col("full")
    # One flag per turn: false up to the first full payload, then true and false up to the next one.
    none = lambda k: F.array_repeat(F.lit(False), k)
    stretch = F.transform(full, lambda e, k: F.concat(F.array(F.lit(True)), none(F.coalesce(F.get(full, k + 1), n) - e - 1)))
    flags = F.concat(none(F.coalesce(F.get(full, F.lit(0)), n)), F.flatten(stretch))
    first = F.when(F.col("state.served"), F.lit(-1)).otherwise(F.coalesce(F.get(full, F.lit(0)), n))
    rows = s.select("session_id", first.alias("first"), F.posexplode(F.arrays_zip(F.col("turns").alias("t"), flags.alias("e"))).alias("i", "x"))
    rows = rows.select("session_id", "x.t.turn", "x.t.certain", F.col("x.e").alias("emitted"), (F.col("i") > F.col("first")).alias("served_before"))
    return rows.union(without_session(fired, valid)).withColumn("payload_kind", payload(F.col("emitted"), overridden))


def stored(turns: DataFrame, session: str = "session_id", turn: str = "turn", refresh: int = REFRESH, valid: bool = True, states: DataFrame | None = None) -> DataFrame:
    """(session_id, written): the counter that each session's last firing turn stores; null where the payload never went out."""
    s = _sessions(_keyed(turns, session, turn), refresh, valid, states)
    n, last = F.size("turns"), F.try_element_at("full", F.lit(-1))
    since = F.when(last.isNotNull(), n - 1 - last).when(F.col("state.served"), F.col("state.since") + n)
    return s.select("session_id", F.least(since, F.lit(refresh + 1)).cast("string").alias("written"))


def injection(context: Column) -> Column:
    """The JSON object that a firing turn gives."""
    return F.to_json(F.struct(F.struct(F.lit("UserPromptSubmit").alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))
