"""Per-session delivery on a stream: the state of idiomark.operators.session per key, with an expiry.

Only firing turns reach the stateful operator. Within a micro-batch a session's
turns are taken in order of turn. Turns without a session id carry no state: they pass
beside the keyed operator, and every certain one gets the full payload. With an
expiry, a session that nothing was written to for that long starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from idiomark.functions.lexicon import Lexicon
from idiomark.functions.text import session_key
from idiomark.operators.detect import detect, eligible
from idiomark.operators.session import CHECKLIST, FULL, KEEP_DAYS, POINTER, REFRESH, payload, without_session

OUT = "session_id string, turn long, certain boolean, emitted boolean, served_before boolean, payload_kind string"


class Delivery(StatefulProcessor):
    """State of a key: whether the full payload ever went out, and firing turns since."""

    def __init__(self, refresh: int = REFRESH, valid: bool = True, overridden: bool = False, keep_ms: int | None = None):
        self.refresh, self.valid, self.overridden, self.keep_ms = refresh, valid, overridden, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("delivery", "served boolean, since int", **({"ttlDurationMs": self.keep_ms} if self.keep_ms else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["turn", "certain"], kind="stable")
        served, since = self.state.get() if self.state.exists() else (False, 0)
        out = []
        for turn, certain in zip(turns["turn"], turns["certain"], strict=True):
            since = min(since, self.refresh)
            emitted = bool(certain) and (not served or since >= self.refresh) and self.valid
            out.append((key[0], int(turn), bool(certain), emitted, bool(served), FULL if emitted else POINTER if self.overridden else CHECKLIST))
            served = served or emitted
            since = 0 if emitted else since + 1 if served else since
        if served:
            self.state.update((True, since))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def firing(prompts: DataFrame, lex: Lexicon, text: str = "prompt", session: str = "session_id", turn: str = "turn") -> DataFrame:
    """(session_id, turn, certain) of eligible turns that fire; narrow, for streams and tables alike."""
    d = detect(prompts.filter(eligible(F.col(text))), F.col(text), lex)
    return d.filter("fire").select(session_key(F.col(session).cast("string")).alias("session_id"), F.col(turn).cast("long").alias("turn"), "certain")


def deliver(fired: DataFrame, refresh: int = REFRESH, valid: bool = True, overridden: bool = False, expire: bool = False, keep_ms: int = KEEP_DAYS * 86_400_000) -> DataFrame:
    """Delivery of a stream of firing turns (session_id, turn, certain). The state store must be RocksDB."""
    keyed = fired.filter(F.col("session_id").isNotNull()).groupBy("session_id")
    processor = Delivery(refresh, valid, overridden, keep_ms if expire else None)
    kept = keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if expire else "None")
    alone = without_session(fired, valid).withColumn("payload_kind", payload(F.col("emitted"), overridden))
    return kept.union(alone.select(*kept.columns))


def isolated(write: Callable[[DataFrame, int], None], lost: Callable[[int, str], None]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that a failing write does not stop: `lost` is told the batch and the error, the stream goes on.

    State is kept by the stateful operator, so what was not written does not age a session again."""

    def sink(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception as e:  # noqa: BLE001  whatever the sink raises is that batch's loss alone
            lost(number, f"{type(e).__name__}: {e}")

    return sink
