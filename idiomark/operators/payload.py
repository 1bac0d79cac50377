"""What a firing turn is told: the composed context of each delivery.

A full payload is the rulebook with its overlays. Else the turn gets a pointer to the
user's own rulebook, where one overrides the default and can be read, or the short
checklist; and a line that the rulebook went out earlier, where it did. All texts are
parameters: a small table of files on the driver's side, never one per turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiomark.operators.session import CHECKLIST, FULL, POINTER


@dataclass(frozen=True)
class Wording:
    """The fixed lines around a payload; {path} and {tool} are filled in."""

    tag: str = "house-style"
    intro: str = "The message seems to be in the dialect. If so, answer in it, in this style; if not, ignore this block."
    pointer: str = "Follow the rulebook at {path}: it is in force for this user and replaces any default."
    earlier: str = "(The full rulebook was loaded earlier in this session.)"
    hint: str = "When unsure of a word, look it up: `{tool} <word>`. Without an exact entry it is no headword."


def choice(emitted: Column, overridden: bool, readable: bool) -> Column:
    """FULL, POINTER or CHECKLIST: a pointer only to a rulebook of the user's own that can be read."""
    return F.when(emitted, FULL).otherwise(POINTER if overridden and readable else CHECKLIST)


def composed(delivered: DataFrame, rulebook: tuple[str, str, bool] | None, overlays: list[str], checklist: str, overridden: bool = False, tool: str | None = None, words: Wording | None = None) -> DataFrame:
    """delivered (emitted, served_before) with payload_kind and context.

    rulebook is (path, body, valid), None where there is none; blank overlays are left out."""
    words = words or Wording()
    readable = bool(rulebook and rulebook[2])
    kind = choice(F.col("emitted") & F.lit(readable), overridden, readable)
    full = [rulebook[1], *[o for o in overlays if o.strip()], ""] if readable else []
    instead = words.pointer.format(path=rulebook[0]) if overridden and readable else checklist
    body = F.when(kind == FULL, F.lit("\n".join(full))).otherwise(F.concat(F.lit(instead + "\n"), F.when(F.col("served_before"), words.earlier + "\n").otherwise("")))
    begin, end = f"<{words.tag}>\n{words.intro}\n\n", f"</{words.tag}>"
    hint = words.hint.format(tool=tool) + "\n" if tool else ""
    return delivered.withColumn("payload_kind", kind).withColumn("context", F.concat(F.lit(begin), body, F.lit("\n" + hint + end)))
