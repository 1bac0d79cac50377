"""Measuring the detector: confusion, intervals, gate, metamorphic relations, probes, window invariants."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idiomark.functions import tokens as tk
from idiomark.functions.lexicon import Lexicon
from idiomark.functions.text import HEAD, TAIL, nfd, windowed
from idiomark.operators.detect import detect

# The quality floors.
MIN_RECALL, MIN_PRECISION, MOST_FALSE_POSITIVES, MOST_FALSE_NEGATIVES, LEAST_ROWS = 0.95, 0.97, 0, 4, 20
LOG_LINE, LOG_LINES = "2026-08-01 INFO request handled in 4ms\n", 5000


def confusion(df: DataFrame, fired: str, wanted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn; rows without a verdict or a label count nowhere."""
    f, w = F.col(fired), F.col(wanted)
    return df.groupBy(*by).agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & ~w).alias("tn"), F.count_if(~f & w).alias("fn"))


def by_kind(df: DataFrame, fired: str, wanted: str, kind: str) -> DataFrame:
    """Kinds with errors: wrong and total, the worst first."""
    wrong = F.count_if(F.col(fired) != F.col(wanted))
    return df.groupBy(F.col(kind).alias("kind")).agg(wrong.alias("wrong"), F.count(F.lit(1)).alias("total")).filter("wrong > 0").orderBy(F.desc("wrong"), "kind")


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, low, high) of the score interval; zeros where there is nothing to share."""
    n, h = total.cast("double"), hits.cast("double")
    p = h / F.when(n > 0, n)
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    some = total > 0
    return (
        F.when(some, p).otherwise(0.0),
        F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0),
        F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(0.0),
    )


def summary(counts: DataFrame) -> DataFrame:
    """Confusion counts with recall and precision and their intervals."""
    out = counts
    for name, hits, total in (("recall", F.col("tp"), F.col("tp") + F.col("fn")), ("precision", F.col("tp"), F.col("tp") + F.col("fp"))):
        p, low, high = wilson(hits, total)
        out = out.withColumns({name: p, name + "_low": low, name + "_high": high})
    return out


def gate(scores: DataFrame, relations: int | Column = 0, probes: int | Column = 0) -> DataFrame:
    """Whether the floors hold, and the names of those that do not, in order."""
    tests = (
        ("recall", F.col("recall") < MIN_RECALL),
        ("precision", F.col("precision") < MIN_PRECISION),
        ("false positives", F.col("fp") > MOST_FALSE_POSITIVES),
        ("false negatives", F.col("fn") > MOST_FALSE_NEGATIVES),
        ("relations", (F.lit(relations) if isinstance(relations, int) else relations) > 0),
        ("probes", (F.lit(probes) if isinstance(probes, int) else probes) > 0),
    )
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))
    return scores.withColumn("reasons", F.array_join(reasons, ", ")).withColumn("passed", F.size(reasons) == 0)


class Relation(NamedTuple):
    """A change of a text that must not change the verdict, or, of texts with one label, not against it."""

    name: str
    change: Callable[[Column], Column]
    wanted: bool | None = None
    most_chars: int | None = None


def _around(before: str = "", after: str = "") -> Callable[[Column], Column]:
    return lambda t: F.concat(F.lit(before), t, F.lit(after))


# What the relations put before and after a text.
INVARIANCES = (
    Relation("trailing whitespace", _around(after="   \n")),
    Relation("leading whitespace", _around(before="\n  ")),
    Relation("wrapped in quotes", _around('"', '"')),
    Relation("decomposed", nfd),
    Relation("trailing emoji", _around(after=" 🙂")),
    Relation("doubled", lambda t: F.concat(t, F.lit(" "), t)),
)
DIRECTIONALS = (
    Relation("append more dialect", _around(after=" u de."), True),
    Relation("prepend more dialect", _around(before="u de. "), True),
    Relation("append neutral English", _around(after=" Thanks in advance."), False),
    Relation("append a file path", _around(after=" See src/main/java/ch/isch/gsi/Service.java"), False),
    Relation("append a pod name", _around(after=" Pod itz9q_gsi3 restarted."), False),
    Relation("followed by a long log", lambda t: F.concat(t, F.lit("\n"), F.repeat(F.lit(LOG_LINE), LOG_LINES)), True, HEAD),
    Relation("preceded by a long log", lambda t: F.concat(F.repeat(F.lit(LOG_LINE), LOG_LINES), F.lit("\n"), t), True, HEAD),
)


def metamorphic(df: DataFrame, text: str, lex: Lexicon, relations: tuple[Relation, ...] = INVARIANCES + DIRECTIONALS, wanted: str | None = None) -> DataFrame:
    """relation, rows in its scope, violations, and whether it fails (also with too few rows in scope).

    The first verdict is taken once. Each relation that a text is in the scope of is a
    row with no more of the changed text than the window is cut from, so that one
    detector serves all relations, and what waits for its Python step is short. A
    directional relation holds for rows with its label; without a label column, for
    rows whose first verdict is its label."""
    d = detect(df.select(F.col(text).alias("_text"), *([F.col(wanted).alias("_wanted")] if wanted else [])).filter(F.col("_text").isNotNull()), F.col("_text"), lex, "_0")
    if not wanted:
        d = d.withColumn("_wanted", F.col("_0fire"))
    scopes = []
    for r in relations:
        scope = F.lit(True) if r.wanted is None else F.col("_wanted") == r.wanted
        scopes.append(scope & (F.length("_text") <= r.most_chars) if r.most_chars else scope)
    d = d.select("_text", "_0fire", F.explode(F.array_compact(F.array(*[F.when(scope, F.lit(i)) for i, scope in enumerate(scopes)]))).alias("_i"))
    at = [F.col("_i") == i for i in range(len(relations))]
    d = d.withColumn("_changed", F.coalesce(*[F.when(here, r.change(F.when(here, F.col("_text")))) for here, r in zip(at, relations, strict=True)]))
    d = detect(d.select("_i", "_0fire", "_changed"), F.col("_changed"), lex, "_1")
    now, was = F.col("_1fire"), F.col("_0fire")
    parts = []
    for here, r in zip(at, relations, strict=True):
        wrong = (now != was) if r.wanted is None else (was & ~now) if r.wanted else (now & ~was)
        parts.append(F.struct(F.lit(r.name).alias("relation"), F.count_if(here).alias("n_rows"), F.count_if(here & wrong).alias("violations")))
    out = d.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.withColumn("failed", (F.col("violations") > 0) | (F.col("n_rows") < LEAST_ROWS))


def probes(spark: SparkSession, rows: list[tuple[bool, str, str]], lex: Lexicon, of: str = "fire") -> DataFrame:
    """name, want, got, wrong of literal texts."""
    d = spark.createDataFrame(rows, "want boolean, name string, text string")
    got = detect(d, F.col("text"), lex)
    return got.select("name", "want", F.col(of).alias("got"), (F.col(of) != F.col("want")).alias("wrong"))


def failures(results: DataFrame, failed: str) -> DataFrame:
    """One row: n, how many results failed."""
    return results.agg(F.count_if(F.col(failed)).alias("n"))


def gated(scores: DataFrame, relations: DataFrame, probed: DataFrame) -> DataFrame:
    """The gate, fed with violated relations (violations) and missed probes (wrong); each side is one row."""
    broken = relations.agg(F.coalesce(F.sum(F.greatest(F.col("violations"), F.col("failed").cast("long"))), F.lit(0)).alias("_relations"))
    one = scores.crossJoin(broken).crossJoin(failures(probed, "wrong").withColumnRenamed("n", "_probes"))
    return gate(one, F.col("_relations"), F.col("_probes"))


def repeated(df: DataFrame, *by: str) -> DataFrame:
    """Values that stand in more than one row, and in how many."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violating(df: DataFrame, text: str, lex: Lexicon, relation: Relation, key: str, most: int = 4) -> DataFrame:
    """The first rows, by key, that break a relation: key, relation, before, after."""
    d = detect(df.select(F.col(key).alias(key), F.col(text).alias("_text")).filter(F.col("_text").isNotNull()), F.col("_text"), lex, "_0")
    d = detect(d.withColumn("_changed", relation.change(F.col("_text"))), F.col("_changed"), lex, "_1")
    was, now = F.col("_0fire"), F.col("_1fire")
    wrong = (now != was) if relation.wanted is None else (was & ~now) if relation.wanted else (now & ~was)
    if relation.most_chars:
        wrong = wrong & (F.length("_text") <= relation.most_chars)
    return d.filter(wrong).select(key, F.lit(relation.name).alias("relation"), was.alias("before"), now.alias("after")).orderBy(key).limit(most)


def window_properties(df: DataFrame, text: str) -> DataFrame:
    """Over all texts: how many break a property of the scan window.

    It is no longer than its halves and a line feed, it is not empty where a long
    text has a word in its halves' reach, and each of its words is a word of the text."""
    d = windowed(df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()), F.col("t"), "w")
    own, all_ = tk.words(F.col("w")), tk.words(F.regexp_replace(F.col("t"), "['’]", ""))
    invented = F.size(F.array_except(own, F.array_union(all_, tk.words(F.col("t"))))) > 0
    return d.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.length("w") > HEAD + TAIL + 1).alias("too_long"),
        F.count_if((F.length("w") == 0) & F.substring("t", 1, HEAD).rlike(r"(?s)^[^@:.\-]*\p{L}[^@:.\-]*$")).alias("empty"),
        F.count_if(invented).alias("invented"),
    )
