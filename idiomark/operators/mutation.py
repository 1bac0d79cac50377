"""Scores of a mutation-testing session: each mutant's function by its line, per-function and total scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULE = "<module level>"
KILLED, FLOOR = "KILLED", 85.0


#: Lines of a bucket of the range join.
LINES = 64


def outcomes(specs: DataFrame, results: DataFrame, spans: DataFrame) -> DataFrame:
    """(line, outcome, name): mutants with results, each with the first function whose lines hold it.

    The range join is an equi-join on buckets of lines, of which a span covers one or
    more; whether a side is small enough to broadcast is left to the planner."""
    rows = specs.join(results, "job_id").select("job_id", F.col("start_pos_row").alias("line"), F.col("test_outcome").alias("outcome"))
    bucket = lambda c: F.floor(c / LINES).cast("long")
    s = spans.filter("lo <= hi").select("lo", "hi", F.col("name").alias("_name"), F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("_bucket"))
    inside = (bucket(F.col("line")) == F.col("_bucket")) & (F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi"))
    held = rows.join(s, inside, "left")
    first = held.groupBy("job_id", "line", "outcome").agg(F.min(F.when(F.col("_name").isNotNull(), F.struct("lo", "hi", "_name")))["_name"].alias("name"))
    return first.select("job_id", "line", "outcome", F.coalesce("name", F.lit(MODULE)).alias("name"))


def scores(found: DataFrame, only: list[str] | None = None) -> DataFrame:
    """name (null for all together), total, survived, score in percent; anything but a kill survives."""
    d = found.filter(F.col("name").isin(only)) if only else found
    r = d.rollup("name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") != KILLED).alias("survived"))
    return r.withColumn("score", 100 * (F.col("total") - F.col("survived")) / F.col("total"))


def ranked(s: DataFrame) -> DataFrame:
    """Functions, the best caught first, the larger first among equals."""
    return s.filter(F.col("name").isNotNull()).orderBy(F.col("survived") / F.col("total"), F.desc("total"), "name")


def completeness(items: DataFrame, results: DataFrame) -> DataFrame:
    """finished, planned, complete."""
    planned, finished = items.agg(F.count(F.lit(1)).alias("planned")), results.agg(F.count(F.lit(1)).alias("finished"))
    return finished.crossJoin(planned).withColumn("complete", F.col("finished") == F.col("planned"))


def unprotected(s: DataFrame) -> DataFrame:
    """Functions in which every mutant survived."""
    return s.filter(F.col("name").isNotNull() & (F.col("survived") == F.col("total"))).select("name", "total")


def missing(wanted: DataFrame, defined: DataFrame, name: str = "name") -> DataFrame:
    """Names of a list that nothing defines."""
    return wanted.join(defined, name, "left_anti").select(name).distinct()


def measured(df: DataFrame, stamp: str, source, scope: str | None = None, wanted: str | None = None) -> DataFrame:
    """df; the query fails if a row's stamp is not the sha-256 of the source that it claims to measure, or its scope another one."""
    right = F.col(stamp).eqNullSafe(F.sha2(source, 256))
    said = F.when(~right, F.lit("measured against another source: run again"))
    if scope:
        said = F.coalesce(said, F.when(~F.col(scope).eqNullSafe(F.lit(wanted)), F.lit("recorded with another scope: run again")))
    checked = df.withColumn("_said", said)
    fine = F.when(F.col("_said").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_said")).cast("boolean"))
    return checked.filter(fine).drop("_said")


def passes(s: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The overall row and whether it reaches the floor."""
    return s.filter(F.col("name").isNull()).select("total", "survived", "score", (F.col("score") >= floor).alias("passed"))


def summary(s: DataFrame, complete: DataFrame, scope: str) -> DataFrame:
    """One line of JSON about a run: its scope, score, mutants, and whether all of them ran. Both sides are one row."""
    one = s.filter(F.col("name").isNull()).select("total", "survived", F.round("score", 1).alias("score")).crossJoin(complete)
    line = F.struct(
        F.lit(scope).alias("scope"),
        "score",
        F.col("total").alias("mutants"),
        "survived",
        "complete",
        F.col("finished").alias("ran"),
        "planned",
    )
    return one.select(F.to_json(line).alias("line"))


def verdict(s: DataFrame, complete: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One exit status of a run: 2 if not every mutant ran, else 1 below the floor, else 0. Both sides are one row."""
    one = passes(s, floor).select("passed").crossJoin(complete.select("complete"))
    return one.select(F.when(~F.col("complete"), 2).when(~F.col("passed"), 1).otherwise(0).alias("exit_code"))
