"""Ranking articles by marker density, and names for their files."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.functions.scoring import KEEP, LEAST_CHARS, density
from idiomark.functions.text import slug


def scored(df: DataFrame, title: str = "title", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """title, text, score of texts that are long enough."""
    d = df.select(F.col(title).alias("title"), F.col(text).alias("text")).filter(F.length("text") >= least_chars)
    return d.withColumn("score", density(F.col("text")))


def kept(articles: DataFrame, keep: float = KEEP) -> DataFrame:
    """Articles that reach the score, the highest first."""
    return articles.filter(F.col("score") >= keep).orderBy(F.desc("score"), F.desc("title"), F.desc("text"))


def _numbered(names: list[str]) -> list[str]:
    """Each name in turn, or the first of name-2, name-3, ... that no earlier one has; without regard to case."""
    taken, out = set(), []
    for name in names:
        free = next(x for x in chain([name], (f"{name}-{k}" for k in count(2))) if x.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def named(articles: DataFrame) -> DataFrame:
    """Adds slug, unique without regard to case: of equal names the best article keeps the bare one, the next get -2, -3.

    Names can only meet if they are equal without numbers at their ends. Where all names of such a family are equal, the
    number is a place in a window; a family in which some have numbers of their own is numbered in turn, as rows without
    their texts."""
    order = [F.desc("score"), F.desc("title"), F.desc("text")]
    d = articles.withColumn("_own", slug(F.col("title"))).withColumn("_root", F.regexp_replace(F.lower("_own"), r"(-\d+)+\z", ""))
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_root").orderBy(*order)))
    mixed = d.groupBy("_root").agg((F.min(F.lower("_own")) != F.max(F.lower("_own"))).alias("_mixed"))
    d = d.join(mixed, "_root")
    plain = d.filter(~F.col("_mixed")).withColumn("slug", F.when(F.col("_nth") > 1, F.concat("_own", F.lit("-"), F.col("_nth").cast("string"))).otherwise(F.col("_own")))

    def in_turn(rows):
        rows = rows.sort_values("_nth")
        return rows.assign(slug=_numbered(rows["_own"].tolist()))

    few = d.filter("_mixed").select("_root", "_nth", "_own").groupBy("_root").applyInPandas(in_turn, "_root string, _nth int, _own string, slug string")
    rest = d.filter("_mixed").join(few.select("_root", "_nth", "slug"), ["_root", "_nth"])
    return plain.select(*articles.columns, "slug").union(rest.select(*articles.columns, "slug"))


def article_file(title, text):
    """Content of an article's file: three lines of attribution, an empty one, the text."""
    where = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    return F.concat(F.lit("# "), title, F.lit("\n# Source: https://als.wikipedia.org/wiki/"), F.replace(where, F.lit("+"), F.lit("%20")), F.lit("\n# Alemannic Wikipedia authors, CC BY-SA 4.0\n\n"), text, F.lit("\n"))
