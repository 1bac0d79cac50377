"""Writers: one text file per article, injections as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.operators.corpus import article_file
from idiomark.operators.session import injection


def articles(named: DataFrame, path: str) -> None:
    """Each article (title, text, slug) below path/slug=<slug>, as a text file that Spark writes."""
    named.select(F.regexp_replace(article_file(F.col("title"), F.col("text")), r"\n\z", "").alias("value"), "slug").write.partitionBy("slug").text(path)


def injections(context: DataFrame, path: str, column: str = "context") -> None:
    """One JSON object per row."""
    context.select(injection(F.col(column)).alias("value")).write.text(path)
