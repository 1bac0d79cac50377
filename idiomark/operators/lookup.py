"""Looking words up in landed dictionary pages (query, page_no, html).

The walk over result pages is a cut-off: it ends at the first page with an exact
entry, or at the last page that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.functions import html as h

EXACT, ABSENT, UNKNOWN = "EXACT", "ABSENT", "UNKNOWN"


def entries(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = (), base: str = h.ENTRY_URL) -> DataFrame:
    """One row per entry: kept columns, position on the page, word, pos, alt, gloss, url."""
    d = pages.select(*keep, F.posexplode(h.entries(h.above_footer(F.col(html)))).alias("position", "e"))
    fields = [h.clean(F.col(f"e.{f}")).alias(f) for f in ("word", "pos", "alt", "gloss")]
    return d.select(*keep, "position", *fields, F.concat(F.lit(base), F.col("e.id")).alias("url"))


def lookup(pages: DataFrame, most_pages: int = h.MOST_PAGES, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(status of each query, entries shown for it).

    Status: query, status, pages_read, exhausted, n_exact, n_related. EXACT where a
    head form is the query; ABSENT where all pages were read without one; UNKNOWN
    where the limit of pages, or a page without content, kept it open. Shown are all
    exact entries and the first `limit` related ones."""
    p = pages.select(F.col("query"), F.col("page_no").cast("int").alias("page_no"), "html")
    tidy = h.tidy(F.col("query"))
    p = p.withColumn("needle", h.norm(F.when(tidy != "", tidy).otherwise(F.col("query"))))
    total = p.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("page_no") == 1, h.last_page(F.col("html")))), F.lit(1)).alias("total"), F.bool_or(F.col("html").isNull()).alias("broken"))
    read = p.join(total, "query").filter(F.col("page_no") <= F.least(F.col("total"), F.lit(most_pages)))
    e = entries(read.filter(F.col("html").isNotNull()), "html", ("query", "needle", "page_no"))
    e = e.withColumn("heads", h.heads(F.col("word"), F.col("pos"), F.col("alt"))).withColumn("exact", F.array_contains("heads", F.col("needle")))
    first = e.filter("exact").groupBy("query").agg(F.min("page_no").alias("stop"))
    e = e.join(first, "query", "left").filter(F.col("stop").isNull() | (F.col("page_no") <= F.col("stop")))
    found = e.groupBy("query").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_related"))
    s = total.join(first, "query", "left").join(found, "query", "left")
    exhausted = F.col("stop").isNotNull() | ((F.col("total") <= most_pages) & ~F.col("broken"))
    status = s.select(
        "query",
        F.when(F.col("stop").isNotNull(), EXACT).when(exhausted, ABSENT).otherwise(UNKNOWN).alias("status"),
        F.coalesce(F.col("stop"), F.least(F.col("total"), F.lit(most_pages))).cast("int").alias("pages_read"),
        exhausted.alias("exhausted"),
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_related", F.lit(0)).alias("n_related"),
    )
    nth = F.row_number().over(Window.partitionBy("query", "exact").orderBy("page_no", "position"))
    shown = e.withColumn("_n", nth).filter(F.col("exact") | (F.col("_n") <= limit)).drop("_n", "stop", "needle")
    return status, shown


def verdict(status: DataFrame) -> DataFrame:
    """One exit status over all queries: 2 with any unknown, else 1 with any absent, else 0."""
    return status.agg(F.coalesce(F.max(F.when(F.col("status") == UNKNOWN, 2).when(F.col("status") == ABSENT, 1).otherwise(0)), F.lit(0)).alias("exit_code"))
