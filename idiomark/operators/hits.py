"""Markers as a relation: exploded tokens against the lexicon table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.functions import tokens as tk

#: Forms of a lexicon that is broadcast, some 50 bytes each.
MOST_FORMS = 100_000


def hits(df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """form, tier, n_docs, n_hits of the listed forms that stand in the texts.

    A lexicon is a page of words; it is counted, and broadcast if it is one, so that tokens that are not in it never
    leave their task. A larger one is shuffled."""
    forms = lexicon.select("form", "tier").distinct()
    if forms.limit(MOST_FORMS + 1).count() <= MOST_FORMS:
        forms = F.broadcast(forms)
    t = df.select(F.col(id_col).alias("_id"), F.explode(tk.word_tokens(F.coalesce(F.col(text), F.lit("")))).alias("w")).select("_id", F.lower("w").alias("form"))
    per_text = t.join(forms, "form").groupBy("form", "tier", "_id").count()
    return per_text.groupBy("form", "tier").agg(F.count("_id").alias("n_docs"), F.sum("count").alias("n_hits"))
