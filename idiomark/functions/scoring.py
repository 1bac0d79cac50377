"""Marker density, shared vocabulary and word sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idiomark.functions.text import L, nfc
from idiomark.functions.tokens import words

# Markers of the density score with their weights, least score kept, least length scored.
DENSITY = (
    (1, "gsy isch nid nüt het hei chunt geng gäng äbe öppis"),
    (4, "mittuland aut wäut viu wöu gäud schnäu miuch sou wott gäu hauber bevöukerig vouk säuber äuwä merkmau gäute gfüeu gieu"),
    (-6, "nöd gsii gsi bikannt deet hän sinn ziit zwoi nüüt"),
)
KEEP, LEAST_CHARS = 1.0, 800
# Words that name sources; sequences of them are citations.
CITATION = """
marti werner bietenhard ruth greyerz otto von pinheiro weber ursula zingg hans jürg dieth eugen francke cosmos bern auflage
berndeutsches wörterbuch bärndütschi schrybwys bärndütsch schrybe schriftsprach nach usschpraach naach uussprach grammatik
cc by nd sa spdx license identifier
""".split()
#: Shortest example word, and how many examples must stand in backticks; longest sequence compared.
LEAST_WORD, LEAST_EXAMPLES, LONGEST = 3, 20, 8


def density(text: Column, weights=DENSITY) -> Column:
    """Weighted whole-word markers per 1000 characters; null for a null or empty text."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{L}\p{{Nd}}_]+"), F.lit(0))

    def worth(w):
        out = F.lit(0)
        for weight, forms in weights:
            out = F.when(w.isin(forms.split()), weight).otherwise(out)
        return out

    total = F.aggregate(runs, F.lit(0), lambda a, w: a + worth(w))
    return F.when(F.length(text) > 0, total / F.length(text) * 1000)


def composed_words(text: Column) -> Column:
    return words(nfc(text))


def examples(text: Column) -> Column:
    """Distinct example words: those in backticks, or all words where too few stand there."""
    spans = F.array_join(F.regexp_extract_all(nfc(text), F.lit("`([^`]+)`"), F.lit(1)), " ")
    quoted = F.array_distinct(F.filter(words(spans), lambda w: F.length(w) >= LEAST_WORD))
    every = F.array_distinct(F.filter(composed_words(text), lambda w: F.length(w) >= LEAST_WORD))
    return F.when(F.size(quoted) < LEAST_EXAMPLES, every).otherwise(quoted)


def phrases(w: Column, n: int) -> Column:
    """Distinct sequences of n words."""
    starts = F.sequence(F.lit(1), F.size(w) - n + 1)
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def classify(gram: Column) -> Column:
    """LETTERS, citation or OTHER."""
    parts = F.split(gram, " ")
    return F.when(F.forall(parts, lambda p: F.length(p) == 1), "LETTERS").when(F.forall(parts, lambda p: p.isin(CITATION)), "citation").otherwise("OTHER")
