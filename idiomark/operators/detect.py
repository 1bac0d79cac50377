"""The detector: does a text count, and is it certain.

Everything is a column of the text, so a detector pass is one narrow stage; the
window bounds the work of a long text before any pattern runs over it. The verdict
leaves it through a generator of one row: a filter on it is not pushed below, where
it would be evaluated again with all that it is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiomark.functions import tokens as tk
from idiomark.functions.lexicon import Lexicon, bernese
from idiomark.functions.text import WS, windowed

TOKEN = "array<struct<w:string,k:string,si:int>>"


def eligible(text: Column) -> Column:
    """Not blank, and without the opt-out tag."""
    return F.coalesce((F.regexp_replace(text, f"[{WS}]+", "") != "") & ~F.lower(text).contains("[hd]"), F.lit(False))


def explain(df: DataFrame, text: Column, lex: Lexicon | None = None, prefix: str = "") -> DataFrame:
    """Adds window, tokens, grounded, matched, certain and fire, so that a verdict can be read off.

    A null text has a null window, no token and no verdict."""
    lex = lex or bernese()
    n = lambda x: prefix + x
    d = windowed(df, text, n("window"))
    w = F.coalesce(F.col(n("window")), F.lit(""))
    d = d.withColumn(n("tokens"), tk.tokens(w))
    return _decided(d, n, lex)


def _decided(d: DataFrame, n, lex: Lexicon) -> DataFrame:
    d = d.withColumn(n("_marks"), tk.marked(F.col(n("tokens")), lex))
    d = d.withColumn(n("grounded"), tk.grounded(F.col(n("_marks")), lex))
    d = d.withColumn(n("_marks"), tk.accepted(F.col(n("_marks")), F.col(n("grounded")), lex))
    d = d.withColumn(n("matched"), tk.supporting(F.col(n("_marks")), lex))
    d = d.withColumn(n("_certain"), tk.certain(F.col(n("_marks")), lex))
    fire = F.col(n("_certain")) | tk.enough(F.col(n("matched")), lex)
    verdict = F.inline(F.array(F.struct(F.col(n("_certain")).alias(n("certain")), fire.alias(n("fire")))))
    return d.select(*[F.col(f"`{c}`") for c in d.columns if c not in (n("_marks"), n("_certain"), n("certain"), n("fire"))], verdict)


def detect(df: DataFrame, text: Column, lex: Lexicon | None = None, prefix: str = "") -> DataFrame:
    """Adds fire and certain. Texts without any possible marker are not tokenised further."""
    lex = lex or bernese()
    n = lambda x: prefix + x
    d = windowed(df, text, n("window"))
    w = F.coalesce(F.col(n("window")), F.lit(""))
    d = d.withColumn(n("tokens"), F.when(tk.candidates(w, lex), tk.tokens(w, lex)).otherwise(F.array().cast(TOKEN))).drop(n("window"))
    return _decided(d, n, lex).drop(n("tokens"), n("grounded"), n("matched"))
