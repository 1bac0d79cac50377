"""Shared vocabulary and shared word sequences of two sets of texts.

Sequences are compared as a join on (n, sequence) of distinct sequences, so no
text meets another as a pair. The side that the plan's statistics call smaller is
counted; if its words and sequences are few enough, they are broadcast, the other
side keeps only stretches of known words, and nothing of it is shuffled but what is
shared. Beyond these counts both sides are shuffled by sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.functions.scoring import LONGEST, classify, composed_words, examples, phrases


def vocabulary(df: DataFrame, text: str, only_examples: bool = False) -> DataFrame:
    words = examples(F.col(text)) if only_examples else composed_words(F.col(text))
    return df.select(F.explode(words).alias("word")).distinct()


def shared_vocabulary(ours: DataFrame, theirs: DataFrame, text: str = "text") -> DataFrame:
    """words, shared, percent (rounded half to even) of our example words that stand in their texts."""
    mine = vocabulary(ours, text, True)
    both = mine.join(vocabulary(theirs, text).withColumn("hit", F.lit(1)), "word", "left")
    out = both.agg(F.count(F.lit(1)).alias("words"), F.count("hit").alias("shared"))
    return out.withColumn("percent", F.when(F.col("words") > 0, F.bround(100 * F.col("shared") / F.col("words"))).otherwise(0.0))


#: Most words whose set is part of an expression, and most sequences that are broadcast (a row has some 100 bytes).
MOST_WORDS, MOST_SEQUENCES = 50_000, 1_000_000


def _checked(least: int, longest: int) -> None:
    if not 1 <= least <= longest:
        raise ValueError(f"sequences have 1 to {longest} words")


def _grams(words: DataFrame, least: int, longest: int) -> DataFrame:
    """(n, gram) of the word arrays w, repeats and all."""
    all_n = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), phrases(F.col("w"), n).alias("g")) for n in range(least, longest + 1)]))
    return words.select(all_n.alias("x")).select("x.n", F.explode("x.g").alias("gram"))


def sequences(df: DataFrame, text: str, least: int, longest: int = LONGEST) -> DataFrame:
    """Distinct (n, gram) for n from least to longest."""
    _checked(least, longest)
    return _grams(df.select(composed_words(F.col(text)).alias("w")), least, longest).distinct()


def _stretches(df: DataFrame, text: str, known: list[str], least: int) -> DataFrame:
    """Word arrays w: the longest stretches of known words, those of `least` words and more."""
    marked = F.transform(composed_words(F.col(text)), lambda x: F.when(x.isin(known), x).otherwise("|"))
    runs = F.split(F.array_join(marked, " "), r" ?\|[ |]*", -1)
    long = F.filter(F.transform(runs, lambda r: F.split(r, " ", -1)), lambda w: F.size(w) >= least)
    return df.select(F.explode(long).alias("w"))


def _size(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shared_sequences(ours: DataFrame, theirs: DataFrame, text: str = "text", least: int = 2, longest: int = LONGEST) -> DataFrame:
    """Distinct (n, gram, class) that stand in both."""
    _checked(least, longest)
    few, many = sorted((ours, theirs), key=_size)
    known = [r["word"] for r in vocabulary(few, text).limit(MOST_WORDS + 1).collect()]
    grams = sequences(few, text, least, longest)
    if len(known) <= MOST_WORDS and grams.limit(MOST_SEQUENCES + 1).count() <= MOST_SEQUENCES:
        found = _grams(_stretches(many, text, sorted(known), least), least, longest) if known else _grams(many.limit(0).select(composed_words(F.col(text)).alias("w")), least, longest)
        both = found.join(F.broadcast(grams), ["n", "gram"], "left_semi").distinct()
    else:
        both = grams.join(sequences(many, text, least, longest), ["n", "gram"], "left_semi")
    return both.withColumn("class", classify(F.col("gram")))


def first_of_each(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each group, with their place; of a group, no task keeps more than these for its partition."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= most)


def tally(shared: DataFrame) -> DataFrame:
    return shared.groupBy("n", "class").count().withColumnRenamed("count", "grams")


def residual(shared: DataFrame) -> DataFrame:
    """Shared sequences that neither letters nor citations explain."""
    return shared.filter(F.col("class") == "OTHER").select("n", "gram")
