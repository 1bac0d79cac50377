"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size (words of its documents). The sources share
a total in proportion to their weights; a source's target stops at `cap` times
its size, and what is above goes to the others by weight, until none is above.
A source then takes floor(target / size) whole repetitions of every document
and a fractional one: its documents in seeded order until the rest of the target
is reached. The document at which it is reached gives only its first words.

Nothing is keyed by source alone: documents are dealt by (source, bucket of the
seeded hash), so a source with a third of all rows is spread over many tasks. A
bucket that equal or null ids crowd is dealt further by where its rows were read.
Sums go up from buckets to groups of buckets to sources, and come back as running
totals the same way, so no task sees all buckets of a source.

Defined cases: a null source is a source of its own, the last; a null or empty
text has size 0 and gives nothing; a source of size 0 has target 0; repeated
rows count each; an empty table gives no row; other columns are carried only if
asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.llm.common import globally_indexed, kept, n_words, read

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a bucket, times that when it counts as crowded, buckets of a group, sub-buckets whose list is broadcast.
BUCKET_ROWS, CROWDED, GROUP, MOST_BROADCAST = 512, 8, 4096, 200_000


def water_level(sources: DataFrame, total: float) -> float:
    """The level L at which the targets least(cap, weight * L) add up to total.

    One aggregate per round; a source that reaches its cap stays there, so the
    level only rises and the rounds end when no further source is clamped."""
    level, clamped = 0.0, -1
    while True:
        at = F.col("weight") * F.lit(level) >= F.col("cap")
        row = sources.agg(
            F.sum(F.when(at, F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(at, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(at).alias("n"),
        ).first()
        if row["n"] == clamped or not row["open"]:
            return level
        clamped = row["n"]
        level = (total - row["full"]) / row["open"]


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds weight, cap and target to (source, source_size)."""
    ranked = globally_indexed(per_source, [F.col("source").asc_nulls_last()], "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    s = kept(ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(s, share * total)
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def mix(df: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), whole (repetitions), part (words of the
    fractional repetition), and the columns of `carry`."""
    base = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col).cast("string")).alias("size"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumns({"_u": F.xxhash64(F.lit(seed), "doc_id"), "_read": F.monotonically_increasing_id()})
    rows = df.select(F.lit(1)).count()
    n = max(1, -(-rows // BUCKET_ROWS))
    # Buckets follow the seeded order: they are equal ranges of the hash.
    base = base.withColumn("_bucket", F.least(F.lit(n - 1), F.floor((F.col("_u").cast("double") / 2.0**64 + 0.5) * F.lit(n))).cast("long"))
    counted = kept(base.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_rows")))
    crowded = counted.filter(F.col("_rows") > CROWDED * BUCKET_ROWS).select(F.col("source").alias("_s"), F.col("_bucket").alias("_c"), F.ceil(F.col("_rows") / BUCKET_ROWS).cast("long").alias("_deal"))
    if hot := crowded.count():
        few = F.broadcast(crowded) if hot <= MOST_BROADCAST else crowded
        base = base.join(few, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_c")), "left")
        base = base.withColumn("_sub", F.coalesce(F.pmod(F.xxhash64("_read"), "_deal"), F.lit(0).cast("long"))).drop("_s", "_c", "_deal")
        sums = kept(base.groupBy("source", "_bucket", "_sub").agg(F.sum("size").alias("_sum")))
    else:
        base = base.withColumn("_sub", F.lit(0).cast("long"))
        sums = counted.select("source", "_bucket", F.lit(0).cast("long").alias("_sub"), "_sum")
    per_source = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    plan = targets(per_source, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("_rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    below = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    groups = sums.groupBy(F.col("source").alias("_s"), F.col("_group").alias("_g")).agg(F.sum("_sum").alias("_all"))
    groups = groups.withColumn("_lower", F.coalesce(F.sum("_all").over(below("_s").orderBy("_g")), F.lit(0)))
    within = F.coalesce(F.sum("_sum").over(below("source", "_group").orderBy("_bucket", "_sub")), F.lit(0))
    at = sums.withColumn("_within", within).join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g")))
    at = at.withColumn("_before", F.col("_lower") + F.col("_within")).alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")))
    at = at.select(F.col("a.source").alias("_source"), F.col("_bucket").alias("_b"), F.col("_sub").alias("_d"), "_before", "source_size", "target", "whole", "_rest")
    own = base.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")) & (F.col("_sub") == F.col("_d")))
    run = F.sum("size").over(Window.partitionBy("source", "_bucket", "_sub").orderBy("_u", "doc_id", "_read").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("_rest") - F.col("_before") - F.coalesce(run, F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return own.withColumn("part", part).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("part")).alias("taken"),
        "whole",
        "part",
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def first_words(texts, counts):
    """Column: the text up to the end of its first `count` words; the whole text where count is null."""

    @F.arrow_udf("string")
    def cut(t, n):
        import re

        import pyarrow as pa

        word, out = re.compile(r"[^\x20\x09-\x0D]+"), []
        for text, k in zip(t.to_pylist(), n.to_pylist(), strict=True):
            if text is not None and k is not None:
                end = 0
                for i, m in enumerate(word.finditer(text)):
                    if i == k:
                        break
                    end = m.end()
                text = text[:end]
            out.append(text)
        return pa.array(out, pa.string())

    return cut(texts, counts)


def mixture(df: DataFrame, **options) -> DataFrame:
    """The mix itself, with df's columns: a row for each whole repetition, and one with the first words of a fractional
    repetition. n_chars, where present, follows the text."""
    names = df.columns
    m = _carried(df, options)
    pieces = F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.col("_whole").cast("int")),
        F.when((F.col("_part") > 0) & (F.col("_part") < F.col("_size")), F.array(F.col("_part"))).when(F.col("_part") > 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>")),
    )
    m = m.withColumn("_cut", F.explode(pieces))
    text = first_words(F.col("_row.text"), F.col("_cut"))
    m = m.withColumn("_text", text)
    out = []
    for c in names:
        if c == "text":
            out.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("_cut").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text")).cast(df.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return m.select(*out)


def _carried(df: DataFrame, options: dict) -> DataFrame:
    wrapped = df.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    m = mix(wrapped, carry=("_row",), **options)
    return m.select(F.col("whole").alias("_whole"), F.col("part").alias("_part"), F.col("size").alias("_size"), "_row")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
