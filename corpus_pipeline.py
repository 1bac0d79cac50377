"""The corpus pipeline: filters, deduplicates, mixes and packs `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idiomark.llm import jaccard, langid, mixing, packing, toxicity
from idiomark.llm.common import read, scratch, small_batches


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*_columns(docs))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go: these are texts that hold too few n-grams of their best one."""
    drawn = langid.lessons(docs)
    model = langid.learn(drawn.rows, prior=drawn.prior)
    found = langid.identify(docs, model, lang_name="_lang", score_name="_lang_score", cover_name="_cover")
    return found.filter((F.col("_lang") != langid.UND) & (F.col("_cover") > 0) & (F.col("_cover") >= langid.least_cover(drawn.rows))).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once; one without an id only if none has one.

    Ids may be null or repeated, so rows are told apart by a hash of all their columns."""
    columns = _columns(docs)
    keyed = docs.withColumn("_key", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    groups = jaccard.join(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ranked = groups.join(keyed.select("_key", "doc_id").distinct(), "_key")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("least")).select(F.col("least._key").alias("_key"))
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and fractional repetitions of the documents, so that each source comes to its target."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Classifiers and tokenizers can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
