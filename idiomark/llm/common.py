"""Shared folders, reliable checkpoints, global prefix sums and text blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all run on this machine, a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="idiomark-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in reliable storage; its lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def globally_indexed(df: DataFrame, order: list, index: str) -> DataFrame:
    """Adds the 0-based position of each row in the order given.

    Two passes: range partitions are sorted and kept, their row counts (one per
    partition) come to the driver and go back as offsets. No single task sees
    all rows.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below
    d = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_mono", 33).cast("int"))
    sizes = sorted(d.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    o = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long"))
    return d.join(o, "_part").withColumn(index, F.col("_offset") + F.col("_mono").bitwiseAND(F.lit(low))).drop("_part", "_offset", "_mono")


def salted_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, how: str = "left", share: int = 1000, salts: int = 32) -> DataFrame:
    """left joined to right, which has one row or few for each key. left is read three times: keep it first if it is costly.

    Keys that hold over 1 / share of left's rows are hot: there can be at most
    `share` of them, so their list is bounded. Left's rows of a hot key are dealt
    to `salts` tasks, and right's rows of it are repeated for each."""
    counts = left.groupBy(F.col(left_key).alias("_k")).count()
    total = left.select(F.lit(1)).count()
    hot = [r["_k"] for r in counts.filter((F.col("count") * share > total) & (F.col("count") > 1000) & F.col("_k").isNotNull()).collect()]
    if not hot:
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    number = F.when(F.col(left_key).isin(hot), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if t in ("bigint", "int", "string")]), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    a = left.withColumn("_salt_l", number)
    b = right.withColumn("_salt_r", F.explode(F.when(F.col(right_key).isin(hot), F.array(*[F.lit(i).cast("long") for i in range(salts)])).otherwise(F.array(F.lit(0).cast("long")))))
    return a.join(b, (F.col(left_key) == F.col(right_key)) & (F.col("_salt_l") == F.col("_salt_r")), how).drop("_salt_l", "_salt_r")


def blocks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths add up to at most limit; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows from now on: the executor and its workers hold whole batches of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def trim() -> None:
    """Gives memory that this process no longer uses back to the machine.

    Workers live on between tasks, and an executor has room for what they use, not for the most they ever used."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches):
    """The batches, with a trim after each."""
    for batch in batches:
        yield batch
        del batch
        trim()


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: 1 for the bytes that the contracts call white space.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(column) -> np.ndarray:
    """Words of each text of an Arrow string array; null counts 0."""
    column = column.fill_null("")
    raw, offsets = byte_view(column)
    out = np.zeros(len(column), np.int64)
    for a, b in blocks(np.diff(offsets), 1 << 22):
        part = raw[offsets[a] : offsets[b]]
        if not len(part):
            continue
        inside = ~_BLANK[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offsets[a:b] - offsets[a]
        nonempty = np.diff(offsets[a : b + 1]) > 0
        first[at[nonempty]] = inside[at[nonempty]]
        total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        out[a:b] = total[offsets[a + 1 : b + 1] - offsets[a]] - total[at]
    return out


def n_words(column):
    """Column of word counts, long."""

    @F.arrow_udf("long")
    def count(texts):
        import pyarrow as pa

        out = pa.array(word_counts(texts.cast(pa.string())), pa.int64())
        trim()
        return out

    return count(column)
