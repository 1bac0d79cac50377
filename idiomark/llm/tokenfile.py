"""Files of token ids: whole documents in ascending id order, in independently coded, checksummed blocks.

A shard is one byte string: a header, an index (document ids, which of them are
null, lengths, the table of how frequent ids are, and the CRC-32 of all this), and
blocks of up to `BLOCK` ids. A block has the number of its ids, the CRC-32 of those
ids as little-endian 32-bit integers, the CRC-32 of its payload, and the payload of
an adaptive context-mixing range coder that starts afresh from the shard's table in
every block (see coder.py). So any block decodes alone, and damage is found and
stays in its block. A shard of few ids has no table: all ids start as equals. Documents never cross shards, blocks cut
them freely. Shards are the rows of a Parquet data set, so any store that Spark
writes to can hold them.

Rows are range-partitioned by document id, a hash of the text, and the partition
they were read in, so that not even a repeated row piles up, and sorted; each partition writes its
shards in order, with at most `SHARD` ids each unless one document has more.
Reading decodes shards in parallel and takes running totals of partitions from
the shards' headers, one number per partition on the driver.

Defined cases: a null or empty text is its end id alone; null ids come first and
are read back as null; equal ids follow each other in order of a hash of the text;
an empty table makes no shard; a damaged index or block raises ValueError; ids of
65536 and more raise ValueError; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm import coder
from idiomark.llm.common import partitions, read, scratch
from idiomark.llm.tokens import encode, public_path, text_blocks

BLOCK, SHARD = 2048, 8_000_000
MAGIC = b"IMT2"
#: magic, block length, documents, bytes of the table, ids, ids before it in its partition, CRC-32 of the index
HEADER = struct.Struct("<4sIIIQQI")
#: A table stands in shards with so many ids for each different one.
WORTH_A_TABLE = 16
#: ids, words of payload, CRC-32 of the ids, CRC-32 of the payload
ENTRY = struct.Struct("<IIII")


def _table(ids: np.ndarray) -> tuple[coder.Order0, bytes]:
    n = np.bincount(ids)
    if len(ids) < max(1, WORTH_A_TABLE * np.count_nonzero(n)):
        return coder.Order0(), b""
    o = coder.Order0.counted(n)
    return o, zlib.compress(np.concatenate([np.diff(o.ids, prepend=0), o.f]).astype("<u2").tobytes())


def _order0(table: bytes) -> coder.Order0:
    if not table:
        return coder.Order0()
    ids, f = np.frombuffer(zlib.decompress(table), "<u2").astype(np.int64).reshape(2, -1)
    return coder.Order0(np.cumsum(ids), f)


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, before: int = 0, null: np.ndarray | None = None) -> bytes:
    """A shard of documents whose ids stand one after the other; null says which document ids are."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    null = np.zeros(len(doc_ids), bool) if null is None else null
    order0, table = _table(ids.astype(np.uint16))
    index = doc_ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes() + table
    length = max(1, min(BLOCK, len(ids)))
    n = -(-len(ids) // length)
    filled = np.zeros(n * length, np.uint16)
    filled[: len(ids)] = ids
    if len(ids) and len(filled) > len(ids):
        filled[len(ids) :] = ids[-1]
    out = [HEADER.pack(MAGIC, length, len(doc_ids), len(table), len(ids), before, zlib.crc32(index)), index]
    plain = ids.astype("<u4")
    for k, words in enumerate(coder.encode(filled.reshape(n, length), order0) if n else []):
        own, data = plain[k * length : (k + 1) * length], words.astype("<u4").tobytes()
        out += [ENTRY.pack(len(own), len(words), zlib.crc32(own), zlib.crc32(data)), data]
    return b"".join(out)


def header(shard: bytes) -> tuple[int, int, int, int, int]:
    """(block length, documents, ids, ids before the shard in its partition, bytes of the table)."""
    magic, length, docs, table, ids, before, crc = HEADER.unpack_from(shard)
    if magic != MAGIC or zlib.crc32(memoryview(shard)[HEADER.size : HEADER.size + 13 * docs + table]) != crc:
        raise ValueError("damaged index")
    return length, docs, ids, before, table


def read_shard(shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids, which document ids are null) of a shard; ValueError if any part is damaged."""
    length, docs, total, _, table = header(shard)
    at = HEADER.size
    doc_ids, null = np.frombuffer(shard, "<i8", docs, at), np.frombuffer(shard, np.uint8, docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(shard, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs + table
    order0 = _order0(shard[at - table : at])
    payloads, checks = [], []
    while at < len(shard):
        n, words, crc, crc_data = ENTRY.unpack_from(shard, at)
        at += ENTRY.size
        data = shard[at : at + 4 * words]
        if zlib.crc32(data) != crc_data:
            raise ValueError(f"damaged block {len(payloads)}")
        at += 4 * words
        payloads.append(np.frombuffer(data, "<u4"))
        checks.append((n, crc))
    got = np.ascontiguousarray(coder.decode(payloads, length, order0), "<u4") if payloads else np.zeros((0, length), "<u4")
    for k, (n, crc) in enumerate(checks):
        if zlib.crc32(got[k, :n]) != crc:
            raise ValueError(f"block {k} does not decode to its ids")
    return doc_ids, lengths, got.reshape(-1)[:total], null


def write(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all documents and writes their shards below path."""
    tokenizer = tokenizer or public_path()
    n = partitions(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def shard():
            nonlocal seq, before, held
            doc_ids, null, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = shard_bytes(doc_ids, lengths, ids, before, null)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before + len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "until", "data"])
            seq, before, held = seq + 1, before + len(ids), []
            return row

        for whole in batches:
            for batch in text_blocks(whole, "text", 1 << 25):
                ids, offsets = encode(tokenizer, batch["text"], end_id)
                null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
                doc_ids, lengths = batch["doc_id"].fill_null(0).to_numpy().astype(np.int64), np.diff(offsets)
                a = 0
                while a < len(lengths):
                    room = SHARD - sum(len(x) for *_, x in held)
                    b = int(np.searchsorted(offsets, offsets[a] + room, side="right")) - 1
                    if b <= a and held:
                        yield shard()
                        continue
                    b = max(b, a + 1)
                    held.append((doc_ids[a:b], null[a:b], lengths[a:b], ids[offsets[a] : offsets[b]]))
                    a = b
        if held:
            yield shard()

    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumns({"_hash": F.xxhash64("text"), "_from": F.spark_partition_id()})
    d = d.repartitionByRange(n, "doc_id", "_hash", "_from").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
    d.mapInArrow(run, "part int, seq int, until long, data binary").write.option("compression", "none").parquet(path)


def load(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    stored = spark.read.parquet(path)
    totals = sorted(stored.groupBy("part").agg(F.max("until")).collect())  # one row per partition
    sums = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    offset = spark.sparkContext.broadcast({p: int(s) for (p, _), s in zip(totals, sums, strict=False)})

    def run(batches):
        import pyarrow as pa

        from idiomark.llm.common import blocks

        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"], strict=True):
                shard = data.as_py()
                doc_ids, lengths, ids, null = read_shard(shard)
                at = np.concatenate([[0], np.cumsum(lengths)])
                first = offset.value[part] + header(shard)[3]
                for a, b in blocks(lengths, 1 << 20):
                    bounds = ((at[a : b + 1] - at[a]) * 4).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=null[a:b]), pa.array(first + at[a:b]), pa.array(lengths[a:b]), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids[at[a] : at[b]])])], names=["doc_id", "start", "n_tokens", "ids"])

    return stored.select("part", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(read(spark, sf_dir, "documents"), path)
    return load(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
