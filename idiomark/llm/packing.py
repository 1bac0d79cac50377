"""Concatenate and cut: fixed windows over the concatenated ids of all documents.

Pass 1 encodes each partition and keeps its ids, each document's start within
its partition, and the partition's total. The totals, one number per partition,
become offsets on the driver. Pass 2 cuts each document where the global
position crosses a multiple of the window; no id is shuffled. A document over a
boundary leaves one piece per window, so only the last window of all is short.

Order of the concatenation: partition, then row. Defined cases: a null or empty
text is its end id alone; null ids are kept; repeated rows are packed once each; an
empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm.common import kept, trimmed
from idiomark.llm.tokens import encode, public_path, text_blocks

ENCODED = "doc_id long, part int, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (little-endian, 16 bits where all ids fit) and where they start in their partition."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from idiomark.llm.tokens import tokenizer

        part, at = TaskContext.get().partitionId(), 0
        kind = "<u2" if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for whole in trimmed(batches):
            for batch in text_blocks(whole, "text", 1 << 21):
                ids, offsets = encode(path, batch["text"], end_id)
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                width = np.dtype(kind).itemsize
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(offsets[:-1] + at),
                        pa.array(np.diff(offsets)),
                        pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), raw]).cast(pa.binary()),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def pack(df: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, with their ids as little-endian unsigned 32-bit integers."""
    spark = df.sparkSession
    path = path or public_path()
    done = kept(encoded(df, path, end_id, id_col, text_col))
    totals = sorted(done.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row per partition
    sums = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    offset = spark.sparkContext.broadcast({p: int(s) for (p, _), s in zip(totals, sums, strict=False)})

    def cut(batches):
        import pyarrow as pa

        for whole in trimmed(batches):
            starts = whole["local_start"].to_numpy() + np.asarray([offset.value[p] for p in whole["part"].to_pylist()], np.int64)
            tokens = whole["n_tokens"].to_numpy()
            first, last = starts // window, (starts + tokens - 1) // window
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(starts[row], seq * window)
            length = np.minimum(starts[row] + tokens[row], (seq + 1) * window) - begin
            from idiomark.llm.common import blocks, byte_view

            raw, bounds = byte_view(whole["ids"])
            width = int(len(raw) // max(1, tokens.sum()))
            flat = raw.view(f"<u{width}") if len(raw) else np.zeros(0, "<u2")
            at = np.concatenate([[0], np.cumsum(length)])
            for a, b in blocks(length, 1 << 20):
                part = flat[at[a] : at[b]].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        whole["doc_id"].take(pa.array(row[a:b])),
                        pa.array(begin[a:b] - starts[row[a:b]]),
                        pa.array(length[a:b]),
                        pa.array(tokens[row[a:b]]),
                        pa.array(seq[a:b]),
                        pa.array(begin[a:b] - seq[a:b] * window),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((at[a : b + 1] - at[a]) * 4).astype(np.int32).tobytes()), pa.py_buffer(part)]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return done.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row per window: its ids padded to the window, and how many of them are not padding.

    A window holds at most `window` pieces, as every document has an end id."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    @F.arrow_udf("binary")
    def joined(parts):
        import pyarrow as pa

        out = []
        for row in parts.to_pylist():
            got = b"".join(x["ids"] for x in row)
            out.append(got + np.full(window - len(got) // 4, pad_id, "<u4").tobytes())
        return pa.array(out, pa.binary())

    return whole.select("sequence_id", "n_tokens", joined("p").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    from idiomark.llm.common import read, small_batches

    small_batches(spark)
    p = pack(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
