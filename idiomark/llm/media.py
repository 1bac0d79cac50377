"""Interleaved sequences of text and media from HTML, with payloads resolved by digest.

`sequences` parses pages into ordered items: text, or a media reference with its
caption. A reference names its payload by digest. `store` keeps payloads
losslessly as 8-bit samples (a greyscale image 64 samples wide), `resolve` joins
items to stored payloads by digest; position and caption stay with their item.

Payloads are written once per Arrow batch and digest and never shuffled: what is
computed from them is reduced to one row per digest and joined to the references.
A digest that a third of all rows refer to is one row on that side of the join,
and the references to it are spread by a salt.

Defined cases: a null or empty text is 64 zero samples; null ids are kept; null HTML gives no item;
an unknown digest leaves its item with null features; a caption without media is
text; unclosed tags end with the page; repeated rows are kept; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm.common import kept, read, salted_join, scratch, trimmed

WIDTH = 64
ITEM = "struct<kind string, text string, src string, caption string>"
#: Tags whose content is not shown, tags that refer to media, tags that end a run of text.
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img", "video", "audio", "source", "embed"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "mark", "q", "abbr", "cite"}
VOID = {"br", "hr", "meta", "link", "input", "wbr"}


class _Items(HTMLParser):
    """Text runs and media references in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._hidden = 0
        self._figures: list[list[dict]] = []
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        if tag not in INLINE and self._caption is None:
            self._flush()
        a = dict(attrs)
        if tag in MEDIA and a.get("src"):
            item = {"kind": "media", "text": None, "src": a["src"], "caption": a.get("alt") or None}
            self.items.append(item)
            if self._figures:
                self._figures[-1].append(item)
        elif tag == "figure":
            self._figures.append([])
        elif tag == "figcaption":
            self._caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self._hidden -= 1

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "figcaption" and self._caption is not None:
            text, self._caption = " ".join("".join(self._caption).split()), None
            if self._figures and self._figures[-1]:
                for item in self._figures[-1]:
                    item["caption"] = text or item["caption"]
            elif text:
                self._text.append(text)
                self._flush()
        elif tag == "figure":
            self._flush()
            if self._figures:
                self._figures.pop()
        elif tag not in INLINE and self._caption is None:
            self._flush()

    def handle_data(self, data):
        if self._hidden:
            return
        (self._text if self._caption is None else self._caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        if self._caption is not None:
            self.handle_endtag("figcaption")
        self._flush()
        return self.items


def parse(page: str | None) -> list[dict]:
    """Items of one page."""
    if page is None:
        return []
    p = _Items()
    p.feed(page)
    return p.done()


def sequences(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per item: id_col, position (from 0), kind, text, src, caption."""

    @F.arrow_udf(f"array<{ITEM}>")
    def items(pages):
        import pyarrow as pa

        fields = pa.struct([pa.field(n, pa.string()) for n in ("kind", "text", "src", "caption")])
        return pa.array([parse(x) for x in pages.to_pylist()], pa.list_(fields))

    d = df.select(F.col(id_col), F.posexplode(items(F.col(html_col).cast("string"))).alias("position", "_item"))
    return d.select(id_col, "position", *[F.col(f"_item.{n}").alias(n) for n in ("kind", "text", "src", "caption")])


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def media(data: bytes) -> bytes:
    """The payload as a binary greyscale image, 8 bits a sample."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


def samples(stored: bytes) -> bytes:
    """The payload of a stored image; ValueError if it is damaged."""
    m = _HEADER.match(stored)
    if not m or len(stored) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a whole 8-bit greyscale image")
    return stored[m.end() :]


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def feature(data: bytes) -> str:
    """Size, range, mean and spread of the samples, and how alike neighbouring rows are."""
    x = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    step = 1 << 14
    n = x.size
    s1 = sum(int(x[a : a + step].sum(dtype=np.int64)) for a in range(0, len(x), step))
    s2 = sum(int((x[a : a + step].astype(np.int64) ** 2).sum()) for a in range(0, len(x), step))
    same = sum(int((x[a + 1 : a + step + 1] == x[a : a + step][: len(x[a + 1 : a + step + 1])]).sum()) for a in range(0, len(x), step))
    mean = s1 / n
    return f"{WIDTH}x{len(x)} min={x.min()} max={x.max()} mean={mean:.4f} std={max(0.0, s2 / n - mean * mean) ** 0.5:.4f} same={same}"


def write_store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each document's page and the payload it refers to: (doc_id, n_bytes, page, digest, media).

    media is null where the same batch has written that digest already."""
    schema = "doc_id long, n_bytes long, page string, digest string, media binary"

    def run(batches):
        import pyarrow as pa

        from idiomark.llm.tokens import text_blocks

        for whole in trimmed(batches):
            for batch in text_blocks(whole, "text"):
                seen, out = set(), []
                for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    data = payload(t)
                    d = digest(data)
                    n = len((t or "").encode("utf-8", "surrogatepass"))
                    page = f'<article><p>Document {i}</p><figure><img src="sha256:{d}" alt="samples"><figcaption>{html.escape(str(n))} bytes of document {i}</figcaption></figure></article>'
                    out.append((i, n, page, d, None if d in seen else media(data)))
                    seen.add(d)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "page", "digest", "media"])

    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    d.write.option("compression", "zstd").parquet(path)


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in trimmed(batches):
            out = []
            for d, m in zip(batch["digest"].to_pylist(), batch["media"], strict=True):
                m = m.as_py()
                data = samples(m)
                out.append((d, len(data), digest(data), zlib.crc32(data[-WIDTH:]), len(m), digest(m), feature(data)))
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    found = stored.filter(F.col("media").isNotNull()).select("digest", "media").mapInArrow(run, FEATURES)
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


def resolve(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with the features of what they refer to; unknown digests keep nulls."""
    ref = F.when(F.col("src").startswith("sha256:"), F.substring("src", 8, 64))
    return salted_join(kept(items.withColumn("_digest", ref)), "_digest", found.withColumnRenamed("digest", "_found"), "_found").drop("_digest", "_found")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    write_store(read(spark, sf_dir, "documents"), path)
    stored = spark.read.parquet(path)
    items = sequences(stored.select("doc_id", "n_bytes", "page").select(F.struct("doc_id", "n_bytes").alias("d"), "page"), "d", "page")
    shown = items.filter(F.col("kind") == "media").select(F.col("d.doc_id").alias("doc_id"), "position", F.col("d.n_bytes").alias("n_bytes"), "src", "caption")
    r = resolve(shown, features(stored))
    return r.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")
