"""Language identification with one bit-sliced Bloom filter over character n-grams.

Row i of the filter is a bit mask over languages, of several words if there are
more than 64. An n-gram sets its language's bit in `HASHES` rows; the conjunction of those rows gives every language that
contains the n-gram, in one look-up for all languages together. Over a text the
masks are counted per language, the share that chance alone would set is taken
off, and the largest count decides.

The filter is learned on the driver from a bounded sample of labelled rows, as many
of each language as it has, up to an equal share (`sample` rows with at most
`sample_chars` characters together, in seeded order). Prediction reads every whole
text, long ones in overlapping segments.

Defined cases: a null text, or one without a letter, is `und` with score 0; a
text whose n-grams are all unknown gets the most frequent learned language with
score 0; ties go to the language that sorts first; rows with a null language
or text teach nothing, equal rows teach once, and a null id may teach; without any
teaching row every text is `und`; repeated rows are predicted each; other columns
pass through untouched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm.common import blocks, trim

UND = "und"
ORDERS = (3, 4)
HASHES = 2
LOG_ROWS = 20
SEGMENT = 1 << 20
_letters: list[np.ndarray] = []
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, a blank before each and after the last; where each text begins."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate([[0], np.cumsum(sizes)])


def grams(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the n-grams whose inner characters are letters; other characters count as one blank."""
    if len(points) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = letters()[np.minimum(points, 0x10FFFF)]
    p = np.where(letter, points, 32).astype(np.uint64)
    n = len(p) - order + 1
    ok = letter[1 : n + 1].copy()
    for k in range(2, order - 1):
        ok &= letter[k : n + k]
    h = p[:n] * _ODD[0]
    for k in range(1, order):
        h = (h ^ (h >> np.uint64(29))) * _ODD[1] + p[k : n + k] * _ODD[(k + 1) % len(_ODD)]
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(ok)
    return (h[at] + np.uint64(order)) * _ODD[2], at


def slots(h: np.ndarray) -> list[np.ndarray]:
    out = []
    for _ in range(HASHES):
        out.append((h >> np.uint64(64 - LOG_ROWS)).astype(np.int64))
        h = (h ^ (h >> np.uint64(31))) * _ODD[3]
    return out


class Filter:
    """rows: the bit-sliced filter, one array for each word of masks; langs: the language of each bit; chance: each
    language's share of false answers."""

    def __init__(self, rows: np.ndarray, langs: list[str], prior: str):
        self.rows, self.langs, self.prior = rows, langs, prior
        self.chance = np.asarray([float(self.bits(rows[w], i).mean()) ** HASHES for w, i in map(self.place, range(len(langs)))])

    def place(self, lang: int) -> tuple[int, int]:
        """(word, bit) of a language."""
        return divmod(lang, np.iinfo(self.rows.dtype).bits)

    @staticmethod
    def bits(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> masks.dtype.type(i)) & masks.dtype.type(1)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams answered for each language, n-grams, letters) of each text."""
        n, k = len(texts), len(self.langs)
        hit, total, alpha = np.zeros((n, k), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        pieces, owner = [], []
        step = SEGMENT - max(ORDERS)
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), step):
                pieces.append(t[a : a + SEGMENT])
                owner.append(i)
        lengths = np.asarray([len(p) for p in pieces], np.int64)
        owner = np.asarray(owner, np.int64)
        for a, b in blocks(lengths, SEGMENT):
            points, starts = code_points(pieces[a:b])
            own = owner[a:b]
            seen = letters()[np.minimum(points, 0x10FFFF)]
            np.add.at(alpha, own, np.diff(np.concatenate([[0], np.cumsum(seen)])[starts]))
            for order in ORDERS:
                h, at = grams(points, order)
                cuts = np.searchsorted(at, starts)
                np.add.at(total, own, np.diff(cuts))
                where = slots(h)
                for w, row in enumerate(self.rows):
                    mask = row[where[0]]
                    for s in where[1:]:
                        mask &= row[s]
                    for lang in range(k):
                        if self.place(lang)[0] == w:
                            bit = np.concatenate([[0], np.cumsum(self.bits(mask, self.place(lang)[1]), dtype=np.int64)])
                            np.add.at(hit[:, lang], own, np.diff(bit[cuts]))
        return hit, total, alpha

    def corrected(self, hit: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Answered n-grams of each text and language, without what chance alone would answer."""
        return np.maximum(0.0, (hit - total[:, None] * self.chance) / (1 - self.chance))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is the chosen language's share of the corrected counts."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, cover) of each text; the cover is the chosen language's share of all the text's n-grams."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        hit, total, alpha = self.counts([t or "" for t in texts])
        real = self.corrected(hit, total)
        best, mass = real.argmax(1), real.sum(1)
        score = np.where(mass > 0, real.max(1) / np.maximum(mass, 1e-12), 0.0)
        out = []
        for i, t in enumerate(texts):
            if t is None or not alpha[i]:
                out.append(UND)
                score[i] = 0.0
            else:
                out.append(self.langs[best[i]] if mass[i] > 0 else self.prior)
        return out, np.clip(score, 0.0, 1.0), real.max(1) / np.maximum(total, 1)


def learn(rows: list[tuple[str, str]], least: int = 3, share: float = 0.25, prior: str | None = None) -> Filter:
    """Filter from (text, language) rows; `prior` is the most frequent language, by these rows unless it is given.

    An n-gram belongs to a language if it was seen there `least` times and at
    `share` of the rate of the language where it is most frequent, or more."""
    texts: dict[str, list[str]] = {}
    for text, lang in rows:
        texts.setdefault(lang, []).append(text)
    langs = sorted(texts)
    if not langs:
        return Filter(np.zeros((1, 1 << LOG_ROWS), np.uint8), [], UND)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(k).bits), np.uint64)
    width = np.iinfo(kind).bits
    table = np.zeros((-(-len(langs) // width), 1 << LOG_ROWS), kind)
    for order in ORDERS:
        found, counts, owner = [], [], []
        for i, lang in enumerate(langs):
            h, _ = grams(code_points(texts[lang])[0], order)
            u, c = np.unique(h, return_counts=True)
            found.append(u)
            counts.append(c / max(1, c.sum()))
            owner.append(np.where(c >= least, i, -1))
        h, rate, own = np.concatenate(found), np.concatenate(counts), np.concatenate(owner)
        u, inverse = np.unique(h, return_inverse=True)
        top = np.zeros(len(u))
        np.maximum.at(top, inverse, rate)
        take = (own >= 0) & (rate >= share * top[inverse])
        word, bit = np.divmod(own[take], width)
        for s in slots(h[take]):
            np.bitwise_or.at(table, (word, s), (np.ones(len(bit), kind) << bit.astype(kind)).astype(kind))
    return Filter(table, langs, prior or max(langs, key=lambda x: (len(texts[x]), x)))


def least_cover(rows: list[tuple[str, str]]) -> float:
    """The cover below which a text is in none of the languages of (text, language) rows.

    Every other row teaches, the rest are looked up: their best language's cover is that of clean texts, their second
    best's that of texts in a language not learned. The floor is a third of the way from the middle of the second to the
    low end (the 5 % quantile) of the first: rather a strange text stays than a clean one goes."""
    model, texts = learn(rows[::2]), [t for t, _ in rows[1::2]]
    best, second = [np.zeros(0)], [np.zeros(0)]
    for a in range(0, len(texts) if model.langs else 0, 512):
        hit, total, _ = model.counts(texts[a : a + 512])
        cover = np.sort(model.corrected(hit, total)[total > 0] / total[total > 0, None], axis=1)
        best.append(cover[:, -1])
        second.append(cover[:, -2] if len(model.langs) > 1 else np.zeros(len(cover)))
    clean, strange = np.concatenate(best), np.concatenate(second)
    return float((np.quantile(clean, 0.05) + 2 * np.median(strange)) / 3) if len(clean) else 0.0


def taught(id_col: str = "doc_id"):
    """Rows whose label may be learned: crc32 of the id's text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(True))


class Lessons(NamedTuple):
    """(text, language) rows to learn from, in seeded order, and the language that most rows have."""

    rows: list[tuple[str, str]]
    prior: str | None


def fit(df: DataFrame, sample: int = 4000, sample_chars: int = 12_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Learns from the rows that `lessons` draws."""
    drawn = lessons(df, sample, sample_chars, seed, id_col, text_col, lang_col)
    return learn(drawn.rows, prior=drawn.prior)


def lessons(df: DataFrame, sample: int = 4000, sample_chars: int = 12_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Lessons:
    """`sample` labelled rows at most, with `sample_chars` characters at most; both in equal shares for each language.

    Languages are counted first: one row of each reaches the driver, and if there are more than `sample`, the most
    frequent ones are learned. Of each about twice its share is then listed by a hash of id and text, without its text;
    what fits is chosen from the list, and only the chosen texts travel. Rows longer than sample_chars / 100 are not
    sampled; they are predicted like any other."""
    spark = df.sparkSession
    named = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter(taught("i") & F.col("l").isNotNull())
    counted = named.groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample).collect()
    if not counted:
        return Lessons([], None)
    share, chars = max(1, sample // len(counted)), sample_chars // len(counted)
    part = spark.createDataFrame([(r["l"], min(1.0, 2.0 * share / r["count"])) for r in counted], "_l string, _part double")
    u = F.xxhash64(F.lit(seed), "i", "t")
    able = named.filter(F.col("t").isNotNull() & (F.length("t") <= sample_chars // 100)).withColumn("u", u)
    listed = able.join(F.broadcast(part), F.col("l") == F.col("_l")).filter(F.col("u").cast("double") / 2.0**64 + 0.5 <= F.col("_part"))
    listed = listed.select("l", "u", F.length("t").alias("n")).distinct().orderBy("u", "l").limit(4 * sample).collect()
    taken, held, chosen = dict.fromkeys((r["l"] for r in counted), 0), dict.fromkeys((r["l"] for r in counted), 0), []
    for r in listed:
        if taken[r["l"]] < share and held[r["l"]] + r["n"] <= chars:
            taken[r["l"]] += 1
            held[r["l"]] += r["n"]
            chosen.append((r["u"], r["l"]))
    if not chosen:
        return Lessons([], None)
    ids = F.broadcast(spark.createDataFrame(chosen, "_u long, _l string"))
    got = able.join(ids, (F.col("u") == F.col("_u")) & (F.col("l") == F.col("_l"))).groupBy("u", "l").agg(F.min("t").alias("t")).collect()
    return Lessons([(r["t"], r["l"]) for r in sorted(got, key=lambda r: (r["u"], r["l"]))], counted[0]["l"])


def identify(df: DataFrame, model: Filter, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", cover_name: str | None = None) -> DataFrame:
    """df with the predicted language and its score, and its cover if that is named."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<l string, s double, c double>")
    def predict(texts):
        import pyarrow as pa

        lang, score, cover = [], [], []
        for a in range(0, len(texts), 512):
            x, y, z = shared.value.judged(texts.slice(a, 512).to_pylist())
            lang += x
            score.append(y)
            cover.append(z)
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), *(pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64()) for v in (score, cover))], ["l", "s", "c"])

    names = [F.col(f"`{c}`") for c in df.columns if c not in (lang_name, score_name, cover_name)]
    return df.select(*names, predict(F.col(text_col).cast("string")).alias("_p")).select(*names, F.col("_p.l").alias(lang_name), F.col("_p.s").alias(score_name), *([F.col("_p.c").alias(cover_name)] if cover_name else []))


def query(spark, sf_dir: str) -> DataFrame:
    from idiomark.llm.common import read

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
