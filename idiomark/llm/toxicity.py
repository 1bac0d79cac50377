"""Toxicity of whole texts by a bidirectional recurrent network over words and their characters.

A text is its runs of letters, lower-cased. Words longer than `CODES` letters
become overlapping pieces, so no letter is left out. Windows of `WINDOW` words
start every `STRIDE` words and cover the whole text; its score is that of its
highest window. Each distinct word of an Arrow batch goes through the character
level once.

Learning uses a bounded sample of labelled rows on the driver (`per_class` rows
of each label, texts up to `chars` characters). Labels belong to documents and
toxic words to a few windows, so windows are labelled first: words, and their
first and last letters, that are far more frequent in toxic documents mark the
windows of toxic documents that the network learns as positive. Where no mark
tells, the highest window of each toxic document is the positive one, chosen anew
as the network learns. It then learns again from the clean windows it scores
highest. Last, the logit at which
documents of the sample part best is moved to a score of 0.3.

Defined cases: null, empty and letterless texts score 0; without texts of both
labels every text scores 0; documents without a label, and null labels, teach
nothing; of several texts with one id one teaches, the first by hash; repeated rows
are scored each; an empty table gives no row; other
columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm.common import blocks, read, trim
from idiomark.llm.gru import CHARS, WORDS, Adam, Network
from idiomark.llm.langid import taught

CODES, OVERLAP, WINDOW, STRIDE = 20, 8, 32, 16
THRESHOLD = 0.3


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of a long one."""
    if len(word) <= CODES:
        return [word]
    step = CODES - OVERLAP
    return [word[a : a + CODES] for a in range(0, len(word) - OVERLAP, step)]


def words_of(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word, offsets of each text) of an Arrow string array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    lists = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(t, r"[^\p{L}]+", " "), " "), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    words = flat.dictionary.to_pylist()
    # An empty text has one empty word; long words become pieces.
    count = np.asarray([0 if not w else len(pieces(w)) for w in words], np.int64)
    if (count != 1).any():
        parts = [p for w in words if w for p in pieces(w)]
        start = np.cumsum(count) - count
        n = count[index]
        row = np.repeat(np.arange(len(index)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        offsets = np.concatenate([[0], np.cumsum(n)])[offsets]
        index, words = start[index[row]] + inner, parts
    return words, index, offsets


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(character codes, buckets) of words of at most CODES letters."""
    if not words:
        return np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)
    points = np.frombuffer("".join(w.ljust(CODES, "\0")[:CODES] for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, CODES).astype(np.int64)
    latin = (points >= 97) & (points <= 122)
    other = 27 + (points * 2654435761 >> 7) % (CHARS - 27)
    codes = np.where(latin, points - 96, np.where(points == 0, 0, other)).astype(np.uint8)
    return codes, np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words), np.int64, len(words))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of all windows, -1 pads; offsets of each text's windows)."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + inner * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < offsets[text + 1][:, None], at, -1), np.concatenate([[0], np.cumsum(count)])


class Scorer:
    """A learned network and the logit that a score of 0.3 stands for; without a network every score is 0."""

    def __init__(self, network: Network | None = None, edge: float = 0.0):
        self.network, self.edge = network, edge

    def logits(self, texts) -> np.ndarray:
        """Highest window logit of each text of an Arrow array; -inf where there is no word."""
        out = np.full(len(texts), -np.inf)
        if self.network is None:
            return out
        words, index, offsets = words_of(texts)
        if not len(index):
            return out
        projected = self.network.projected(*coded(words))
        for a, b in blocks(np.diff(offsets), 1 << 19):
            own = offsets[a : b + 1]
            at, cuts = windows(own - own[0])
            if not len(at):
                continue
            logit = np.empty(len(at), np.float32)
            for x in range(0, len(at), 4096):
                part = at[x : x + 4096]
                logit[x : x + 4096] = self.network.logits(projected, np.where(part >= 0, index[own[0] + part], -1))
            some = np.flatnonzero(np.diff(cuts) > 0)
            out[a + some] = np.maximum.reduceat(logit, cuts[:-1][some])
        return out

    def scores(self, texts) -> np.ndarray:
        x = self.logits(texts) - self.edge + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -700, 60))) * np.isfinite(x)


def marks(word: str) -> set[str]:
    """What a word can be known by: itself, its first letters, its last ones."""
    return {word, "^" + word[:4], "^" + word[:5], word[-4:] + "$"}


def telling(words: list[str], index: np.ndarray, offsets: np.ndarray, y: np.ndarray, least: int, lift: float = 20.0) -> set[str]:
    """Marks that are `lift` times as frequent in toxic texts as in clean ones, with `least` places in those.

    Places between the same two words count once, so copies of a text prove nothing twice."""
    own = np.repeat(y.astype(np.int64), np.diff(offsets))
    before, after = np.concatenate([[-1], index[:-1]]), np.concatenate([index[1:], [-1]])
    full = np.diff(offsets) > 0
    before[offsets[:-1][full]] = after[offsets[1:][full] - 1] = -1
    places = np.unique(np.stack([own, index, before, after], 1), axis=0)
    per_word = np.zeros((len(words), 2), np.int64)
    np.add.at(per_word, (places[:, 1], places[:, 0]), 1)
    total = np.maximum(1, per_word.sum(0))
    counts: dict[str, np.ndarray] = {}
    for w, c in zip(words, per_word, strict=True):
        for m in marks(w):
            counts[m] = counts[m] + c if m in counts else c
    return {m for m, (n, p) in counts.items() if p >= least and (p + 0.5) / total[1] >= lift * (n + 0.5) / total[0]}


def learn(texts: list[str], labels: list[int], steps: int = 500, batch: int = 96, seed: int = 11) -> Scorer:
    """Scorer from texts and 0/1 labels."""
    import pyarrow as pa

    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Scorer()
    rng = np.random.default_rng(seed)
    words, index, offsets = words_of(pa.array(texts, pa.string()))
    codes, buckets = coded(words)
    at, cuts = windows(offsets)
    own = np.repeat(np.arange(len(texts)), np.diff(cuts))
    told = telling(words, index, offsets, y, least=4 + int(0.007 * y.sum()))
    known = np.asarray([bool(marks(w) & told) for w in words])
    content = np.where(at >= 0, index[at], -1)
    shows = (known[content] & (at >= 0)).any(1)
    pos = np.flatnonzero(shows & (y[own] == 1))
    neg = np.flatnonzero(y[own] == 0)
    quiet = np.flatnonzero(~shows & (y[own] == 1))
    every = np.flatnonzero(y[own] == 1)
    if not len(every) or not len(neg):
        return Scorer()
    told_nothing = not len(pos)
    if told_nothing:
        pos, quiet = every, quiet[:0]
    net = Network(seed)
    adam = Adam(net.p, 0.01)
    hard = neg
    for step in range(steps):
        if step in (steps // 2, steps * 3 // 4):
            some = rng.choice(neg, min(len(neg), 6000), replace=False)
            logit = net.logits(net.projected(codes, buckets), content[some])
            hard = some[np.argsort(-logit, kind="stable")[: max(batch, len(some) // 10)]]
        if told_nothing and step % 50 == 49:
            logit = net.logits(net.projected(codes, buckets), content[every])
            order = np.lexsort((-logit, own[every]))
            pos = every[order][np.unique(own[every][order], return_index=True)[1]]
        third = batch // 3
        pick = np.concatenate([rng.choice(pos, third), rng.choice(neg, third // 2), rng.choice(hard, third - third // 2), rng.choice(quiet if len(quiet) else neg, batch - 2 * third)])
        target = np.concatenate([np.ones(third, np.float32), np.zeros(batch - third, np.float32)])
        weight = np.concatenate([np.ones(2 * third, np.float32), np.full(batch - 2 * third, 0.5, np.float32)])
        part = content[pick]
        used, inverse = np.unique(part, return_inverse=True)
        inverse = inverse.reshape(part.shape)
        if used[0] == -1:
            used, inverse = used[1:], inverse - 1
        _, g = net.gradients(codes[used], buckets[used], inverse, target, weight)
        adam.step(g, 0.01 * min(1.0, 2.0 * (1 - step / steps)) + 1e-4)
    scorer = Scorer(net)
    scorer.edge = parting(scorer.logits(pa.array(texts, pa.string())), y)
    return scorer


def parting(logit: np.ndarray, y: np.ndarray) -> float:
    """Where predicting 1 above it gives the highest F1; the middle of the gap there."""
    order = np.argsort(-logit, kind="stable")
    x, hit = logit[order], np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ok = np.isfinite(x)
    if not ok.any():
        return 0.0
    last = int(np.flatnonzero(ok & (np.concatenate([x[1:], [-np.inf]]) < x))[np.argmax(f[ok & (np.concatenate([x[1:], [-np.inf]]) < x)])])
    below = x[last + 1] if last + 1 < len(x) and np.isfinite(x[last + 1]) else x[last] - 2.0
    return float((x[last] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, chars: int = 20_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learns from at most per_class rows of each label, the first in seeded order; their ids are a bounded list."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).filter(taught("_i") & F.col("_y").isin(0, 1)).distinct()
    u = F.xxhash64(F.lit(seed), F.col("_i").cast("string"))
    drawn = [r for y in (0, 1) for r in known.filter(F.col("_y") == y).orderBy(u, "_i").limit(per_class).collect()]
    if not drawn:
        return Scorer()
    some = F.broadcast(spark.createDataFrame(drawn, known.schema))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).filter(F.length("_t") <= chars).join(some, F.col("_d") == F.col("_i"))
    got = rows.groupBy("_i", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).collect()  # one text of an id
    got = sorted((r["_i"], r["_t"], r["_y"]) for r in got if r["_t"])
    return learn([t for _, t, _ in got], [y for _, _, y in got])


def scored(df: DataFrame, model: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the score of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts):
        import pyarrow as pa

        from idiomark.llm.tokens import text_blocks

        parts = [shared.value.scores(b["t"]) for b in text_blocks(pa.RecordBatch.from_arrays([texts], names=["t"]), "t", 1 << 22)]
        trim()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], score(F.col(text_col).cast("string")).alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
