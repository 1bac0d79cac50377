"""Join of documents on the Jaccard similarity of their word shingles, and its connected groups.

A document's set is its distinct five-word shingles, as 64-bit hashes; documents
with equal sets are one item. Two items link when their similarity is 0.75 or
more. The join is size-aware:

* Light items, with sets up to a boundary, enumerate subsets of fixed size. Two
  sets of sizes a and b link exactly if they share o(a, b) shingles, the least
  overlap that 0.75 allows, so they link if and only if they meet in one subset
  of that size, under the key (a, b, subset).
* Heavy items scan inverted lists. An item stands in the lists of its rarest
  shingles, so many that every partner must stand in one of them (prefix
  filter). Frequent shingles, estimated from all documents, come last in the
  order; the estimate shifts work, not results.

The boundary is where enumeration stops being cheaper than scanning, by the
histogram of set sizes and the mean length of a list.

A list of a few items gives its pairs. In a longer one, as a group of near
copies makes them, every item meets the list's first items and its neighbours
only. When these pairs are verified and connected, each item of a list is paired
with the nearest one of another component first; then
the items that still lie in different components are paired in full, in blocks.
So few pairs inside a component are made, and none across is left out. All
pairs are verified: first on parity bit maps, which bound the sets' difference
from below, then on whole sets.

Hashes of 64 bits stand for shingles and items: two of n differ in text but not
in hash with a chance below n * n / 2**65.

Defined cases: a null or blank text has no shingle and is a component of its
own; null ids take part, and a component that has no other id has none; a text of fewer words than five has its whole sequence as the one shingle;
repeated rows and ids are kept, a component is the smallest id in it; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import ceil, comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idiomark.llm.common import _BLANK, blocks, byte_view, kept, read, salted_join, trimmed

WORDS = 5
#: Similarity as a fraction, 3 / 4.
NUM, DEN = 3, 4
#: Sets that may be enumerated, pairs of a list that are all made, postings of a bucket.
LARGEST_LIGHT, SHORT_LIST, BUCKET = 24, 12, 1_000_000
HOT_PER_BATCH, HOT_KEPT, HOT_LEAST = 20_000, 50_000, 3
#: Rows of a block of a long list: at least these, and so many by the root of its length.
LIST_BLOCK, SPREAD = 600, 12
#: Rounds of nearest pairs before the rest is paired in full.
ROUNDS = 1
#: So many edges, 16 bytes each, are labelled within one task.
SMALL_EDGES = 1_000_000
POSTING = np.dtype([("h", "<u8"), ("item", "<i8"), ("n", "<i4"), ("kind", "u1")])
#: Fewest buckets of postings; few large ones compress better than many small ones.
LEAST_BUCKETS = 12
#: An entry as it travels: 48 bits of the hash are enough to bring candidates together.
PACKED = np.dtype([("h", "u1", 6), ("item", "<i8"), ("n", "<i4"), ("kind", "u1")])
#: Kinds of entries: of a list, of a subset's sides, of a list whose items are dealt to several buckets.
SCAN, LEFT, RIGHT, SAME, DEALT = 0, 1, 2, 3, 4
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow array."""
    import pyarrow as pa

    raw, offsets = byte_view(texts.cast(pa.large_string()).fill_null(""))
    out: list[np.ndarray] = []
    for a, b in blocks(np.diff(offsets), 1 << 20):
        out += _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
    return out


def _sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    empty = np.zeros(0, np.uint64)
    if not len(raw):
        return [empty] * (len(offsets) - 1)
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    if not len(start):
        return [empty] * (len(offsets) - 1)
    # A word's hash: its bytes times powers of an odd number, from the word's start.
    at = np.flatnonzero(inside)
    word_of = np.cumsum(first)[at] - 1
    inner = at - start[word_of]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(inner.max()), _M[0], np.uint64))]) if inner.max() else np.ones(1, np.uint64)
    value = (_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * powers[inner]
    length = np.bincount(word_of, minlength=len(start)).astype(np.uint64)
    word = mixed(np.add.reduceat(value, np.flatnonzero(np.concatenate([[True], word_of[1:] != word_of[:-1]]))) + length * _M[3])
    cuts = np.searchsorted(start, offsets)
    n = len(word) - words + 1
    if n > 0:
        h = word[:n] * _M[0]
        for k in range(1, words):
            h = (h ^ (h >> np.uint64(29))) * _M[1] + word[k : n + k] * _M[2 + k % 5]
        h = mixed(h)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= words:
            s = np.sort(h[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = hashlib.blake2b(word[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            out.append(np.frombuffer(whole, "<u8").copy())
        else:
            out.append(empty)
    return out


def parity(s: np.ndarray) -> bytes:
    """For each of some bits, whether an odd number of shingles falls on it.

    There are one to two bits per shingle; two to four in sets of less than 256, where the bound is noisier."""
    bits = 1 << max(6, min(20, int(len(s)).bit_length() + (len(s) < 256)))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """Of two parities, a lower bound of how many shingles only one of the sets has; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def item_of(s: np.ndarray) -> int:
    """Identity of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def overlap(a: int, b: int) -> int:
    """The least number of shared shingles with which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def partners(a: int) -> range:
    """Sizes that a set of this size can link with."""
    return range(-(-NUM * a // DEN), DEN * a // NUM + 1)


def prefix(n):
    """So many of its first shingles, in any fixed order, a set shares at least one of with every partner."""
    return n - (n * NUM + DEN - 1) // DEN + 1


def boundary(sizes: dict[int, int], list_length: float, verify: float = 8.0) -> int:
    """The largest set size that is enumerated: up to it, subsets cost no more than lists and the checks that follow."""
    best, light, heavy = 0, 0.0, 0.0
    for a in range(1, LARGEST_LIGHT + 1):
        n = sizes.get(a, 0)
        light += n * sum(comb(a, overlap(a, b)) for b in partners(a))
        heavy += n * prefix(a) * (1 + verify * max(0.05, list_length))
        if light <= heavy:
            best = a
    return best


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, item, parity) and, on the first row of a block, its frequent shingles and how often shingles repeat."""

    def run(batches):
        import pyarrow as pa

        from idiomark.llm.tokens import text_blocks

        hot_type = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))
        for whole in trimmed(batches):
            for batch in text_blocks(whole, "text"):
                sets = shingle_sets(batch["text"])
                items = [item_of(s) for s in sets]
                distinct = {i: s for i, s in zip(items, sets, strict=True)}
                every = np.sort(np.concatenate(list(distinct.values()) or [np.zeros(0, np.uint64)]))
                cut = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
                count = np.diff(np.concatenate([cut, [len(every)]]))
                top = np.flatnonzero(count >= HOT_LEAST)
                top = top[np.argsort(-count[top], kind="stable")[:HOT_PER_BATCH]]
                hot = [{"h": int(h), "c": int(c)} for h, c in zip(every[cut[top]].view(np.int64), count[top], strict=True)]
                rest = len(sets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(items, pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([hot] + [None] * rest, hot_type), pa.array([len(every)] + [0] * rest, pa.int64()), pa.array([len(cut)] + [0] * rest, pa.int64())],
                    names=["doc_id", "key", "n", "item", "parity", "hot", "shingles", "different"],
                )

    return docs.mapInArrow(run, "doc_id long, key long, n long, item long, parity binary, hot array<struct<h:long,c:long>>, shingles long, different long")


class Order:
    """Shingles by estimated frequency, then by hash; the ones that are not known to be frequent come first."""

    def __init__(self, hot: list[tuple[int, int]]):
        h = np.asarray([x for x, _ in hot], np.int64).view(np.uint64)
        c = np.asarray([x for _, x in hot], np.int64)
        at = np.argsort(h)
        self.h, self.c = h[at], c[at]

    def counts(self, s: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.h, s), len(self.h) - 1)
        return np.where(self.h[at] == s, self.c[at], 0)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        c = self.counts(s)
        p = prefix(len(s))
        if not c.any():
            return s[:p]
        return s[np.argsort(c, kind="stable")[:p]]


def light_keys(s: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(key, kind) of the subsets of a light set, for each size of partner."""
    out, n = [], len(s)
    for b in partners(n):
        if not 0 < b <= limit:
            continue
        size = overlap(n, b)
        if size > n:
            continue
        subsets = np.asarray(list(combinations(range(n), size)))
        tag = np.uint64((min(n, b) * 64 + max(n, b)) * int(_M[5]) % 2**64)
        key = mixed(np.bitwise_xor.reduce(mixed(s[subsets] + tag), axis=1) + np.add.reduce(mixed(s[subsets] ^ _M[6]), axis=1))
        kind = SAME if b == n else LEFT if n < b else RIGHT
        out += [(int(k), kind) for k in key]
    return out


def packed(e: np.ndarray) -> bytes:
    out = np.empty(len(e), PACKED)
    out["h"] = np.ascontiguousarray(e["h"]).view(np.uint8).reshape(-1, 8)[:, :6]
    for name in ("item", "n", "kind"):
        out[name] = e[name]
    return out.tobytes()


def unpacked(data) -> np.ndarray:
    p = np.frombuffer(data, PACKED)
    e, h = np.empty(len(p), POSTING), np.zeros((len(p), 8), np.uint8)
    h[:, :6] = p["h"]
    e["h"] = h.view("<u8")[:, 0]
    for name in ("item", "n", "kind"):
        e[name] = p[name]
    return e


def postings(docs: DataFrame, order, limit: int, buckets: int) -> DataFrame:
    """(bucket, data): entries of lists, as packed arrays."""

    def run(batches):
        import pyarrow as pa

        from idiomark.llm.tokens import text_blocks

        from_light = -(-NUM * (limit + 1) // DEN)  # light sets that a heavy one can link with stand in lists, too
        for whole in trimmed(batches):
            for batch in text_blocks(whole, "text"):
                seen, rows = set(), []
                for s in shingle_sets(batch["text"]):
                    n = len(s)
                    item = item_of(s) if n else 0
                    if not n or item in seen:
                        continue
                    seen.add(item)
                    if n <= limit and (keys := light_keys(s, limit)):
                        e = np.zeros(len(keys), POSTING)
                        e["h"], e["kind"] = [k for k, _ in keys], [k for _, k in keys]
                        e["item"], e["n"] = item, n
                        rows.append(e)
                    if n > limit or n >= from_light:
                        h = order.value.prefix(s)
                        e = np.zeros(len(h), POSTING)
                        e["h"], e["item"], e["n"] = h, item, n
                        rows.append(e)
                if not rows:
                    continue
                every = np.concatenate(rows)
                where = (mixed(every["h"] ^ _M[4]) >> np.uint64(33)) % np.uint64(buckets)
                # What one task cannot hold of a frequent shingle is dealt to several buckets by item.
                many = (order.value.counts(every["h"]) * 4 > BUCKET) & (every["kind"] == SCAN)
                if many.any():
                    every["kind"][many] = DEALT
                    where[many] = (where[many] + mixed(every["item"][many].view(np.uint64)) % np.uint64(64)) % np.uint64(buckets)
                at = np.argsort(where, kind="stable")
                every, where = every[at], where[at]
                cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                ends = np.concatenate([cut[1:], [len(every)]])
                yield pa.RecordBatch.from_arrays([pa.array(where[cut].astype(np.int64)), pa.array([packed(every[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["bucket", "data"])

    return docs.mapInArrow(run, "bucket long, data binary")


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


def pairs_of(e: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """From the entries of a bucket: (candidate pairs (k, 2) of items, entries of long lists).

    A bucket holds a part only of a list that is dealt; whatever the part's size, it counts as long."""
    e = e[np.lexsort((e["item"], e["n"], e["kind"], e["h"]))]
    if len(e) > 1:
        again = (e["h"][1:] == e["h"][:-1]) & (e["item"][1:] == e["item"][:-1]) & (e["kind"][1:] == e["kind"][:-1])
        e = e[np.concatenate([[True], ~again])]
    out = [np.zeros((0, 2), np.int64)]
    subset = (e["kind"] != SCAN) & (e["kind"] != DEALT)
    light, e = e[subset], e[~subset]

    def groups(x):
        cut = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]])) if len(x) else np.zeros(0, np.int64)
        return cut, np.diff(np.concatenate([cut, [len(x)]]))

    # Subsets: the two sides of a key link with each other, each member with the other side's first.
    cut, size = groups(light)
    for a, n in zip(cut[size > 1], size[size > 1], strict=True):
        g = light[a : a + n]
        same, left, right = (g["item"][g["kind"] == k] for k in (SAME, LEFT, RIGHT))
        for one, many in ((same[:1], same[1:]), (left[:1], right), (right[:1], left)):
            if len(one) and len(many):
                out.append(np.stack([np.full(len(many), one[0]), many], 1))
    # Lists: all pairs of a short one; in a long one, the first items and the neighbours by size.
    cut, size = groups(e)
    part = np.maximum.reduceat(e["kind"], cut) == DEALT if len(e) else np.zeros(0, bool)
    for n in range(2, SHORT_LIST + 1):
        at = cut[(size == n) & ~part]
        for i, j in combinations(range(n), 2):
            x, y = e[at + i], e[at + j]
            ok = alike(x["n"], y["n"]) & ((x["n"] > limit) | (y["n"] > limit))
            out.append(np.stack([x["item"][ok], y["item"][ok]], 1))
    long = (size > SHORT_LIST) | part
    rows = []
    for a, n in zip(cut[long], size[long], strict=True):
        g = e[a : a + n]
        rows.append(g)
        first = 0
        while first < n:  # the first item of each stretch of sizes that can link with it
            end = first + int(np.searchsorted(g["n"][first:], DEN * int(g["n"][first]) // NUM, side="right"))
            out.append(np.stack([np.full(end - first - 1, g["item"][first]), g["item"][first + 1 : end]], 1))
            first = end
        ok = alike(g["n"][1:], g["n"][:-1])
        out.append(np.stack([g["item"][:-1][ok], g["item"][1:][ok]], 1))
    p = np.concatenate(out)
    p = np.sort(p[p[:, 0] != p[:, 1]], axis=1)
    return np.unique(p, axis=0), (np.concatenate(rows) if rows else e[:0])


def met(posted: DataFrame, limit: int) -> DataFrame:
    """(t, a, b, n): pairs of items (t 0), and entries of long lists (t 1: shingle, item, size)."""

    def run(table):
        import pyarrow as pa

        e = np.concatenate([unpacked(x.as_buffer()) for x in table["data"]])
        p, rows = pairs_of(e, limit)
        t = np.concatenate([np.zeros(len(p), np.int32), np.ones(len(rows), np.int32)])
        return pa.table({"t": t, "a": np.concatenate([p[:, 0], rows["h"].view(np.int64) if len(rows) else np.zeros(0, np.int64)]), "b": np.concatenate([p[:, 1], rows["item"]]), "n": np.concatenate([np.zeros(len(p), np.int64), rows["n"].astype(np.int64)])})

    return posted.groupBy("bucket").applyInArrow(run, "t int, a long, b long, n long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, s) of the items wanted (item, key of a document that holds it)."""

    def run(batches):
        import pyarrow as pa

        from idiomark.llm.tokens import text_blocks

        for whole in trimmed(batches):
            for batch in text_blocks(whole, "text"):
                sets = shingle_sets(batch["text"])
                yield pa.RecordBatch.from_arrays([pa.array([item_of(s) for s in sets], pa.int64()), batch["item"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["item", "wanted", "s"])

    some = docs.join(wanted.select(F.col("key").alias("_key"), "item"), F.col("key") == F.col("_key")).select("text", "item")
    return some.mapInArrow(run, "item long, wanted long, s binary").filter(F.col("item") == F.col("wanted")).select("item", "s").dropDuplicates(["item"])


@F.arrow_udf(T.BooleanType())
def links(a, b):
    """Whether two sets link."""
    import pyarrow as pa

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        out.append(both * DEN >= NUM * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.BooleanType())
def near(x, y, n, m):
    """Whether sets of these parities and sizes can link."""
    import pyarrow as pa

    out = [(NUM + DEN) * differ(a, b) <= (DEN - NUM) * (i + j) for a, b, i, j in zip(x.to_pylist(), y.to_pylist(), n.to_pylist(), m.to_pylist(), strict=True)]
    return pa.array(out, pa.bool_())


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that parities, a fiftieth of a set's size, do not rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("item").alias(side), F.col("n").alias("n" + side), F.col("parity").alias("p" + side)), side)
    return kept(pairs.filter(near("pa", "pb", "na", "nb")).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, small: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) that link, by whole sets.

    The list of documents that are read for them is broadcast if it has at most `small` rows."""
    items = kept(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().join(reps.select("item", "key"), "item"))
    s = kept(sets_of(docs, F.broadcast(items) if items.count() <= small else items))
    both = pairs.join(s.select(F.col("item").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("item").alias("b"), F.col("s").alias("sb")), "b")
    return kept(both.filter(links("sa", "sb")).select("a", "b"))


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id that edges lead to) of the ends of edges."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    lab = np.arange(len(ids))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            return ids, ids[lab]
        lab = new


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(v, comp) of every end of an edge (a, b): comp is the smallest id that edges lead to.

    Labels fall to the smallest among neighbours and then to their label's own label,
    until none falls. At most `small` edges, counted first, are labelled so within one
    task; more of them by joins."""
    edges = kept(edges.select("a", "b").distinct())
    if edges.count() <= (SMALL_EDGES if small is None else small):

        def run(table):
            import pyarrow as pa

            v, comp = labelled(table["a"].to_numpy(), table["b"].to_numpy())
            return pa.table({"v": v, "comp": comp})

        return kept(edges.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(run, "v long, comp long"))
    e = kept(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    total = None
    while True:
        lab = kept(lab)
        was, total = total, lab.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if was == total:  # labels only fall
            return lab
        near = e.join(lab.select(F.col("v").alias("b"), "comp"), "b").select(F.col("a").alias("v"), "comp")
        down = near.union(lab.select("v", "comp")).groupBy("v").agg(F.min("comp").alias("comp"))
        up = lab.select(F.col("v").alias("_v"), F.col("comp").alias("_c"))
        lab = down.join(up, F.col("comp") == F.col("_v"), "left").select("v", F.least("comp", F.coalesce("_c", "comp")).alias("comp"))


class Parities:
    """Parities of many sets, by length; a set also stands folded in the next shorter class."""

    def __init__(self, data: list[bytes]):
        self.length = np.asarray([len(x) for x in data], np.int64)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.length):
            own, twice = np.flatnonzero(self.length == size), np.flatnonzero(self.length == 2 * size)
            rows = [np.frombuffer(data[i], np.uint8) for i in own]
            rows += [np.frombuffer(data[i], np.uint8)[:size] ^ np.frombuffer(data[i], np.uint8)[size:] for i in twice]
            place = np.full(len(data), -1, np.int64)
            place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.by[int(size)] = np.stack(rows), place

    def apart(self, x: int, y: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences of x and the sets y, none of them smaller."""
        rows, place = self.by[int(self.length[x])]
        return np.bitwise_count(rows[place[y]] ^ rows[place[x]]).sum(1, dtype=np.int64)


def across(long: DataFrame, comps: DataFrame, reps: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of items that share a long list, lie in different components, and can link by size and parity.

    With `nearest`, each item of a block gives one pair, with the least difference by
    parity; else all pairs are given. Sizes and parities are compared within a block's
    task, so that what they rule out never becomes rows. Blocks grow with the root of a list, and so do the copies of
    its rows."""
    d = long.join(comps, F.col("item") == F.col("v"), "left").select("h", "item", "n", F.coalesce("comp", "item").alias("comp"))
    # Lists in one component are done; of lists with the same items, one is enough.
    lists = d.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("item").alias("size"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    lists = lists.filter("lo != hi").groupBy("size", "x", "y").agg(F.min("h").alias("g"))
    d = lists.select(F.col("g").alias("h"), F.ceil(F.col("size") / F.greatest(F.lit(LIST_BLOCK), F.ceil(SPREAD * F.sqrt("size")))).cast("int").alias("k")).join(d, "h")
    c = F.pmod(F.xxhash64(F.lit(2), "item"), "k").cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    d = d.withColumn("c", c).join(reps.select("item", "parity"), "item").withColumn("cell", F.explode(both))

    def run(table):
        import pyarrow as pa

        item, comp, n, chunk = (table[x].to_numpy() for x in ("item", "comp", "n", "c"))
        order = np.lexsort((item, n))
        data = table["parity"].to_pylist()
        item, comp, n, chunk = item[order], comp[order], n[order], chunk[order]
        parities = Parities([data[o] for o in order])
        between = table["i"][0].as_py() != table["j"][0].as_py()
        out = [np.zeros((0, 2), np.int64)]
        least, partner = np.full(len(item), np.iinfo(np.int64).max), np.full(len(item), -1)
        for x in range(len(item)):
            y = np.arange(x + 1, np.searchsorted(n, DEN * n[x] // NUM, side="right"))
            y = y[(comp[y] != comp[x]) & ((chunk[y] != chunk[x]) | (not between))]
            if not len(y):
                continue
            apart = parities.apart(x, y)
            near = (NUM + DEN) * apart <= (DEN - NUM) * (n[x] + n[y])
            y, apart = y[near], apart[near]
            if not len(y):
                continue
            if not nearest:
                out.append(np.sort(np.stack([np.full(len(y), item[x]), item[y]], 1), axis=1))
                continue
            if apart.min() < least[x]:
                least[x], partner[x] = apart.min(), y[apart.argmin()]
            closer = apart < least[y]
            least[y[closer]], partner[y[closer]] = apart[closer], x
        some = np.flatnonzero(partner >= 0)
        out.append(np.sort(np.stack([item[some], item[partner[some]]], 1), axis=1))
        p = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": p[:, 0], "b": p[:, 1]})

    cells = d.select("h", "item", "comp", "n", "c", "parity", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))
    return cells.groupBy("h", "i", "j").applyInArrow(run, "a long, b long").distinct()


def merged(comps: DataFrame, far: DataFrame) -> DataFrame:
    """Components after further links (a, b) between items."""
    name = comps.select(F.col("v").alias("_v"), F.col("comp").alias("_c"))
    for side in ("a", "b"):
        far = far.join(name, F.col(side) == F.col("_v"), "left").withColumn(side, F.coalesce("_c", side)).drop("_v", "_c")
    top = components(far.filter("a != b")).select(F.col("v").alias("_v"), F.col("comp").alias("_c"))
    single = top.join(comps, F.col("_v") == F.col("v"), "left_anti").select(F.col("_v").alias("v"), F.col("_c").alias("comp"))
    return kept(comps.join(top, F.col("comp") == F.col("_v"), "left").select("v", F.coalesce("_c", "comp").alias("comp")).union(single))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of every row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ids may be null or repeated; the key tells documents apart by their texts, too.
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    a = kept(summaries(docs))
    reps = kept(a.filter("n > 0").groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    sizes = {int(r["n"]): r["count"] for r in reps.filter(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    total = reps.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    shingles, different = a.agg(F.sum("shingles"), F.sum("different")).first()
    hot = a.select(F.explode("hot").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c")).orderBy(F.desc("c"), "h").limit(HOT_KEPT).collect()
    order = spark.sparkContext.broadcast(Order([(r["h"], r["c"]) for r in hot]))
    del hot
    limit = boundary(sizes, (shingles or 0) / max(1, different or 0) - 1)
    buckets = max(LEAST_BUCKETS, ceil(total / BUCKET))
    found = kept(met(postings(docs, order, limit, buckets), limit))
    pairs = kept(found.filter("t = 0").select("a", "b").distinct())
    linked = verified(possible(pairs, reps), docs, reps)
    comps = components(linked)
    long = found.filter("t = 1").select(F.col("a").alias("h"), F.col("b").alias("item"), "n")
    # Nearest pairs first, as long as they link anything; what then lies in different components is paired in full.
    left = ROUNDS
    while True:
        more = kept(across(long, comps, reps, left > 0).join(pairs, ["a", "b"], "left_anti"))
        far = verified(more, docs, reps) if more.limit(1).count() else None
        grown = far is not None and far.limit(1).count() > 0
        if grown:
            comps = merged(comps, far)
        if not left:
            break
        left = left - 1 if grown else 0
        pairs = kept(pairs.union(more))
    named = kept(reps.join(comps, F.col("item") == F.col("v"), "left").select("item", "doc_id", F.coalesce("comp", "item").alias("comp")))
    least = named.groupBy(F.col("comp").alias("_comp")).agg(F.min("doc_id").alias("component"))
    of_item = kept(salted_join(named.select("item", "comp"), "comp", least, "_comp").select(F.col("item").alias("_item"), "component"))
    rows = a.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("item")).alias("item"))
    return salted_join(rows, "item", of_item, "_item").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
