"""Byte-level BPE ids of whole texts, through the tokenizers library.

A byte-level BPE with a word-splitting pattern never merges across a single
space or line feed that stands between two visible characters. A text is
therefore cut there, and marks after a letter or digit at the end of a piece are
taken off, as they are tokens of their own. Each distinct piece of an Arrow batch
is encoded once, pieces that a batch repeats are remembered by the process up to a
bound, and the ids are gathered per text. Texts with adjacent, leading or trailing
white space, and all texts of other tokenizers, are encoded directly.
"""

from __future__ import annotations

import os

import numpy as np

_SPACE = r"[\s\p{Z}\x{85}\x{180e}\x{200b}\x{feff}\x1c-\x1f]"
_DIRECT = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|[\\t\\r\\x0b\\x0c]"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process; special tokens in a text are ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A piece that is one word to the splitting pattern, whatever its version of Unicode.
_ONE_WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"


def _unsplit(path: str):
    """The tokenizer without its splitting pattern, for pieces that are one word anyway."""
    key = path + "#unsplit"
    if key not in _loaded:
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _loaded[key] = t
    return _loaded[key]


def _encode_pieces(path: str, pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of an Arrow array of short pieces."""
    import pyarrow as pa
    import pyarrow.compute as pc

    word = pc.match_substring_regex(pieces, _ONE_WORD).to_numpy(zero_copy_only=False)
    parts = [(np.flatnonzero(word == w), t) for w, t in ((True, _unsplit(path)), (False, tokenizer(path)))]
    done = [(at, *_encode(t, pieces.take(pa.array(at)).to_pylist())) for at, t in parts if len(at)]
    ids, lengths = np.concatenate([x for _, x, _ in done]), np.concatenate([n for *_, n in done])
    starts, order = np.cumsum(lengths) - lengths, np.argsort(np.concatenate([at for at, *_ in done]))
    return _gather(ids, starts[order], lengths[order]), lengths[order]


def _encode(t, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of short pieces, none of them holding an inner line feed.

    Pieces are encoded many at a time, with a line feed between them; it is a
    token of its own between visible characters and so marks where they end.
    """
    feed = _ids(t, "\n")
    if len(feed) != 1:
        return _encode_each(t, pieces)
    step, parts = 256, []
    texts = ["\n".join(pieces[i : i + step]) for i in range(0, len(pieces), step)]
    for a in range(0, len(texts), 64):  # the library's results are far larger than the ids
        parts += [np.asarray(e.ids + feed, np.uint32) for e in t.encode_batch_fast(texts[a : a + 64], add_special_tokens=False)]
    ids = np.concatenate(parts)
    ends = np.flatnonzero(ids == feed[0])
    if len(ends) != len(pieces):
        return _encode_each(t, pieces)
    keep = np.ones(len(ids), bool)
    keep[ends] = False
    return ids[keep], np.diff(np.concatenate([[-1], ends])) - 1


def _encode_each(t, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
    return np.asarray([i for x in got for i in x], np.uint32), np.asarray([len(x) for x in got], np.int64)


def _ids(t, text: str) -> list[int]:
    return t.encode(text, add_special_tokens=False).ids


def _cuttable(t) -> bool:
    """Whether texts may be cut at single spaces: byte-level, split into words by the usual pattern, nothing normalised."""
    said = repr(t.pre_tokenizer)
    return t.normalizer is None and said.startswith("ByteLevel(") and "use_regex=True" in said and "add_prefix_space=False" in said


#: Marks that end a word; letters and digits they may follow as a token of their own; pieces that a process remembers.
_MARKS = ".,;:!?"
_BEFORE_MARK = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "".join(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)))
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), np.uint8))
MOST_REMEMBERED = 300_000


def _core(piece: str) -> str:
    """A piece without the marks at its end, if they are tokens of their own."""
    core = piece.rstrip(_MARKS)
    return core if core and core[-1] in _BEFORE_MARK else piece


class _Memory:
    """Ids of pieces. Pieces that a block repeats stay for later blocks of the process, up to a bound; the rest is forgotten."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        import pyarrow as pa

        self.known = pa.array([""], pa.large_string())
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, pieces, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) where the last two are by piece of an Arrow array; counts says how often a block has each."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > MOST_REMEMBERED:
            self.clear()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.ids, self.start[at], self.length[at]
        new = pieces.take(pa.array(missing)).dictionary_encode()
        which = new.indices.to_numpy(zero_copy_only=False)
        # The repeated ones first: they stay.
        order = np.argsort(np.bincount(which, weights=counts[missing]) < 2, kind="stable")
        kept = int((np.bincount(which, weights=counts[missing]) >= 2).sum())
        new = new.dictionary.take(pa.array(order))
        ids, length = _encode_pieces(self.path, new)
        base, n = len(self.ids), len(self.start)
        place = np.empty(len(order), np.int64)
        place[order] = n + np.arange(len(order))
        at[missing] = place[which]
        all_ids, all_length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        all_start = np.concatenate([self.start, base + np.cumsum(length) - length])
        end = base + int(length[:kept].sum())
        self.known = pa.concat_arrays([self.known, new[:kept]])
        self.ids, self.start, self.length = all_ids[:end].copy(), all_start[: n + kept].copy(), all_length[: n + kept].copy()
        return all_ids, all_start[at], all_length[at]


_memories: dict[str, _Memory] = {}


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ids[start : start + length]."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, ids.dtype)
    kind = np.int32 if total + len(ids) < 1 << 31 else np.int64
    ends -= lengths
    at = np.repeat((starts - ends).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return ids.take(at)


def _coded(path: str, t, texts, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts without adjacent or outer white space, each followed by `end`.

    Every distinct piece becomes a run of ids once; a text is a list of pieces. What stands before a piece, a space, a
    line feed or nothing, is part of it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from idiomark.llm.common import byte_view

    pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    bounds = np.asarray(pieces.offsets).astype(np.int64)
    bounds -= bounds[0]
    words = pieces.flatten().dictionary_encode()
    index, words = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.dictionary
    # A text's first piece has nothing before it; others have a line feed or a space.
    opening, first = np.unique(index[bounds[:-1]], return_inverse=True)
    raw, at = byte_view(words)
    feed = raw[at[:-1]] == 10
    bare = pc.if_else(pa.array(feed), pc.utf8_slice_codeunits(words, 1), pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type)))
    bare = pa.concat_arrays([bare, words.take(pa.array(opening))])
    marked = _IS_MARK[raw[at[1:] - 1]]
    marked = np.concatenate([marked, marked[opening]])
    whole = bare.filter(pa.array(marked)).to_pylist()
    cores = [_core(w) for w in whole]
    marks = [w[len(c) :] for w, c in zip(whole, cores, strict=True)]
    n, m = len(bare), len(marks)
    counts = np.concatenate([np.bincount(index, minlength=len(words)), np.bincount(first, minlength=len(opening))])
    bare = pc.replace_with_mask(bare, pa.array(marked), pa.array(cores, bare.type))
    ids, start, length = _memories.setdefault(path, _Memory(path)).find(pa.concat_arrays([bare, pa.array(marks, bare.type)]), np.concatenate([counts, counts[marked]]))
    # Runs of a distinct piece: its line feed, its core, its marks; the last run of all is the end of a text.
    fixed = np.asarray(_ids(t, "\n") + end, np.uint32)
    runs = np.zeros((2, n + 1, 3), np.int64)
    runs[0, :-1, 0], runs[1, : len(words), 0] = len(ids), feed * (len(fixed) - len(end))
    runs[:, :-1, 1] = start[:n], length[:n]
    runs[0, :-1, 2][marked], runs[1, :-1, 2][marked] = start[n:], length[n:]
    runs[:, -1, 0] = len(ids) + len(fixed) - len(end), len(end)
    flat = _gather(np.concatenate([ids, fixed]), runs[0].reshape(-1), runs[1].reshape(-1))
    size = runs[1].sum(1)
    if len(flat) and int(flat.max()) < 1 << 16:
        flat = flat.astype(np.uint16)
    index[bounds[:-1]] = len(words) + first
    del pieces, words, bare, runs, ids
    index = np.insert(index, bounds[1:], n)
    size = size.astype(np.int32)
    lengths = size[index]
    offsets = np.concatenate([[0], np.add.reduceat(lengths, bounds[:-1] + np.arange(len(bounds) - 1), dtype=np.int64).cumsum()])
    starts = (np.cumsum(size, dtype=np.int64) - size)[index]
    return _gather(flat, starts, lengths), offsets


def encode(path: str, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string array: (all ids, unsigned; offsets of each text), each text followed by end_id. Null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t, end = tokenizer(path), [] if end_id is None else [end_id]
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    direct = some & (pc.match_substring_regex(texts, _DIRECT).to_numpy(zero_copy_only=False) if _cuttable(t) else True)
    cut = np.flatnonzero(some & ~direct)
    if len(cut) == n:
        return _coded(path, t, texts, end)
    flat, bounds = _coded(path, t, texts.take(pa.array(cut)), end) if len(cut) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    rest = np.flatnonzero(direct)
    got = [np.asarray(e.ids + end, np.uint32) for e in t.encode_batch_fast(texts.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
    counts = np.full(n, len(end), np.int64)
    counts[cut], counts[rest] = np.diff(bounds), [len(x) for x in got]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(offsets[-1]), end_id or 0, np.uint32)
    lengths = np.diff(bounds)
    out[np.repeat(offsets[cut] - bounds[:-1], lengths) + np.arange(len(flat))] = flat
    for i, x in zip(rest, got, strict=True):
        out[offsets[i] : offsets[i + 1]] = x
    return out, offsets


def text_blocks(batch, column: str, limit: int = 1 << 23):
    """Slices of an Arrow batch whose texts have at most so many bytes together; a longer text stands alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from idiomark.llm.common import blocks

    sizes = pc.fill_null(pc.binary_length(batch[column].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    for a, b in blocks(sizes, limit):
        yield batch.slice(a, b - a)
