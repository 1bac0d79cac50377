"""Ids, packing and token files against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from idiomark.llm import coder, packing, tokenfile, tokens


def plain(text, end):
    return tokens.tokenizer(tokens.public_path()).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encode_is_exact():
    rng = random.Random(1)
    parts = ["a", "the", "\n", " ", "  ", "\t", "é", "über", "123", "'s", "!!", " ", "😀", "\n\n", " x", "<|endoftext|>", "\r\n", "ß,", ".", "　", "​", "\x1f", "\x00", "end.", "é,", "x1;", "(a).", "\u212a.", "\u03a9!?", "it's.", "3.5.", "...", "\u01ff:", "\u0250,", "a\u0301."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [None, "", " ", "\n", "a\nb\nc d", "a \nb", "x" * 5000]
    path = tokens.public_path()
    for a in range(0, len(texts), 700):
        ids, offsets = tokens.encode(path, pa.array(texts[a : a + 700], pa.string()))
        for i, t in enumerate(texts[a : a + 700]):
            assert list(ids[offsets[i] : offsets[i + 1]]) == plain(t, 0)[:-1], repr(t)
    assert tokens.encode(path, pa.array([], pa.string()))[1].tolist() == [0]


def check_packing(pieces, texts, window=2048):
    rows = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    seen: dict = {}
    for r in rows:
        got = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(got) == r["length"] and r["offset"] + r["length"] <= window
        seen.setdefault(r["doc_id"], []).append((r["start"], got))
    for i, want in texts.items():
        assert [x for _, part in sorted(seen.pop(i)) for x in part] == want
    assert not seen
    by: dict = {}
    for r in rows:
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == window for k, n in by.items() if k != max(by)) and sorted(by) == list(range(len(by)))


def test_packing(spark, small, documents):
    pieces = packing.pack(spark.read.parquet(f"{small}/documents.parquet")).collect()
    check_packing(pieces, {i: plain(t, 1) for i, t, _, _ in documents})
    q = packing.query(spark, small).collect()
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in q} == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in pieces}


def test_packing_of_odd_rows(spark, odd, empty):
    d = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(d, window=64)
    check_packing(pieces.collect(), {r["doc_id"]: plain(r["text"], 1) for r in d.collect()}, 64)
    seqs = packing.sequences(pieces, 64).collect()
    assert all(len(r["ids"]) == 256 for r in seqs) and sum(r["n_tokens"] for r in seqs) == sum(len(plain(r["text"], 1)) for r in d.collect())
    assert sum(r["length"] for r in packing.pack(odd).collect()) == sum(len(plain(r["text"], 1)) for r in odd.collect())
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("shape", [(3, 200), (2, 40), (7, 300), (4, 64), (1, 1)])
def test_coder_round_trip(shape):
    rng = np.random.default_rng(shape[0])
    for blocks in (rng.integers(0, 65536, shape), np.zeros(shape, np.int64), np.full(shape, 65535), rng.choice([1, 2, 5, 50256], shape), rng.integers(0, 300, shape)):
        for order0 in (None, coder.Order0.counted(np.bincount(blocks.reshape(-1)))):
            assert (coder.decode(coder.encode(blocks, order0), shape[1], order0) == blocks).all()


def test_coder_learns():
    text = np.tile(np.arange(50) * 700, 40)[None]
    assert coder.encode(text)[0].nbytes < 0.25 * text.size
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 65536, (1, 2000))
    assert coder.encode(noise)[0].nbytes < 1.1 * noise.size * 2


def test_shards_find_damage():
    ids = np.arange(5000) % 977
    shard = tokenfile.shard_bytes(np.array([3, 9]), np.array([4000, 1000]), ids, 7)
    got = tokenfile.read_shard(shard)
    assert [x.tolist() for x in got] == [[3, 9], [4000, 1000], ids.tolist(), [False, False]] and tokenfile.header(shard)[3] == 7
    assert tokenfile.header(shard)[4] == 0 < tokenfile.header(tokenfile.shard_bytes(np.array([3]), np.array([5000]), ids % 50))[4]
    for at in (tokenfile.HEADER.size + 3, len(shard) - 1, len(shard) // 2):
        bad = bytearray(shard)
        bad[at] ^= 16
        with pytest.raises(ValueError, match="damaged|decode"):
            tokenfile.read_shard(bytes(bad))
    with pytest.raises(ValueError, match="65536"):
        tokenfile.shard_bytes(np.array([1]), np.array([1]), np.array([65536]))
    assert [x.tolist() for x in tokenfile.read_shard(tokenfile.shard_bytes(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)))] == [[], [], [], []]


def test_token_files(spark, small, documents):
    rows = sorted(tokenfile.query(spark, small).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, (i, text, _, _) in zip(rows, sorted(documents), strict=True):
        ids = plain(text, 2)
        assert tuple(r) == (i, at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD", 3000)
    d = odd.union(odd.filter("doc_id is null")).union(odd.limit(3))
    tokenfile.write(d, str(tmp_path / "t"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], crc(np.frombuffer(r["ids"], "<u4"))) for r in tokenfile.load(spark, str(tmp_path / "t")).collect())
    from pyspark.sql import functions as F

    at, want = 0, []
    for r in sorted(d.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"])):
        ids = plain(r["text"], 2)
        want.append((at, r["doc_id"], len(ids), crc(ids)))
        at += len(ids)
    assert got == want and any(r[1] is None for r in got)
    tokenfile.write(empty, str(tmp_path / "e"))
    assert tokenfile.load(spark, str(tmp_path / "e")).count() == 0


def test_a_repeated_row_is_dealt_to_several_tasks(spark, tmp_path):
    d = spark.range(0, 4000, 1, 8).selectExpr("7L as doc_id", "'the same text' as text")
    tokenfile.write(d, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 1
    got = tokenfile.load(spark, str(tmp_path / "t")).collect()
    n = len(plain("the same text", 2))
    assert sorted(r["start"] for r in got) == [n * i for i in range(4000)]
