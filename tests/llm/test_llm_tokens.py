import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import CLASHES, documents, edge_rows
from tokenizers import Tokenizer

from kindred.llm import packing, records, sampled_pieces
from kindred.llm.blocks import mix
from kindred.llm.tokens import encoder

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXT = st.text(alphabet="ab'stlE 12!?\n\t\r\x1ćé漢🙂\xa0<|>▁", max_size=40)


@lru_cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def library(path, texts):
    """The library's plain call."""
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_cut_and_cached_encoding_equals_the_library(texts):
    texts = [*texts, "<|endoftext|> it's  a\n\n b", "don't 'S  x ", "Á b"]
    for path, glue in ((WORD_BPE, False), (BYTE_BPE, True)):
        ids, offsets = encoder(path, glue).encode(texts, 7)
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [x + [7] for x in library(path, texts)]


def test_added_tokens_spelled_in_texts():
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<|endof", "text|> plain", "", "last <|endoftext|>"]
    for path, glue in ((WORD_BPE, False), (BYTE_BPE, True)):
        ids, offsets = encoder(path, glue).encode(texts, 0)
        got = [ids[a : b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == library(path, texts)
        ordinary = Tokenizer.from_file(path)
        ordinary.encode_special_tokens = True
        ids, offsets = encoder(path, glue, spelled=False).encode(texts, 0)
        got = [ids[a : b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [e.ids for e in ordinary.encode_batch(texts, add_special_tokens=False)] != library(path, texts)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("kindred.llm.tokens.CACHE_PIECES", 3)
    enc = encoder(BYTE_BPE, True)
    for t in ("one two three four five six", "seven eight nine ten", "one two"):
        assert enc.encode([t], 0)[0].tolist() == library(BYTE_BPE, [t])[0] + [0]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), rng.integers(600, 1100, 500), np.full(100, 700), rng.geometric(0.01, 4000).clip(1, 2048), np.array([2048, 1]), np.array([1025] * 9 + [500] * 3)][seed]
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan_bins(counts)
    used = np.zeros(2049, int)
    for bin_, times in plan:
        assert 0 < sum(bin_) <= 2048 and times > 0
        np.add.at(used, bin_, times)
    assert (used == counts).all() and len(plan) <= 4 * len(set(lengths.tolist())) + 5
    bins, bound = sum(t for _, t in plan), -(-int(lengths.sum()) // 2048)
    # first-fit decreasing is the yardstick
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= x), None)
        if k is None:
            rooms.append(2048 - x)
        else:
            rooms[k] -= x
    assert bound <= bins <= 1.01 * len(rooms) + 1


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]
    # greedy 6 + 3 leaves 1; 3 goes for 2 + 2, which fill the bin
    assert packing.plan_bins(counts, 10)[0] == ([6, 2, 2], 1)
    assert packing.plan_bins(np.zeros(11, int), 10) == []


def test_packing_of_edge_rows(spark):
    rows = edge_rows()
    packed = packing.pack(documents(spark, rows), WORD_BPE, capacity=64)
    pieces = {r.row: r for r in packed.pieces.collect()}
    places = packed.places.collect()
    assert len(pieces) == len(places) and {p.row for p in places} == set(pieces)
    whole = {}
    for r in sorted(pieces.values(), key=lambda r: (r.row)):
        whole.setdefault((r.doc_id, r.row - r.piece), []).append((r.piece, r.start, r.length, r.ids))
    got = sorted((str(d), np.frombuffer(b"".join(x[3] for x in p), packed.dtype).tolist()) for (d, _), p in whole.items())
    assert got == sorted((str(d), ids + [0]) for (d, _), ids in zip(rows, library(WORD_BPE, [t or "" for _, t in rows]), strict=True))
    for p in whole.values():
        assert [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == [64 * k for k in range(len(p))]
        assert all(x[2] == 64 for x in p[:-1])
    taken = {}
    for p in places:
        taken.setdefault(p.sequence_id, []).append((p.offset, pieces[p.row].length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    sequences = packed.sequences().collect()
    assert sorted(s.n_tokens for s in sequences) == sorted(sum(n for _, n in v) for v in taken.values())
    none = packing.pack(documents(spark).where("false"), WORD_BPE)
    assert none.pieces.count() == 0 and none.places.count() == 0 and none.sequences().count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.integers(0, 2**32))
def test_sampled_pieces_spell_the_text(texts, seed):
    import pyarrow as pa

    from kindred.llm.blocks import Block

    v = sampled_pieces.vocabulary_of(PIECES, 0.5)
    points, offsets = Block(pa.array(texts, pa.large_string())).code_points()
    seeds = mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed))
    ids, ends = sampled_pieces.sample(points, offsets, seeds, v)
    for i, t in enumerate(texts):
        mine = ids[ends[i] : ends[i + 1]]
        assert b"".join(v.spelled[k] for k in mine).decode() == t
        # the same text and seed alone give the same pieces
        alone, alone_ends = sampled_pieces.sample(*Block(pa.array([t], pa.large_string())).code_points(), seeds[i : i + 1], v)
        assert alone.tolist() == mine.tolist()


def test_segmentations_have_their_probabilities():
    import itertools
    import math
    from collections import Counter

    v = sampled_pieces.vocabulary_of(PIECES, 0.5)
    weight = {v.spelled[i]: (w, i) for w, i in zip(v.weights, v.ids, strict=True)}
    word, n = "thing", 40000
    points = np.tile(np.array([ord(c) for c in word], np.uint32), n)
    ids, ends = sampled_pieces.sample(points, np.arange(n + 1) * len(word), mix(np.arange(n, dtype=np.uint64)), v)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
    want = {}
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        edge = [0, *(k for k, c in enumerate(cuts, 1) if c), len(word)]
        parts = [word[a:b].encode() for a, b in itertools.pairwise(edge)]
        if all(p in weight for p in parts):
            want[tuple(int(weight[p][1]) for p in parts)] = math.exp(sum(weight[p][0] for p in parts))
    total = sum(want.values())
    assert set(got) <= set(want) and len(want) > 5
    assert all(abs(got[k] / n - w / total) < 0.01 for k, w in want.items())


def test_sampled_pieces_of_edge_rows(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    one = sampled_pieces.encode(docs, PIECES, seed=4)
    got = sampled_pieces.decode(one, PIECES).collect()
    assert len(got) == len(rows) and all(r["_decoded"] == (r.text or "") for r in got) and all(r[c].startswith("own") for r in got for c in CLASHES if c != "_ids")
    key = lambda r: (str(r.doc_id), r.text or "", r["_ids"])
    again = sampled_pieces.encode(docs.repartition(7), PIECES, seed=4).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    other = sampled_pieces.encode(docs, PIECES, seed=5).collect()
    assert sorted(map(key, got)) != sorted(map(key, other))
    assert sampled_pieces.encode(docs.where("false"), PIECES).count() == 0


def test_checksums():
    def slow(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc = (crc >> 8) ^ int(records._TABLE[(crc ^ x) & 255])
        return crc ^ 0xFFFFFFFF

    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (4, 5, 255, 256, 257, 1000)]
    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    assert records.unframed(records.frames(parts)) == parts
    broken = bytearray(records.frames(parts)[3])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        records.unframed([bytes(broken)])


def test_records_of_edge_rows(spark, tmp_path):
    rows = edge_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = records.write_records(documents(spark, rows), f"file://{tmp_path}/out", BYTE_BPE, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(records.read_records(written).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and len(list((tmp_path / "out").glob("*.rec"))) > 1
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -(2**63) if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 2
        at += r.n_tokens
    want = sorted((str(d), zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for (d, _), ids in zip(rows, library(BYTE_BPE, [t or "" for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())) for r in got) == want
    # a record by its index row alone, in any order
    row = written.index.orderBy("size", ascending=False).first()
    data = (tmp_path / "out" / row.file).read_bytes()[row.offset : row.offset + row.size]
    assert records.unframed([data])[0][:8] == row.doc_id.to_bytes(8, "little", signed=True)
    none = records.write_records(documents(spark).where("false"), f"file://{tmp_path}/none", BYTE_BPE, 2)
    assert records.read_records(none).count() == 0
