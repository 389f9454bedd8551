import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm.blocks import Block, char_grams, row_blocks

TEXTS = st.lists(st.text(alphabet=" \t\n\x0b\x0cabAé漢🙂\xa0", max_size=30), min_size=0, max_size=6)
WORD = re.compile("[^\x20\x09-\x0d]+")


def block_of(texts):
    return Block(pa.array(texts, pa.large_string()))


def spans(block, start, end):
    return [bytes(block.data[a:b]).decode() for a, b in zip(start, end, strict=True)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines_match_plain_splitting(texts):
    block = block_of(texts)
    start, end, docs = block.words()
    assert list(zip(docs.tolist(), spans(block, start, end), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    start, end, docs = block.lines()
    assert list(zip(docs.tolist(), spans(block, start, end), strict=True)) == [(i, x) for i, t in enumerate(texts) for x in t.split("\n")]
    low, high = block.trimmed(start, end)
    assert spans(block, low, high) == [x.strip(" \t\n\x0b\x0c\r") for t in texts for x in t.split("\n")]
    points, offsets = block.code_points()
    assert ["".join(map(chr, points[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts


def test_hashes_depend_on_bytes_alone():
    a, b = block_of(["xx same", "same"]), block_of(["same"])
    ha, hb = (x.hashes(*x.words()[:2]) for x in (a, b))
    assert ha[1] == ha[2] == hb[0] != ha[0]
    assert (a.hashes(*a.words()[:2], 1) != ha).all()
    low = block_of(["ÀB zé"]).lowered()
    assert bytes(low.data).decode() == "Àb zé"


def test_grams_stay_inside_texts():
    points, offsets = block_of(["abc", "", "bc", "c"]).code_points()
    bucket, docs = char_grams(points, offsets, 2, 16)
    assert docs.tolist() == [0, 0, 2] and bucket[1] == bucket[2] != bucket[0]
    assert len(char_grams(np.zeros(0, np.uint32), np.zeros(1, np.int64), 2, 16)[0]) == 0


def test_blocks_are_bounded_and_hold_every_row():
    texts = [None, "", "x" * 50, "y" * 7, "z" * 7, "é" * 7]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts), "i": list(range(6))})
    parts = list(row_blocks([batch], "t", 16))
    assert [p.column("i").to_pylist() for p, _ in parts] == [[0, 1], [2], [3, 4], [5]] or sum((p.column("i").to_pylist() for p, _ in parts), []) == list(range(6))
    assert all(len(b.data) <= 16 or b.n == 1 for _, b in parts)
