"""Sampled subword segmentation: forward filtering, backward sampling over the lattice of pieces.

The lattice of a text has an edge for every vocabulary piece that matches, and edges of byte pieces where a
character has no piece. Going forward, every position gets the total weight of all paths that lead to it; going
backward from the end, a piece is drawn in proportion to the weight of the paths through it. So a
segmentation is drawn with its exact probability. Random numbers are a hash of the row's key and the place
in the text: the same row gets the same pieces in every batch, task and run.

Between two characters that stand side by side in no piece the lattice has a single node, so texts
are cut there and forward weights are computed once per distinct segment of a block; all segments take
their backward steps side by side. Decoding joins the pieces' bytes and gives back the text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import mix, row_blocks
from kindred.llm.common import Batches, beside_plain_names, columns_ddl, in_arrow, without

BLANK, _OWN_BLANK = 0x2581, 0x110001
#: bytes of text in a block: larger ones share more segments
BLOCK_BYTES = 1 << 20
#: exponent of a piece's weight; smaller values draw more evenly
SHARPNESS = 0.5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key ^ (key >> np.uint64(32))) * _STEP >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _extend(key: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (key + points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Pieces of a model by the hash of their characters, their log weights, and the bytes of every id.

    ``known`` and ``begun`` are tables of the hashes of pieces and of their beginnings.
    """

    longest: int
    keys: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    begun: np.ndarray
    side_by_side: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    spelled: list[bytes]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and the places of those pieces."""
        maybe = np.flatnonzero(self.known[_slot(key)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        return maybe[hit], at[hit]


def load_vocabulary(path: str, sharpness: float = SHARPNESS) -> Vocabulary:
    """Read a SentencePiece model with byte pieces.

    A model whose scores are log probabilities is used as it is; scores that are ranks (below -100) become
    weights 1 / (rank + 2). ``sharpness`` is the exponent of the weights.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_ids, spelled = [], np.full(256, -1), []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            spelled.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            normal.append(i)
            spelled.append(piece.replace("▁", " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so some texts could not be encoded")
    scores = np.array([model.get_score(i) for i in normal])
    if scores.min() < -100:
        scores = -np.log(2 - scores)
    pieces = [np.array([ord(c) for c in model.id_to_piece(i)], np.uint32) for i in normal]
    keys = []
    side_by_side, begun = np.zeros(1 << _TABLE_BITS, bool), np.zeros(1 << _TABLE_BITS, bool)
    for p in pieces:
        key = np.zeros(1, np.uint64)
        for c in p:
            key = _extend(key, np.array([c]))
            begun[_slot(key)] = True
        keys.append(key[0])
        side_by_side[_slot((p[:-1].astype(np.uint64) << np.uint64(32)) | p[1:])] = True
    keys = np.array(keys, np.uint64)
    order = np.argsort(keys)
    known = np.zeros(1 << _TABLE_BITS, bool)
    known[_slot(keys)] = True
    weights = (scores * sharpness).astype(np.float64)
    return Vocabulary(
        max(map(len, pieces)), keys[order], np.array(normal)[order], weights[order], known, begun, side_by_side, byte_ids, float(weights.min()), spelled
    )


def _segments(points: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """First positions of the segments."""
    first = np.ones(len(points), bool)
    pair = (points[:-1].astype(np.uint64) << np.uint64(32)) | points[1:]
    first[1:] = ~vocabulary.side_by_side[_slot(pair)]
    begin = offsets[:-1]
    first[begin[begin < len(points)]] = True
    return np.flatnonzero(first)


def _distinct(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct segment, and for every segment which one it is."""
    sums = np.zeros(len(points) + 1, np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points), 0xA0761D6478BD642F, np.uint64)]))
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    inverse = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points), inverse, np.uint64)]))
    key = mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    # equal hashes are held against the characters, so a collision cannot change a text
    at = np.arange(len(points)) - np.repeat(start, length)
    if (length[one][which] != length).any() or (points[np.repeat(start[one][which], length) + at] != points).any():
        raise ValueError("two segments have the same hash")
    return one, which


def _lattice(points: np.ndarray, length: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments end to end: drawing limits and piece ids of the edges into every node.

    Node ``p`` stands behind character ``p``; column L of the limits is the probability that the piece into
    the node has at most L + 1 characters. Byte edges have the id -1.
    """
    n, width = len(points), vocabulary.longest
    offset = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    weight = np.full((n, width), -np.inf, np.float32)
    ids = np.full((n, width), -1, np.int32)
    # starts that some piece begins with so far, and the characters left behind them in their segment
    room = np.repeat(length, length) - offset
    start, key = np.arange(n), np.zeros(n, np.uint64)
    for size in range(1, width + 1):
        fits = room[start] >= size
        start, key = start[fits], key[fits]
        key = _extend(key, points[start + size - 1])
        going = vocabulary.begun[_slot(key)]
        start, key = start[going], key[going]
        if not len(start):
            break
        hit, at = vocabulary.find(key)
        end = start[hit] + size - 1
        weight[end, size - 1] = vocabulary.weights[at]
        ids[end, size - 1] = vocabulary.ids[at]
    bare = ids[:, 0] < 0
    weight[bare, 0] = vocabulary.byte_weight * _utf8_length(points[bare])
    # forward: all segments advance one character at a time
    total = np.zeros(n)
    order = np.argsort(offset, kind="stable")
    cuts = np.searchsorted(offset[order], np.arange(int(length.max(initial=0)) + 1))
    for k in range(len(cuts) - 1):
        at = order[cuts[k] : cuts[k + 1]]
        span = min(k + 1, width)
        into = weight[at, :span].astype(np.float64)
        for size in range(1, span + 1):
            if size <= k:
                into[:, size - 1] += total[at - size]
        top = into.max(axis=1)
        share = np.exp(into - top[:, None])
        limits = np.cumsum(share, axis=1)
        total[at] = top + np.log(limits[:, -1])
        weight[at, :span] = limits / limits[:, -1:]
        weight[at, span:] = 1.0
    return weight, ids


def _utf8_length(points: np.ndarray) -> np.ndarray:
    own = np.where(points == _OWN_BLANK, BLANK, points)
    return 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)


def _utf8_bytes(points: np.ndarray, number: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte ``number`` of each character's UTF-8 form of the given length."""
    own = np.where(points == _OWN_BLANK, BLANK, points).astype(np.int64)
    part = (own >> (6 * (length - 1 - number))) & 0x3F
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[length] | (own >> (6 * (length - 1)))
    return np.where(length == 1, own, np.where(number == 0, lead, part | 0x80))


def sample(points: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Drawn piece ids of texts end to end, and the offsets of the texts in them."""
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    points = np.where(points == BLANK, _OWN_BLANK, np.where(points == 32, BLANK, points)).astype(np.uint32)
    start = _segments(points, offsets, vocabulary)
    length = np.diff(np.append(start, len(points)))
    one, which = _distinct(points, start, length)
    own = length[one]
    base = np.cumsum(own) - own
    flat = points[np.repeat(start[one] - base, own) + np.arange(int(own.sum()))]
    limits, ids = _lattice(flat, own, vocabulary)
    doc = np.searchsorted(offsets, start, side="right") - 1
    seed = mix(seeds[doc] + (start - offsets[doc]).astype(np.uint64) * _STEP)
    base, left = base[which], length.copy()
    active = np.arange(len(start))
    places, drawn = [], []
    while len(active):
        node = base[active] + left[active] - 1
        chance = (mix(seed[active] + left[active].astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        size = (limits[node] <= chance[:, None]).sum(axis=1)
        drawn.append(ids[node, size])
        left[active] -= size + 1
        places.append(start[active] + left[active])
        active = active[left[active] > 0]
    places, drawn = np.concatenate(places), np.concatenate(drawn)
    order = np.argsort(places)
    places, drawn = places[order], drawn[order]
    count = np.where(drawn < 0, _utf8_length(points[places]), 1)
    out = np.repeat(drawn, count)
    number = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    raw = np.flatnonzero(out < 0)
    of = np.repeat(places, count)[raw]
    out[raw] = vocabulary.byte_ids[_utf8_bytes(points[of], number[raw], np.repeat(count, count)[raw])]
    ends = np.concatenate([[0], np.cumsum(count)])
    return out.astype(np.int32), ends[np.searchsorted(places, offsets)]


_loaded: dict[tuple[str, float], Vocabulary] = {}


def vocabulary_of(path: str, sharpness: float) -> Vocabulary:
    """One vocabulary per worker process and path."""
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = load_vocabulary(path, sharpness)
    return _loaded[path, sharpness]


def encode(docs: DataFrame, model: str, seed: int = 0, sharpness: float = SHARPNESS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns, and ``_ids``, one drawn segmentation of the text.

    A null or empty text has no pieces. Rows with equal key and text get equal pieces; a null key counts as the
    smallest integer. A very long text is a block of its own and takes about eight bytes per character and possible piece length while
    it is sampled. A column ``_ids`` of the input is replaced.
    """
    return beside_plain_names(without(docs, "_ids"), [text, key], lambda d: _encode(d, model, seed, sharpness, text, key))


def _encode(docs: DataFrame, model: str, seed: int, sharpness: float, text: str, key: str) -> DataFrame:
    keyed = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))

    def rows(batches: Batches) -> Batches:
        vocabulary = vocabulary_of(model, sharpness)
        for batch, block in row_blocks(batches, text, BLOCK_BYTES):
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            points, offsets = block.code_points()
            ids, ends = sample(points, offsets, mix(mix(keys) + np.uint64(seed)), vocabulary)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "_ids"])

    return in_arrow(keyed, rows, f"{columns_ddl(docs)}, _ids array<int>")


def decode(rows: DataFrame, model: str, ids: str = "_ids") -> DataFrame:
    """All rows and columns, and ``_decoded``, the text that the pieces spell (empty for null)."""
    rows = without(rows, "_decoded")
    at = rows.columns.index(ids)

    def texts(batches: Batches) -> Batches:
        spelled = np.array(vocabulary_of(model, SHARPNESS).spelled, object)
        for batch in batches:
            out = [b"".join(spelled[x.values.to_numpy(zero_copy_only=False)]).decode() if x.is_valid else "" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "_decoded"])

    return in_arrow(rows, texts, f"{columns_ddl(rows)}, _decoded string")
