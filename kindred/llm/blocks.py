"""Whole texts as flat arrays: the vectorised ground under the operators of this subpackage.

Arrow batches are cut into blocks of bounded size (a single longer text is a block of its own), so
that a task's memory does not depend on the number of rows. A block is one byte array with document
offsets; words, lines and their hashes are found with array operations, never text by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text in a block, unless one text alone is longer
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_BASE = _BASES[0]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept up to the usual block size."""
    held = _powers.get(int(base))
    if held is not None and len(held) >= n:
        return held[:n]
    step = np.full(max(n, BLOCK_BYTES + 2), base)
    step[0] = 1
    powers = np.cumprod(step)
    if n <= BLOCK_BYTES + 2:
        _powers[int(base)] = powers
    return powers[:n]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as plain strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def row_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, "Block"]]:
    """Slices of the batches whose texts have about ``limit`` bytes, each with its block."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), Block(texts.slice(at, to - at))
            at = to


class Block:
    """Texts end to end: ``data`` (bytes) and ``offsets`` (one more than texts)."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        own = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data or b"", np.uint8)[own[0] : own[-1]]
        self.offsets = own - own[0]
        self._prefix: dict[int, np.ndarray] = {}
        self._chars: np.ndarray | None = None

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        if self._chars is None:
            self._chars = np.zeros(len(self.data) + 1, np.int32)
            np.cumsum((self.data & 0xC0) != 0x80, out=self._chars[1:])
        return self._chars

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans, which depend on the bytes alone; there are two independent ones."""
        if which not in self._prefix:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            terms = self.data.astype(np.uint64)
            terms += np.uint64(1)
            terms *= _power(_BASES[which], len(self.data))
            np.cumsum(terms, out=sums[1:])
            self._prefix[which] = sums
        sums = self._prefix[which]
        span = (sums[end] - sums[start]) * _power(_INVERSES[which], len(self.data) + 1)[start]
        return mix(span + (end - start).astype(np.uint64) * np.uint64(_ODD))

    def lowered(self) -> "Block":
        """The same block with A-Z as a-z."""
        other = object.__new__(Block)
        other.__dict__ = self.__dict__ | {"_prefix": {}}
        other.data = np.where((self.data >= 65) & (self.data <= 90), self.data | 32, self.data).astype(np.uint8)
        return other

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes other than 0x20 and 0x09-0x0D: start, end, text."""
        space = (self.data == 0x20) | ((self.data >= 0x09) & (self.data <= 0x0D))
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        cut = self.offsets[1:-1]
        cut = cut[cut < len(self.data)]
        first[cut] = inside[cut]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= space[1:]
        before = cut[cut > 0] - 1
        last[before] = inside[before]
        return start, np.flatnonzero(last) + 1, self.docs_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between newlines: start, end, text. An empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        docs = np.concatenate([np.arange(self.n), self.docs_of(breaks)])
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.lexsort((start, docs))
        start, docs = start[order], docs[order]
        last = np.append(docs[1:] != docs[:-1], True) if len(docs) else np.zeros(0, bool)
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[last] = self.offsets[docs[last] + 1]
        return start, end, docs

    def trimmed(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without bytes 0x20 and 0x09-0x0D at both ends; empty spans stay at their start."""
        space = (self.data == 0x20) | ((self.data >= 0x09) & (self.data <= 0x0D))
        solid = np.flatnonzero(~space)
        if not len(solid):
            return start, start.copy()
        low = np.searchsorted(solid, start)
        high = np.searchsorted(solid, end) - 1
        some = low <= high
        top = len(solid) - 1
        return (np.where(some, solid[np.minimum(low, top)], start), np.where(some, solid[np.clip(high, 0, top)] + 1, start))

    def per_doc(self, docs: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sums of the values (or counts) by text."""
        if values is None:
            return np.bincount(docs, minlength=self.n)
        return np.bincount(docs, weights=values, minlength=self.n)

    def code_points(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All texts as code points, and the offsets of the texts in them."""
        if lower:
            texts = [t.lower() for t in self.texts.to_pylist()]
            joined, lengths = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets
        points = np.frombuffer(bytes(self.data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        return points, self.chars()[self.offsets].astype(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs more than once, and whether it does so at an earlier place."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, again


def char_grams(points: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of code points that do not cross texts: buckets below ``2 ** bits``, and their texts."""
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = len(points) - n + 1
    if places < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.full(places, n, np.uint64)
    for k in range(n):
        key = key * _BASE + points[k : k + places]
    key ^= key >> np.uint64(29)
    inside = docs[:places] == docs[n - 1 :]
    return ((key * np.uint64(_ODD)) >> np.uint64(64 - bits)).astype(np.int64)[inside], docs[:places][inside]
