"""Token ids by the tokenizers library, with a compact cache of what it said.

Texts are cut at places where the tokenizer's pre-tokens end anyway. Each distinct piece is encoded by the library
once per worker, and the ids are put together with array operations. The cuts depend on neighbouring
ASCII characters and Latin letters only and are exact for the two kinds of pre-tokenizer handled here; the tests hold them
against whole-text encoding.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from kindred.llm.blocks import Block

#: distinct pieces to remember, about 40 bytes each; when more come, the cache starts anew
CACHE_PIECES = 2_000_000
#: bytes of text at a time
BLOCK_BYTES = 1 << 20
#: pieces handed to the library at a time
_TOGETHER = 1000

_LATIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
# byte-level vocabularies spell bytes without a visible Latin-1 sign as the characters from 256 on
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(_UNSEEN)}

_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _BREAK = range(7)


def _classes() -> np.ndarray:
    """The class of every ASCII byte; those of other characters than printable ones, blank and line break are not told apart."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[33:127] = _MARK
    for low, high in (("A", "Z"), ("a", "z")):
        kind[ord(low) : ord(high) + 1] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("'")], kind[ord(" ")], kind[ord("\n")] = _APOSTROPHE, _SPACE, _BREAK
    return kind


_KIND = _classes()
# letters, digits and marks end each other's pre-tokens; an apostrophe may begin one of several characters
_APART = np.zeros((7, 7), bool)
for _a in (_LETTER, _DIGIT, _MARK):
    for _b in (_LETTER, _DIGIT, _MARK):
        _APART[_a, _b] = _a != _b


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of every byte; both bytes of the Latin letters U+00C0 to U+023F are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
    lead = lead[~sign]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces: of every text, and wherever a pre-token surely begins.

    A blank between two printable characters begins one; a line break between two is one.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    if n > 2:
        kind = _kinds(data)
        first[1:n] |= _APART.ravel()[kind[:-1] * 7 + kind[1:]]
        printable = (kind >= _LETTER) & (kind <= _APOSTROPHE)
        inside = printable[:-2] & printable[2:]
        # neighbours in other texts must not count
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside &= ~(edge[1 : n - 1] | edge[2:n])
        blank, line = inside & (kind[1:-1] == _SPACE), inside & (kind[1:-1] == _BREAK)
        first[1 : n - 1] |= blank | line
        first[2:n] |= line
    return np.flatnonzero(first[:n])


class _Memory:
    """Places of pieces by two 64-bit hashes: a large sorted table and a small one that is merged into it."""

    def __init__(self):
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each piece, or -1."""
        place = np.full(len(one), -1, np.int64)
        for h1, h2, at in self.tables:
            if len(h1):
                k = np.minimum(np.searchsorted(h1, one), len(h1) - 1)
                hit = (h1[k] == one) & (h2[k] == two)
                place[hit] = at[k[hit]]
        return place

    def add(self, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        large, small = self.tables
        small = tuple(np.concatenate(p) for p in zip(small, (one, two, place), strict=True))
        if len(small[0]) > max(20_000, len(large[0]) // 8):
            large, small = tuple(np.concatenate(p) for p in zip(large, small, strict=True)), tuple(x[:0] for x in small)
            large = tuple(x[np.argsort(large[0], kind="stable")] for x in large)
        else:
            small = tuple(x[np.argsort(small[0], kind="stable")] for x in small)
        self.tables = [large, small]


class Encoder:
    """Encodes texts to one flat id array with offsets, without special tokens.

    ``glue`` tells whether a blank belongs to the piece after it (byte-level vocabularies) or is dropped
    (vocabularies whose pre-tokenizer removes white space). Texts that spell an added token, such as ``<|endoftext|>``, get its id
    like in the library's plain call; without ``spelled`` they get the ids of ordinary text.
    """

    def __init__(self, path: str, glue: bool, spelled: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.path, self._plain = path, None
        added = list(self.tokenizer.get_added_tokens_decoder().values()) if spelled else []
        self.added = [t.content.encode() for t in added]
        # a token that is looked for after normalisation may be spelled otherwise
        self.always_plain = any(t.normalized for t in added)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.glue = glue
        # what holds pieces apart when many are encoded in one call, and its id
        if glue:
            special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and len(t.content) > 2]
            self.mark, self.mark_id = special[0] if special else (None, -1)
            self.taboo = self.mark[:2] if special else None
        else:
            ids = self.tokenizer.encode("\x01", add_special_tokens=False).ids
            self.mark, self.mark_id = (" \x01 ", ids[0]) if len(ids) == 1 else (None, -1)
            self.taboo = "\x01"
        self._clear()

    def _clear(self) -> None:
        self._memory = _Memory()
        self._pool, self._ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _letters(self, piece: str) -> str | None:
        """What the model sees of a piece of Latin letters, which is a single pre-token; None for other pieces."""
        if not _LATIN.fullmatch(piece):
            return None
        if not self.glue:
            piece = piece.lower() if piece.isascii() else self.tokenizer.normalizer.normalize_str(piece)
            piece = piece.lstrip(" ")
            if not _LATIN.fullmatch(piece):
                return None
        return piece.encode().decode("latin-1").translate(_BYTE_SIGNS)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. Many pieces go in one call, held apart by a mark that they do not hold themselves."""
        out = {p: [t.id for t in self.tokenizer.model.tokenize(w)] for p in pieces if (w := self._letters(p))}
        alone = [p for p in pieces if p not in out and (self.mark is None or self.taboo in p)]
        out.update((p, e.ids) for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        rest = [p for p in pieces if p not in out]
        # a mark that is a special token has to be seen as one; pieces that could be taken for it are encoded above
        self.tokenizer.encode_special_tokens = not self.glue
        for k in range(0, len(rest), _TOGETHER):
            some = rest[k : k + _TOGETHER]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids
            cut = np.flatnonzero(np.array(ids) == self.mark_id).tolist()
            out.update((p, ids[a:b]) for p, a, b in zip(some, [0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True))
        self.tokenizer.encode_special_tokens = True
        return [out[p] for p in pieces]

    def _places(self, block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the ids of the pieces lie in the pool; new pieces are learnt."""
        hashes = block.hashes(start, end)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        second = block.hashes(start[example], end[example], 1)
        place = self._memory.find(distinct, second)
        new = np.flatnonzero(place < 0)
        if len(new):
            data = bytes(block.data)
            spans = zip(start[example[new]].tolist(), end[example[new]].tolist(), strict=True)
            ids = self._library([data[a:b].decode() for a, b in spans])
            place[new] = np.arange(len(self._ends) - 1, len(self._ends) - 1 + len(new))
            flat = np.fromiter(chain.from_iterable(ids), self.dtype, sum(map(len, ids)))
            self._pool = np.concatenate([self._pool, flat])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(i) for i in ids])])
            self._memory.add(distinct[new], second[new], place[new])
        return place[which]

    def encode(self, texts: list[str] | pa.Array | Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the offsets of the texts."""
        if len(self._memory) > CACHE_PIECES:
            self._clear()
        block = texts if isinstance(texts, Block) else Block(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        start = cuts(block.data, block.offsets)
        end = np.append(start[1:], len(block.data))
        count = np.diff(np.searchsorted(start, block.offsets))
        if not self.glue and len(start):
            # a blank in front says nothing, and so does a line break alone
            start = start + ((block.data[start] == 32) & (end - start > 1))
        at = self._places(block, start, end) if len(start) else np.zeros(0, np.int64)
        first, n = self._ends[at], self._ends[at + 1] - self._ends[at]
        done = np.concatenate([[0], np.cumsum(n)])
        own = self._pool[np.repeat(first - done[:-1], n) + np.arange(done[-1])]
        offsets = done[np.concatenate([[0], np.cumsum(count)])] + np.arange(block.n + 1)
        ids = np.full(offsets[-1], end_id, np.uint32)
        keep = np.ones(len(ids), bool)
        keep[offsets[1:] - 1] = False
        ids[keep] = own
        return self._with_added(block, ids, offsets, end_id)

    def _with_added(self, block: Block, ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with the texts that spell an added token encoded whole by the library."""
        if not self.added:
            return ids, offsets
        data = block.data.tobytes() if len(block.data) else b""
        found = set(range(block.n)) if self.always_plain else set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                doc = int(block.docs_of(np.array([at]))[0])
                if at + len(token) <= block.offsets[doc + 1]:
                    found.add(doc)
                    at = int(block.offsets[doc + 1]) - 1
                at = data.find(token, at + 1)
        if not found:
            return ids, offsets
        parts = np.split(ids, offsets[1:-1])
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self.path)
        for doc in found:
            text = data[block.offsets[doc] : block.offsets[doc + 1]].decode()
            parts[doc] = np.array([*self._plain.encode(text, add_special_tokens=False).ids, end_id], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, glue: bool, spelled: bool = True) -> Encoder:
    """One encoder per worker process, vocabulary and treatment of spelled added tokens."""
    if (path, glue, spelled) not in _encoders:
        _encoders[path, glue, spelled] = Encoder(path, glue, spelled)
    return _encoders[path, glue, spelled]
