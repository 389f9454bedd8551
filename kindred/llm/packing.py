"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest pieces that fit. Then its smallest piece is exchanged for the
two unpacked pieces that together fill the gap it leaves most tightly, as long as this fills the bin better.

Pieces of equal length are interchangeable, so bins are planned on the histogram of lengths, which has at
most ``capacity`` entries whatever the number of documents. A planned bin repeats until one of its
lengths runs out, so the plan, too, is about as long as the histogram. Pieces then look up their place by their
rank among the pieces of their length: ranks are counted inside tasks and shifted by running totals over
the tasks, so nothing is sorted and a length shared by many pieces is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.blocks import row_blocks
from kindred.llm.common import Batches, columns_ddl, in_arrow, stored
from kindred.llm.tokens import BLOCK_BYTES, encoder

CAPACITY = 2048
#: most room that an exchange may leave, one plan each
ROOMS = (0, 4, 32, 256, 1 << 30)


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, repetitions) that use up ``counts`` (pieces by length, index 0 to capacity).

    An exchange spends short pieces that later bins may need, so several plans are made, in which it must leave
    at most so much room; the one with the fewest bins is taken.
    """
    plans = [_plan(counts, capacity, room) for room in ROOMS]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: np.ndarray, capacity: int, most_room: int) -> list[tuple[list[int], int]]:
    left = counts.astype(np.int64).copy()
    plan = []
    while left.any():
        bin_: list[int] = []
        room = capacity
        lengths = np.flatnonzero(left)
        k = len(lengths) - 1
        while k >= 0 and room:
            k = int(np.searchsorted(lengths, room, side="right")) - 1 if lengths[k] > room else k
            if k < 0:
                break
            n = min(int(left[lengths[k]]), room // int(lengths[k]))
            bin_ += [int(lengths[k])] * n
            left[lengths[k]] -= n
            room -= n * int(lengths[k])
            k -= 1
        while room and bin_:
            smallest = bin_[-1]
            pair = _best_pair(left, room + smallest)
            if pair is None or sum(pair) <= smallest or room + smallest - sum(pair) > most_room:
                break
            bin_.pop()
            left[smallest] += 1
            for length in pair:
                bin_.append(length)
                left[length] -= 1
            room += smallest - sum(pair)
            bin_.sort(reverse=True)
        lengths, n = np.unique(bin_, return_counts=True)
        times = 1 + int((left[lengths] // n).min())
        left[lengths] -= n * (times - 1)
        plan.append((bin_, times))
    return plan


def _best_pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two unpacked pieces whose lengths add up to at most the gap, and to as much as possible."""
    lengths = np.flatnonzero(left[:gap])
    if not len(lengths):
        return None
    one = lengths[2 * lengths <= gap]
    if not len(one):
        return None
    k = np.searchsorted(lengths, gap - one, side="right") - 1
    # a length that is left once cannot be paired with itself
    k = np.where((lengths[k] == one) & (left[one] < 2), k - 1, k)
    ok = (k >= 0) & (lengths[np.maximum(k, 0)] >= one)
    if not ok.any():
        return None
    total = np.where(ok, one + lengths[np.maximum(k, 0)], -1)
    best = int(total.argmax())
    return int(one[best]), int(lengths[k[best]])


@dataclass
class Packing:
    """``pieces``: (row, doc_id, piece, start, length, ids); ``places``: (row, sequence_id, offset), both written out."""

    pieces: DataFrame
    places: DataFrame
    dtype: str

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, ids) of every sequence; at most ``capacity`` ids each."""
        parts = self.pieces.select("row", "ids").join(self.places, "row")
        whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        ids = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
        width = np.dtype(self.dtype).itemsize
        return whole.select("sequence_id", (F.length(ids) / width).cast("long").alias("n_tokens"), ids.alias("ids"))


def tokenized(docs: DataFrame, tokenizer: str, glue: bool, end_id: int, capacity: int, text: str, doc_id: str) -> DataFrame:
    """(row, part, rank, doc_id, piece, start, length, ids): pieces of at most ``capacity`` ids.

    ``rank`` counts the pieces of equal length in the task ``part``; ``row`` is unique.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def rows(batches: Batches) -> Batches:
        part, seen, row = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 0
        enc = encoder(tokenizer, glue)
        for batch, block in row_blocks(batches, "text", BLOCK_BYTES):
            ids, offsets = enc.encode(block, end_id)
            n = np.diff(offsets)
            per = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(n[of] - start, capacity)
            rank = np.empty(len(of), np.int64)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            rank[order] = np.arange(len(order)) - first
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            data = ids.astype(enc.dtype)
            begin = offsets[of] + start
            packed = pa.array([data[a : a + b].tobytes() for a, b in zip(begin, length, strict=True)], pa.binary())
            number = np.arange(row, row + len(of)) + (part << 33)
            row += len(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(np.full(len(of), part, np.int32)), pa.array(rank), batch.column("doc_id").take(pa.array(of)),
                 pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), packed],
                ["row", "part", "rank", "doc_id", "piece", "start", "length", "ids"],
            )

    kind = columns_ddl(source.select("doc_id"))
    return in_arrow(source, rows, f"row long, part int, rank long, {kind}, piece int, start long, length long, ids binary")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, glue: bool = False, text: str = "text", doc_id: str = "doc_id"
) -> Packing:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a vocabulary of the tokenizers library. A document is its ids and
    ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than a sequence are cut, into full pieces and a
    shorter last one. Every row gives its own pieces, repeated rows and ids too. An empty table gives no pieces.
    """
    pieces = stored(tokenized(docs, tokenizer, glue, end_id, capacity, text, doc_id), "pieces", compression="zstd")
    by_part = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    tables = lookup_tables(plan_bins(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.select("row", "part", "length", "rank").join(bases, ["part", "length"])

    def place(batches: Batches) -> Batches:
        edges, first, sequence, offset = tables
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            # steps of a length lie together, in rising order of their first rank
            key = length.astype(np.int64) << 48 | rank
            at = np.searchsorted(edges, key, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["row", "sequence_id", "offset"]
            )

    ranked = ranked.select("row", "length", (F.col("base") + F.col("rank")).alias("rank"))
    places = in_arrow(ranked, place, "row long, sequence_id long, offset long")
    return Packing(pieces.drop("part", "rank"), places, encoder(tokenizer, glue).dtype.str)


def lookup_tables(plan: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank), first rank, first sequence and offset of every slot of the plan."""
    slots, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for bin_, times in plan:
        offset = 0
        for length in bin_:
            slots.append((length << 48 | int(used[length]), int(used[length]), sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return tuple(np.array(sorted(slots), np.int64).reshape(-1, 4).T)
