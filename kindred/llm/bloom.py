"""Bloom filters built by all tasks together.

A task sets bits for its own rows and leaves its filter in chunks; chunks of equal number are merged in
a stream (one chunk in memory at a time), so neither a task nor the driver holds more than one
filter. Beside "some row set this bit" the filters know "two rows set it", which a single filter
over all rows could not tell. The size of a filter is stated by the caller and capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.blocks import mix
from kindred.llm.common import Batches, columns_ddl, in_arrow, stored

#: bits set per row, and bits of a filter per expected row
HASHES, BITS_PER_ROW = 4, 16
#: largest filter, in bits: 32 MB; with more rows than it is meant for it only lets more rows pass
MAX_BITS = 1 << 28
_CHUNK = 1 << 13


def size_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """Bits for so many rows: a power of two between 2 ** 16 and the cap."""
    return min(max_bits, max(1 << 16, 1 << max(1, rows * BITS_PER_ROW - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row per hash function."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
    step = mix(h) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) >> np.uint64(7)) & np.uint64(bits - 1) for k in range(HASHES)]).astype(np.int64)


def _test(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_contain(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that did not set all their bits."""
    return _test(filter_, positions(hashes, 8 * len(filter_))).all(axis=0)


def build(rows: DataFrame, column: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(once, twice): bits set by at least one and by at least two rows of a long column; nulls set none."""

    def fill(batches: Batches) -> Batches:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            at, n = np.unique(positions(hashes, bits), return_counts=True)
            bit = np.left_shift(1, at & 7).astype(np.uint8)
            more = (n > 1) | _test(once, at)
            np.bitwise_or.at(twice, at[more] >> 3, bit[more])
            np.bitwise_or.at(once, at >> 3, bit)
        for chunk in range(0, len(once), _CHUNK):
            if once[chunk : chunk + _CHUNK].any():
                yield _row(chunk // _CHUNK, once[chunk : chunk + _CHUNK], twice[chunk : chunk + _CHUNK])

    def merge(batches: Batches) -> Batches:
        at, once, twice = None, None, None
        for batch in batches:
            for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if chunk != at:
                    if at is not None:
                        yield _row(at, once, twice)
                    at, once, twice = chunk, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
        if at is not None:
            yield _row(at, once, twice)

    schema = "chunk int, once binary, twice binary"
    parts = in_arrow(rows.select(column), fill, schema)
    merged = in_arrow(parts.repartition("chunk").sortWithinPartitions("chunk"), merge, schema).toPandas()
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for chunk, a, b in merged.itertuples(index=False):
        once[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(a, np.uint8)
        twice[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(b, np.uint8)
    return once, twice


def _row(chunk: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())],
        ["chunk", "once", "twice"],
    )


def passing(rows: DataFrame, column: str, filter_: np.ndarray, flag: str) -> DataFrame:
    """All rows with a boolean column: whether the filter may contain the row's hash (null: false)."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_)
    at = rows.columns.index(column)

    def mark(batches: Batches) -> Batches:
        for batch in batches:
            hashes = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            found = may_contain(shared.value, hashes) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, flag])

    return in_arrow(rows, mark, f"{columns_ddl(rows)}, `{flag}` boolean")


def _near(rows: DataFrame, column: str, ids: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a flag whether a filter of the distinct ids lets them pass, and those ids."""
    ids = stored(ids.toDF("_bloom_id").where("_bloom_id is not null").distinct(), "ids")
    hashed = ids.select(F.xxhash64("_bloom_id").alias("_bloom_hash"))
    once, _ = build(hashed, "_bloom_hash", size_for(ids.count(), max_bits))
    key = F.when(F.col(column).isNotNull(), F.xxhash64(column))
    return passing(rows.withColumn("_bloom_hash", key), "_bloom_hash", once, "_bloom_near").drop("_bloom_hash"), ids


def rows_with_ids(rows: DataFrame, column: str, ids: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows whose (non-null) id occurs in ``ids``, a one-column table that may be large.

    Wide rows are not exchanged unless a filter of the ids lets them pass; the join decides.
    """
    flagged, ids = _near(rows, column, ids, max_bits)
    near = flagged.where("_bloom_near").drop("_bloom_near")
    return near.hint("merge").join(ids, F.col(column) == F.col("_bloom_id"), "left_semi")


def rows_without_ids(rows: DataFrame, column: str, ids: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The other rows; those that the filter stops pass straight through."""
    flagged, ids = _near(rows, column, ids, max_bits)
    near = flagged.where("_bloom_near").drop("_bloom_near")
    rest = near.hint("merge").join(ids, F.col(column) == F.col("_bloom_id"), "left_anti")
    return flagged.where("not _bloom_near").drop("_bloom_near").unionByName(rest)
