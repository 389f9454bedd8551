"""Second moments of wide rows.

A row carries a fixed-length vector; the operator sums v v' over all rows. While the matrix fits a task, each
task keeps one and ships only that, so the input is never shuffled: the exchange holds (tasks x cells) partial sums, spread by cell.

A somewhat larger matrix (up to 24 million cells in tiles of the upper triangle) is summed up in tasks too, tile by tile, and leaves them
as packed rows of tiles once their input ends. So what is exchanged depends on tasks and tiles, not on rows.

A still larger matrix is formed at its tiles: tasks cut their rows into strips of columns and send each pair of strips to its
tile, dealt over as many salts as it takes to use all cores and to keep the rows of a salt bounded. A task holds one tile, adds up what arrives, and lets go of it when
the next tile begins, so what it emits depends on tiles and salts only, not on buffers. A second, light exchange adds up the salts.
A row with few entries skips this and emits its products at once, since they are fewer than the cells of a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import scratch_path, small_batches

#: cells of numbers a task holds: of its sums, and of the rows it works on at a time, however many there are
_MAX_CELLS, _ROW_CELLS = 16_000_000, 1 << 20
#: rows of a matrix of sums that products are added to at a time
_SUM_ROWS = 512
#: side of the tiles in which larger matrices are formed, and cells of the strips sent to them at a time
_TILE, _STRIP_CELLS = 2048, 1 << 20
#: rows whose strips go to one salt of a tile, about: a task reads at most twice 64 MB of strips for each
_SALT_ROWS = 4096
#: a product of entries costs about as much as this many of a dense matrix product
_SPARSE_COST = 300


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column(batch.num_columns - 1).flatten()
    if len(flat) != batch.num_rows * width or flat.null_count:
        raise ValueError(f"every vector must hold {width} non-null numbers")
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.float64, copy=False)


def _entries(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of sparse rows, in this order; a position given twice is an error."""
    entries = batch.column(batch.num_columns - 1)
    rows = np.repeat(np.arange(batch.num_rows), entries.value_lengths().to_numpy(zero_copy_only=False))
    flat = entries.flatten()
    at = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = flat.field(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((at, rows))
    rows, at, value = rows[order], at[order], value[order]
    if ((rows[1:] == rows[:-1]) & (at[1:] == at[:-1])).any():
        raise ValueError("an activation is given more than once for a layer, stimulus and feature")
    return rows, at, value


def _sparse_products(rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
    """``(i, j, s)`` of the products inside rows, i <= j, about a million products at a time."""
    ends = np.searchsorted(rows, rows, side="right")
    count = ends - np.arange(len(rows))
    total = np.cumsum(count)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + min(_ROW_CELLS, _MAX_CELLS // 4), side="right")))
        n = count[lo:hi]
        first = np.repeat(np.arange(lo, hi), n)
        second = first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key, which = np.unique(at[first] * width + at[second], return_inverse=True)
        yield key // width, key % width, np.bincount(which, value[first] * value[second])
        lo = hi


def _by_key(batch: pa.RecordBatch, keyed: bool):
    """``(key, rows of it)``."""
    if not keyed:
        return [(None, batch)]
    codes = batch.column(0).dictionary_encode()
    index = codes.indices.to_numpy(zero_copy_only=False)
    return [(key.as_py(), batch.take(pa.array(np.flatnonzero(index == c)))) for c, key in enumerate(codes.dictionary)]


def _buffers(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows_at_once):
            part = batch.slice(lo, rows_at_once)
            if held and rows + part.num_rows > rows_at_once:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block(part: pa.RecordBatch, width: int, augment: Callable | None, sparse: bool) -> np.ndarray:
    if not sparse:
        z = _dense(part, width)
        return z if augment is None else augment(z)
    rows, at, value = _entries(part, width)
    z = np.zeros((part.num_rows, width))
    z[rows, at] = value
    return z


def _cells(key, i, j, s, keyed: bool) -> pa.RecordBatch:
    columns, names = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.float64())], ["i", "j", "s"]
    if keyed:
        columns.insert(0, pa.array([key] * len(i), pa.string()))
        names.insert(0, "key")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _whole_sums(width: int, augment: Callable | None, keyed: bool, sparse: bool):
    """One task's sums, without zeros; they leave early only if keys are so many that their matrices exceed the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def emit():
            for key, total in sums.items():
                step = max(1, _ROW_CELLS // len(total))
                for lo in range(0, len(total), step):
                    some = np.triu(total[lo : lo + step], lo)
                    i, j = np.nonzero(some)
                    yield _cells(key, i + lo, j, some[i, j], keyed)
            sums.clear()

        for batch in _buffers(batches, max(1, _ROW_CELLS // width)):
            for key, part in _by_key(batch, keyed):
                z = _block(part, width, augment, sparse)
                if key not in sums:
                    sums[key] = np.zeros((z.shape[1], z.shape[1]))
                total = sums[key]
                # rows of the upper triangle, so that no second matrix is held
                for lo in range(0, len(total), _SUM_ROWS):
                    total[lo : lo + _SUM_ROWS, lo:] += z[:, lo : lo + _SUM_ROWS].T @ z[:, lo:]
                if sum(t.size for t in sums.values()) > _MAX_CELLS:
                    yield from emit()
        yield from emit()

    return run


def _by_entries(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about so many entries; rows of a wide matrix may have few entries each."""
    for batch in batches:
        ends = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + entries, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _light_sums(width: int, keyed: bool):
    """Products of rows with few entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_entries(batches, _ROW_CELLS):
            for key, part in _by_key(batch, keyed):
                yield from (_cells(key, *cells, keyed) for cells in _sparse_products(*_entries(part, width), width))

    return run


_STRIPS = "key string, r int, c int, salt int, n int, one binary, two binary"


def _strips(width: int, augment: Callable | None, keyed: bool, sparse: bool, salts: int):
    """Pairs of strips of columns, for the tile (r, c) with r <= c; a diagonal tile needs one strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = context.partitionId() if context else 0
        for batch in _buffers(batches, max(1, _STRIP_CELLS // min(width, _TILE))):
            for key, part in _by_key(batch, keyed):
                z = _block(part, width, augment, sparse)
                cut = [np.ascontiguousarray(z[:, lo : lo + _TILE]).tobytes() for lo in range(0, z.shape[1], _TILE)]
                chunk += 1
                for r in range(len(cut)):
                    rows = [(key, r, c, chunk % salts, len(z), cut[r], cut[c] if c > r else b"") for c in range(r, len(cut))]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    for row in rows:
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in _STRIPS.split(", ")])

    return run


_ROWS = "key string, i int, first int, cells binary"


def _rows_of_tile(key, r: int, c: int, total: np.ndarray, tile: int) -> pa.RecordBatch:
    rows = np.flatnonzero(total.any(axis=1))
    first = np.where(r == c, rows, 0)
    cells = [total[i, j:].tobytes() for i, j in zip(rows, first)]
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * len(rows), pa.string()), pa.array(rows + r * tile, pa.int32()), pa.array(first + c * tile, pa.int32()), pa.array(cells, pa.binary())],
        ["key", "i", "first", "cells"],
    )


def _held_cells(width: int) -> int:
    """Cells of the tiles of the upper triangle."""
    sides = [min(_TILE, width - lo) for lo in range(0, width, _TILE)]
    return sum(a * b for r, a in enumerate(sides) for b in sides[r:])


def _held_tiles(width: int, augment: Callable | None, keyed: bool, sparse: bool):
    """One task's sums of all tiles, as rows; they leave early only if keys are so many that their tiles exceed the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit():
            for at in list(held):
                yield _rows_of_tile(*at, held.pop(at), _TILE)

        for batch in _buffers(batches, max(1, _STRIP_CELLS // min(width, _TILE))):
            for key, part in _by_key(batch, keyed):
                z = _block(part, width, augment, sparse)
                if held and (key, 0, 0) not in held and sum(t.size for t in held.values()) + _held_cells(z.shape[1]) > 3 * _MAX_CELLS // 2:
                    yield from emit()
                cut = [z[:, lo : lo + _TILE] for lo in range(0, z.shape[1], _TILE)]
                for r in range(len(cut)):
                    for c in range(r, len(cut)):
                        product = cut[r].T @ cut[c]
                        if (key, r, c) in held:
                            held[key, r, c] += product
                        else:
                            held[key, r, c] = product
        yield from emit()

    return run


def _tile_rows(tile: int):
    """The rows of one tile after the other; strips arrive by tile and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def flush():
            key, r, c, _ = at
            yield _rows_of_tile(key, r, c, total, tile)

        for batch in batches:
            for key, r, c, salt, n, one, two in zip(*(x.to_pylist() for x in batch.columns)):
                left = np.frombuffer(one).reshape(n, -1)
                product = left.T @ (np.frombuffer(two).reshape(n, -1) if c > r else left)
                if (key, r, c, salt) == at:
                    total += product
                    continue
                if at is not None:
                    yield from flush()
                at, total = (key, r, c, salt), product
        if at is not None:
            yield from flush()

    return run


def _row_sums(keyed: bool):
    """Cells of rows whose parts of all salts arrive one after the other; zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def flush():
            key, i, first = at
            some = np.flatnonzero(total)
            return _cells(key, np.full(len(some), i), some + first, total[some], keyed)

        for batch in batches:
            for key, i, first, cells in zip(*(x.to_pylist() for x in batch.columns)):
                if (key, i, first) == at:
                    total = total + np.frombuffer(cells)
                    continue
                if at is not None:
                    yield flush()
                at, total = (key, i, first), np.frombuffer(cells)
        if at is not None:
            yield flush()

    return run


def _tiled_sums(columns: DataFrame, width: int, augment: Callable | None, keyed: bool, sparse: bool, schema: str) -> DataFrame:
    tile, row = ["key", "r", "c", "salt"], ["key", "i", "first"]
    if _held_cells(width) <= 3 * _MAX_CELLS // 2:
        rows = columns.mapInArrow(_held_tiles(width, augment, keyed, sparse), _ROWS)
    else:
        tiles = -(-width // _TILE)
        cores = columns.sparkSession.sparkContext.defaultParallelism
        salts = max(1, 2 * cores // (tiles * (tiles + 1) // 2), -(-columns.count() // _SALT_ROWS))
        strips = columns.mapInArrow(_strips(width, augment, keyed, sparse, salts), _STRIPS)
        rows = strips.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tile_rows(_TILE), _ROWS)
    return rows.repartition(*row).sortWithinPartitions(*row).mapInArrow(_row_sums(keyed), schema)


def outer_parts(
    df: DataFrame, vector: str, width: int, key: str | None = None, augment=None, sparse: bool = False
) -> tuple[DataFrame, bool]:
    """``([key,] i, j, s)`` with i <= j, to be added up by cell, and whether every cell comes once already."""
    keyed = key is not None
    columns = df.select(*([F.col(key).cast("string").alias("key")] if keyed else []), F.col(vector).alias("v"))
    schema = ("key string, " if keyed else "") + "i int, j int, s double"
    small_batches(df.sparkSession)
    if width * width <= _MAX_CELLS:
        return columns.mapInArrow(_whole_sums(width, augment, keyed, sparse), schema), False
    if not sparse:
        return _tiled_sums(columns, width, augment, keyed, False, schema), True
    # read three times, so what it takes to gather the entries of a row is done once
    path = scratch_path(df.sparkSession, "rows")
    columns.write.parquet(path)
    columns = df.sparkSession.read.schema(columns.schema).parquet(path)
    heavy = _SPARSE_COST * F.size("v").cast("double") * F.size("v") > float(width) * width
    light = columns.where(~heavy).mapInArrow(_light_sums(width, keyed), schema)
    if columns.where(heavy).isEmpty():
        return light, False
    return light.unionByName(_tiled_sums(columns.where(heavy), width, augment, keyed, True, schema)), False


def outer_sums(
    df: DataFrame, vector: str, width: int, key: str | None = None, augment=None, sparse: bool = False
) -> DataFrame:
    """``([key,] i, j, s)`` with i <= j: the upper triangle of Σ v v', without zeros.

    ``vector`` is an array of ``width`` numbers or, if ``sparse``, an array of
    (position, value) structs.  ``augment`` maps a (rows x width) block to the
    block actually multiplied.
    """
    parts, once = outer_parts(df, vector, width, key, augment, sparse)
    return parts if once else parts.groupBy(*(["key"] if key else []), "i", "j").agg(F.sum("s").alias("s")).where("s <> 0")
