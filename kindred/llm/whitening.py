"""Embedding whitening: principal components by QDWH spectral divide and conquer, applied to every vector.

Entries are put on a grid, x = floor(scale * c) + offset, so that equal vectors, counts and sums are exact. The fit list
has each distinct x once: Spark removes repeats (counted map-side, so a vector that a third of all rows
share is no hot key), and the list is written once. Three light passes over it follow: exact sums, centred second moments, and
the covariance of the whitened list as a check. A task ships one matrix of the embedding's dimension, its rows are
added up by row number, and the driver holds one matrix of dimension x dimension numbers whatever the number of rows; there
it is decomposed (:mod:`kindred.llm.spectral`). The components go to all tasks, which whiten every row in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import Batches, columns_ddl, in_arrow, stored, without
from kindred.llm.spectral import leading_eigenvectors

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: entries of larger size, after scaling, are taken as this
LARGEST = float(1 << 40)
#: vectors of an Arrow batch handled at a time
_ROWS = 4096


def on_grid(df: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, name: str = "_x") -> DataFrame:
    """The rows with a whole vector, and the grid vector as a column; rows with a null vector, an empty one, or a null or non-finite entry go."""
    c = F.col(f"`{vector}`")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(offset).cast("long"))
    return without(df, name).where(c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False))).withColumn(name, x)


def _blocks(batches: Batches, column: str, width: int):
    """Each batch in slices, with the grid vectors as rows of an array."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's matrix, one row each, to be added up by row number in the order of tasks."""
    n = len(total)
    task = TaskContext.get().partitionId()
    columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, task, np.int32)), pa.array([r.tobytes() for r in total], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["i", "task", "cells"])


def _sum_of_tasks(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices; only one matrix reaches the driver."""

    def merge(batches: Batches) -> Batches:
        at, total = None, None
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                row = np.frombuffer(cells)
                if i == at:
                    total = total + row
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "cells"])
                at, total = i, row
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "cells"])

    out = np.zeros(shape)
    for i, cells in in_arrow(parts.repartition("i").sortWithinPartitions("i", "task"), merge, "i int, cells binary").collect():
        out[i] = np.frombuffer(cells)
    return out


@dataclass
class Whitening:
    """What was fitted. ``components`` has unit eigenvectors as columns; ``eigenvalues`` fall."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, without first rounding the mean's whole part."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it exceeds 64 bits."""
        sums = np.array(self.sums, dtype=object)
        top = self.n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, self.sums), default=0)
        if top < 1 << 62:
            gap = self.n * x - sums.astype(np.int64)
            most = int(np.abs(gap).max()) if gap.size else 0
            if most * most * max(self.width, 1) < 1 << 63:
                return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - sums
        return [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1).tolist()]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """Learn from each distinct grid vector once.

    Vectors must have one length; where they don't, the commonest among distinct vectors counts (the longer one of
    ties) and others are left out. Directions without variance (eigenvalue at most dimension x machine precision of the
    largest) are no components, so there may be fewer than asked for, and none for an empty table or a single vector.
    """
    listed = stored(on_grid(df, vector, scale, offset).select("_x").distinct(), "fit-list", compression="zstd")
    lengths = listed.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    d, n = int(lengths["d"]), int(lengths["count"])
    listed = listed.where(F.size("_x") == d)

    def sums(batches: Batches) -> Batches:
        total = [0] * d
        for _, x in _blocks(batches, "_x", d):
            # a block's sums fit 64 bits, a task's need not
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    added = in_arrow(listed, sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    model = Whitening(n, [int(r["s"]) for r in sorted(added)], np.zeros((d, 0)), np.zeros(0), 0.0)

    def moments(batches: Batches) -> Batches:
        total = np.zeros((d, d))
        for _, x in _blocks(batches, "_x", d):
            c = model.centred(x)
            total += c.T @ c
        yield _matrix_rows(total)

    covariance = _sum_of_tasks(in_arrow(listed, moments, "i int, task int, cells binary"), (d, d)) / n
    values, vectors = leading_eigenvectors(covariance, components)
    keep = values > d * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    fitted = Whitening(n, model.sums, vectors[:, keep], values[keep], float(np.trace(covariance)))
    k = int(keep.sum())
    if not k:
        return fitted

    def check(batches: Batches) -> Batches:
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, "_x", d):
            w = fitted.apply(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield _matrix_rows(total)

    total = _sum_of_tasks(in_arrow(listed, check, "i int, task int, cells binary"), (k + 1, k)) / n
    # whitened vectors are centred up to rounding; what is left of their mean is taken out
    fitted.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return fitted


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """All columns of the rows with a whole vector of the fitted length, ``_deviation`` (long) and ``_whitened`` (array of doubles).

    Repeated rows get equal results each. Columns of the input named ``_x``, ``_deviation`` or ``_whitened`` are replaced.
    """
    docs = without(df, "_x", "_deviation", "_whitened")
    rows = on_grid(docs, vector, scale, offset).where(F.size("_x") == model.width)
    names, d, k = docs.columns, model.width, len(model.eigenvalues)

    def apply(batches: Batches) -> Batches:
        for part, x in _blocks(batches, "_x", d):
            flat = pa.array(model.apply(x).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k), flat)
            own = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(model.deviations(x), pa.int64()), lists], [*names, "_deviation", "_whitened"])

    return in_arrow(rows, apply, f"{columns_ddl(docs)}, _deviation long, _whitened array<double>")
