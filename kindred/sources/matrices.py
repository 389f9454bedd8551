"""Read stacks of square matrices from array files.

``.npy``/``.np`` hold one (count, dim, dim) array, ``.npz`` several arrays, and
``.pkl``/``.pickle`` an array, a list of arrays, or a list of dicts of arrays.
One task parses one file and emits one row per matrix; large collections belong
into Parquet, which is read with ``spark.read.parquet``.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The accepted file name extensions.
ARRAY_FILES = (".np", ".npy", ".npz")
PICKLE_FILES = (".pkl", ".pickle")


class _ArraysOnly(pickle.Unpickler):
    """Pickles may only rebuild numpy arrays and plain containers."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in {"ndarray", "dtype", "_reconstruct", "_frombuffer", "scalar"}:
            return super().find_class(module, name)
        if (module, name) == ("collections", "OrderedDict"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a matrix file")


def _matrices(name: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    if name.endswith(PICKLE_FILES):
        loaded = _ArraysOnly(io.BytesIO(content)).load()
    else:
        loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if hasattr(loaded, "files"):
        loaded = [{key: loaded[key]} for key in loaded.files]
    elif isinstance(loaded, dict):
        loaded = [loaded]
    if isinstance(loaded, list) and loaded and isinstance(loaded[0], dict):
        for position, entry in enumerate(loaded):
            for key, value in entry.items():
                stack = np.asarray(value)
                for extra, matrix in enumerate(stack.reshape(-1, *stack.shape[-2:])):
                    label = key if len(loaded) == 1 else f"{position}/{key}"
                    yield (label if stack.ndim == 2 else f"{label}/{extra:06d}"), matrix
        return
    stack = np.asarray(loaded)
    for position, matrix in enumerate(stack.reshape(-1, *stack.shape[-2:])):
        yield f"{position:06d}", matrix


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``(source, layer, ord, dim, m)``: the matrices of one file or of a folder.

    ``source`` is the file name without extension; it names later results.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                name = file.rsplit("/", 1)[-1]
                if not name.endswith(ARRAY_FILES + PICKLE_FILES):
                    raise ValueError(f"expected one of {ARRAY_FILES + PICKLE_FILES}, got {name!r}")
                for position, (layer, matrix) in enumerate(_matrices(name, content)):
                    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
                        raise ValueError(f"{name}: matrix {layer} has shape {matrix.shape}")
                    row = (name.rsplit(".", 1)[0], layer, position, len(matrix), matrix.astype(float).ravel())
                    yield pd.DataFrame([row], columns=["source", "layer", "ord", "dim", "m"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "source string, layer string, ord int, dim int, m array<double>")


def cells(matrices: DataFrame) -> DataFrame:
    """Matrix rows as Gram cells ``(layer, i, j, v)``; the layer name includes the source."""
    layer = F.concat_ws(":", "source", "layer")
    return matrices.select(layer.alias("layer"), "dim", F.posexplode("m").alias("p", "v")).select(
        "layer", F.expr("cast(p div dim as int)").alias("i"), (F.col("p") % F.col("dim")).alias("j"), "v"
    )
