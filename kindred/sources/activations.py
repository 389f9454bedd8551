"""Layers of a representation, expressed as array columns over an input table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layers:
    """A wide activation table: one row per stimulus, one array column per layer.

    Keeping the layers of a stimulus in one row means that no comparison ever
    has to shuffle the stimuli to bring two layers together.
    """

    df: DataFrame
    stim: str
    columns: Mapping[str, Column]
    widths: Mapping[str, int]
    #: all features in layer order, if the table has them as one column
    vector: Column | None = None

    @property
    def names(self) -> list[str]:
        """Layer catalogue, in definition order."""
        return list(self.columns)

    def select(self, names: str | list[str]) -> "Layers":
        """Keep the named layers; the others are pruned from the scan."""
        wanted = [names] if isinstance(names, str) else list(names)
        unknown = [n for n in wanted if n not in self.columns]
        if unknown:
            raise KeyError(f"unknown layers {unknown}")
        return Layers(
            self.df, self.stim, {n: self.columns[n] for n in wanted}, {n: self.widths[n] for n in wanted}
        )

    def concat(self, other: "Layers") -> "Layers":
        """Both families' layers over the stimuli they share."""
        clash = set(self.names) & set(other.names)
        if clash:
            raise ValueError(f"layer names used twice: {sorted(clash)}")
        mine = self.df.select(F.col(self.stim).alias("stim"), *[c.alias(n) for n, c in self.columns.items()])
        theirs = other.df.select(F.col(other.stim).alias("stim"), *[c.alias(n) for n, c in other.columns.items()])
        names = self.names + other.names
        return Layers(
            mine.join(theirs, "stim"),
            "stim",
            {n: F.col(f"`{n}`") for n in names},
            {**self.widths, **other.widths},
        )

    def wide(self) -> DataFrame:
        """``(stim, x)`` with x the layers' features one after the other.

        x may hold single precision numbers; whoever computes with it widens them.
        """
        if self.vector is not None:
            return self.df.select(F.col(self.stim).alias("stim"), self.vector.alias("x"))
        parts = [c.cast("array<double>") for c in self.columns.values()]
        return self.df.select(F.col(self.stim).alias("stim"), F.concat(*parts).alias("x"))

    def long(self) -> DataFrame:
        """``(layer, stim, features)``: one row per layer and stimulus."""
        entries = [
            F.struct(F.lit(n).alias("layer"), c.cast("array<double>").alias("features"))
            for n, c in self.columns.items()
        ]
        return self.df.select(F.col(self.stim).alias("stim"), F.inline(F.array(*entries))).select(
            "layer", "stim", "features"
        )


def extract(
    df: DataFrame,
    stim: str,
    layers: Mapping[str, Column],
    keep: str | list[str] | None = None,
    output: tuple[str, Column] | None = None,
    widths: Mapping[str, int] | None = None,
) -> Layers:
    """Apply feature functions to an input table.

    ``layers`` maps a layer name to a column expression giving its features:
    a scalar, an array, or nested arrays (flattened per stimulus).  ``output``
    optionally adds the network output as one more layer.  Widths are read off
    the first row unless given; every other row is checked when it is used.
    """
    columns = dict(layers)
    if keep is not None:
        wanted = [keep] if isinstance(keep, str) else list(keep)
        columns = {n: columns[n] for n in wanted}
    if output is not None:
        columns[output[0]] = output[1]
    columns = {n: _flat(df, c) for n, c in columns.items()}
    if widths is None:
        first = df.select(*[F.size(c).alias(f"w{i}") for i, c in enumerate(columns.values())]).first()
        if first is None:
            raise ValueError("no stimuli")
        widths = dict(zip(columns, first))
    return Layers(df, stim, columns, {n: int(widths[n]) for n in columns})


def _flat(df: DataFrame, column: Column) -> Column:
    dtype = df.select(column.alias("c")).schema["c"].dataType
    if dtype.typeName() != "array":
        return F.array(column.cast("double"))
    while dtype.elementType.typeName() == "array":
        column, dtype = F.flatten(column), dtype.elementType
    return column


def slices(df: DataFrame, stim: str, vector: str, width: int, total: int, prefix: str = "slice") -> Layers:
    """Cut one vector column into consecutive layers of ``width`` features."""
    names = [f"{prefix}_{i:02d}" for i in range(total // width)]
    columns = {n: F.slice(F.col(vector), i * width + 1, width) for i, n in enumerate(names)}
    whole = F.col(vector) if total % width == 0 else None
    return Layers(df, stim, columns, {n: width for n in names}, whole)


def features_long(layers: Layers) -> DataFrame:
    """``(layer, stim, feat, v)``."""
    return layers.long().select("layer", "stim", F.posexplode("features").alias("feat", "v"))


def catalog(layers: Layers) -> DataFrame:
    """``(layer, n_stim, n_feat)``, checking that a layer's width is constant."""
    sizes = layers.long().select("layer", F.size("features").alias("w"))
    return sizes.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_stim"),
        F.when(F.min("w") == F.max("w"), F.max("w"))
        .otherwise(F.raise_error(F.lit("uneven feature counts")).cast("int"))
        .alias("n_feat"),
    )


def coverage(acts: DataFrame, stimuli: DataFrame) -> DataFrame:
    """``(layer, n_rows, n_stim, complete)``: does a layer hold every stimulus exactly once?

    ``acts (layer, stim, ...)`` is compared with the wanted ``stimuli (stim)``.
    """
    wanted = stimuli.select("stim", F.lit(1).alias("known"))
    total = wanted.agg(F.count("known").alias("total"))
    per_stim = acts.join(wanted, "stim", "left").groupBy("layer", "stim").agg(F.count(F.lit(1)).alias("c"), F.max("known").alias("known"))
    per_layer = per_stim.groupBy("layer").agg(
        F.sum("c").alias("n_rows"), F.count("known").alias("n_stim"), F.max("c").alias("most"), F.count_if(F.col("known").isNull()).alias("strange")
    )
    complete = (F.col("n_stim") == F.col("total")) & (F.col("most") == 1) & (F.col("strange") == 0)
    return per_layer.join(F.broadcast(total)).select("layer", "n_rows", "n_stim", complete.alias("complete"))


def between(df: DataFrame, keys: list[str], order: str, name: str, contains: str, before: str, after: str) -> DataFrame:
    """Entries of a numbered list whose name, predecessor's and successor's names contain given texts.

    The neighbours are found by their number (``order`` counts without gaps
    within ``keys``), so a long list is spread over tasks like any other join.
    """
    entry = df.select(*keys, order, name).where(F.contains(F.col(name), F.lit(contains)))
    last = df.where(F.contains(F.col(name), F.lit(before))).select(*keys, (F.col(order) + 1).alias(order))
    following = df.where(F.contains(F.col(name), F.lit(after))).select(*keys, (F.col(order) - 1).alias(order))
    return entry.join(last, [*keys, order], "left_semi").join(following, [*keys, order], "left_semi")


def mock_inputs(spark: SparkSession, n: int, shape: tuple[int, ...], seed: int = 42) -> DataFrame:
    """``(stim, x)`` with normal random vectors of the given shape, flattened."""
    width = prod(shape)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stims = batch.column(0)
            rows = [np.random.default_rng((seed, k)).standard_normal(width) for k in stims.to_pylist()]
            ends = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            yield pa.RecordBatch.from_arrays([stims, pa.ListArray.from_arrays(ends, values)], ["stim", "x"])

    return spark.range(n).select(F.col("id").alias("stim")).mapInArrow(draw, "stim long, x array<double>")
