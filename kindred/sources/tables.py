"""Sinks and resumable result tables, all plain partitioned Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kindred.operators.gram import gram_from_features, layer_pairs, materialize
from kindred.operators.gram_compare import compare_gram
from kindred.operators.layer_compare import compare_layers
from kindred.plans.registry import per_measure
from kindred.sources.activations import Layers


def write_activations(layers: Layers, path: str, first: bool = True, compact: bool = False) -> None:
    """Store ``(layer, stim, features)`` partitioned by layer.

    The first batch creates the table and fails if there is one; later batches
    are appended.  Every task writes a file per layer; with many layers or
    small tasks, ``compact`` spends a shuffle on evenly sized files instead.
    """
    rows = layers.long()
    if compact:
        # splits a large layer over several tasks, unlike a repartition by layer
        rows = rows.hint("rebalance", F.col("layer"))
    rows.write.mode("errorifexists" if first else "append").partitionBy("layer").parquet(path)


def read_activations(spark: SparkSession, path: str, layers: str | list[str] | None = None) -> DataFrame:
    """Stored activations; naming layers reads their partitions only."""
    acts = spark.read.schema("stim long, features array<double>, layer string").parquet(path)
    if layers is not None:
        acts = acts.where(F.col("layer").isin([layers] if isinstance(layers, str) else list(layers)))
    return acts.select("layer", "stim", "features")


def write_grams(spark: SparkSession, acts_path: str, out_path: str, layers: str | list[str] | None = None) -> None:
    """Gram matrices of stored activations, one partition per layer."""
    long = read_activations(spark, acts_path, layers).select("layer", "stim", F.posexplode("features").alias("feat", "v"))
    gram_from_features(long).write.mode("errorifexists").partitionBy("layer").parquet(out_path)


def remove(path: str) -> None:
    """Remove a written table, on any file system that pyarrow knows."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.delete_dir(at)


def gram_job(
    batches: Layers | Iterable[Layers], acts_path: str, out_path: str, layers: str | list[str] | None = None, keep_activations: bool = True
) -> DataFrame:
    """The whole way from layer functions to stored Gram matrices: ``(layer, i, j, v)``, read back from ``out_path``.

    Activations of each batch of stimuli are appended at ``acts_path``; the matrices of the named layers (all, if none are named) are formed from
    what is stored there. Without ``keep_activations`` that table is removed once the matrices are written; if a step fails
    it stays.
    """
    first, spark = True, None
    for batch in [batches] if isinstance(batches, Layers) else batches:
        write_activations(batch, acts_path, first)
        first, spark = False, batch.df.sparkSession
    if spark is None:
        raise ValueError("no stimuli")
    write_grams(spark, acts_path, out_path, layers)
    if not keep_activations:
        remove(acts_path)
    return read_grams(spark, out_path)


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i int, j int, v double, layer string").parquet(path).select("layer", "i", "j", "v")


def run_key(source: str, conditioning: dict, options: dict) -> str:
    """Identifies results by everything they depend on, not by file name alone."""
    text = json.dumps([source, conditioning, options], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def read_distances(spark: SparkSession, path: str) -> DataFrame | None:
    """The result table, or None if nothing has been stored yet."""
    try:
        stored = spark.read.schema("a string, b string, value double, run string, measure string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # NULL values (undefined measures) are results as well: they are not queued again
    return stored.dropDuplicates(["run", "measure", "a", "b"])


def all_pairs(source: Layers | DataFrame) -> DataFrame:
    """``(a, b)`` for every unordered pair of layers."""
    if isinstance(source, Layers):
        names = source.names
        spark = source.df.sparkSession
        rows = spark.range(len(names)).select(F.get(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int")).alias("a"), "id")
        later = F.slice(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int") + 2, len(names))
        return rows.select("a", F.explode(later).alias("b"))
    return layer_pairs(source)


def pending(stored: DataFrame | None, pairs: DataFrame, run: str, measures: list[str]) -> DataFrame:
    """``(measure, a, b)`` not yet in the result table."""
    wanted = pairs.select(F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"), "a", "b")
    if stored is None:
        return wanted
    return wanted.join(stored.where(F.col("run") == run), ["measure", "a", "b"], "left_anti")


def compare_to_table(
    source: Layers | DataFrame,
    source_name: str,
    path: str,
    measures,
    b=0.01,
    noise_var=None,
    normalize=True,
    **options,
) -> None:
    """Compute what is missing from the result table at ``path`` and append it.

    ``measures`` may be one name or several; ``b``, ``noise_var`` and
    ``normalize`` apply to all of them or are lists with one entry each.
    Measures with equal conditioning share one job. What each pair lacks is a table, kept through the comparison, so
    that a pair is only evaluated by the measures it lacks; only names of layers and measures reach the driver.
    Results are partitioned by run and measure; an interrupted job commits nothing and is simply rerun, jobs before it stay.
    """
    groups: dict[str, tuple[dict, list[str]]] = {}
    for measure, conditioning in per_measure(measures, b, noise_var, normalize):
        run = run_key(source_name, conditioning, options)
        groups.setdefault(run, (conditioning, []))[1].append(measure.name)
    layers = source if isinstance(source, Layers) else None
    spark = (layers.df if layers else source).sparkSession
    for run, (conditioning, names) in groups.items():
        todo = materialize(lacking(pending(read_distances(spark, path), all_pairs(source), run, names)), "pending")
        due = _distinct(todo.select(F.explode("measures")))
        if not due:
            continue
        if layers:
            used = _distinct(todo.select(F.explode(F.array("a", "b"))))
            found = compare_layers(layers.select([n for n in layers.names if n in used]), [n for n in names if n in due], todo=todo, **conditioning, **options)
        else:
            found = compare_gram(source, [n for n in names if n in due], todo=todo, **conditioning, **options)
        append_distances(found, run, path)


def lacking(todo: DataFrame) -> DataFrame:
    """``(a, b, measures)`` of ``todo (measure, a, b)``."""
    return todo.groupBy("a", "b").agg(F.sort_array(F.collect_set("measure")).alias("measures"))


def append_distances(found: DataFrame, run: str, path: str) -> None:
    found.select("a", "b", "value", F.lit(run).alias("run"), "measure").write.mode("append").partitionBy("run", "measure").parquet(path)


def _distinct(names: DataFrame) -> set[str]:
    """The distinct values of a column of names of layers or measures."""
    return set(names.agg(F.collect_set(names.columns[0])).first()[0])
