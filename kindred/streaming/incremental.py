"""Structured Streaming forms of the incremental steps.

Batches of activations are appended to a table, trial statistics are kept up to
date, and new matrices trigger only the comparisons they make possible.  None
of them has event-time semantics, so there are no watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.gram import condition, pack, well_formed
from kindred.operators.gram_compare import compare_packed
from kindred.operators.reliability import cell_stats
from kindred.plans.registry import Params, per_measure
from kindred.sources.activations import Layers
from kindred.sources.tables import append_distances, lacking, pending, read_distances, run_key


def append_activations(layers: Layers, path: str, checkpoint: str) -> StreamingQuery:
    """Append the activations of newly arrived stimuli, one micro-batch at a time."""
    return (
        layers.long()
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("layer")
        .trigger(availableNow=True)
        .start()
    )


def trial_statistics(trials: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``(voxel, stim, n, mean, ss)`` of all trials so far as state of the stream, and a snapshot of it at ``path``.

    Counts, means and squared deviations merge exactly, so the state store holds one row per voxel and stimulus, whatever the
    number of micro-batches. Snapshots take turns in two folders; a reader takes the later finished one, and a replayed batch
    overwrites its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/turn={batch_id % 2}")

    return (
        cell_stats(trials)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def merged_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of the last snapshot written by :func:`trial_statistics`."""
    kept = spark.read.parquet(path)
    last = kept.agg(F.max("batch").alias("last"))
    return kept.join(F.broadcast(last), F.col("batch") == F.col("last")).select("voxel", "stim", "n", "mean", "ss")


def compare_arrivals(
    grams: DataFrame, gram_path: str, result_path: str, checkpoint: str, name: str, measures, b=0.01, noise_var=None, normalize=True, **options
) -> StreamingQuery:
    """Store arriving Gram cells, and compare each new matrix with all stored ones and the other new ones.

    Arriving matrices are conditioned once and kept as packed rows, one per layer, below ``gram_path``-packed; a batch reads the
    packed rows of its partners and no cells. Only pairs with a new matrix are formed; those that a failed attempt of the same
    batch has stored already are left out. A layer's cells must arrive in one batch.
    """
    groups: dict[str, tuple[dict, list]] = {}
    for measure, conditioning in per_measure(measures, b, noise_var, normalize):
        groups.setdefault(run_key(name, conditioning, options), (conditioning, []))[1].append(measure)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{gram_path}/batch={batch_id}")
        cells = spark.read.parquet(f"{gram_path}/batch={batch_id}").select("layer", "i", "j", "v")
        for run, (conditioning, found) in groups.items():
            params = Params(**conditioning, **options)
            params.check(found)
            folder = f"{gram_path}-packed/run={run}"
            pack(condition(well_formed(cells), params.noise_var, params.b, params.normalize)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
            packed = spark.read.schema("layer string, dim int, m array<double>, batch long").parquet(folder).where(F.col("batch") <= batch_id)
            new, all_ = (packed.where(F.col("batch") == batch_id).select(F.col("layer").alias("x")), packed.select(F.col("layer").alias("y"), "batch"))
            met = new.join(all_, (F.col("x") < F.col("y")) | (F.col("batch") < batch_id)).where("x <> y")
            pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            todo = lacking(pending(read_distances(spark, result_path), pairs, run, [m.name for m in found]))
            append_distances(compare_packed(packed.select("layer", "dim", "m"), todo, found, params), run, result_path)

    return (
        grams.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    """Run an ``availableNow`` query until its input is used up; raise its error, if any."""
    start().awaitTermination()
