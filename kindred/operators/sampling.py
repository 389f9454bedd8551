"""Seeded samples and splits that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MODULUS = 1 << 31


def seeded_key(id_column: Column, seed: int = 0) -> Column:
    """A number in [0, 2^31) that shuffles ids; the same on any engine, and unrelated for other seeds."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_column.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % _MODULUS


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement; each task keeps its own n smallest keys only."""
    return df.orderBy(seeded_key(F.col(id_column), seed), id_column).limit(n)


def stratified_split(
    df: DataFrame, label: str, id_column: str, fraction: float, seed: int = 0, bins: int = 4096
) -> DataFrame:
    """Add ``part``: 'train' for ``round(n fraction)`` rows of every class, else 'test'.

    Rows are counted per (class, key bin); only the bin in which the class's
    quota ends has to be sorted.  A class may thus hold any share of the rows.
    """
    key = seeded_key(F.col(id_column), seed)
    rows = df.withColumn("_key", key).withColumn("_bin", F.floor(F.col("_key") / (_MODULUS // bins)).cast("int"))
    counts = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    plan = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_left", F.floor(F.sum("_n").over(whole) * fraction + 0.5) - F.col("_before"))
        .select(label, "_bin", "_n", "_left")
    )
    joined = rows.join(plan, [label, "_bin"])
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    inside = F.when(F.col("_left") > 0, "train").otherwise("test")
    order = Window.partitionBy(label, "_bin").orderBy("_key", id_column)
    split = F.when(F.row_number().over(order) <= F.col("_left"), "train").otherwise("test")
    return (
        joined.where(~edge)
        .withColumn("part", inside)
        .unionByName(joined.where(edge).withColumn("part", split))
        .drop("_key", "_bin", "_n", "_left")
    )


def epoch_metrics(batches: DataFrame, key: str) -> DataFrame:
    """``(<key>, mean_loss, accuracy)`` of rows ``(loss, n, pred, target)``; losses weigh by n."""
    return batches.groupBy(key).agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean_loss"),
        F.avg((F.col("pred") == F.col("target")).cast("double")).alias("accuracy"),
    )
