"""Exact ranks and quantiles of groups far larger than one task.

Values are cut into bins per group: between knots, which are approximate quantiles, into
equal widths, and every knot is a bin of its own. So bins follow the distribution, whatever outliers there
are. Counting the bins takes only map-side partial sums; the counts give each bin's first rank, so that
sorting is needed inside a bin only and the bins are spread over all tasks. A bin that holds one value only
is ranked from its count: copies of one value never have to meet in one task. The knots only
balance the work; the ranks are exact with any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import BROADCAST_LIMIT

BINS = 4096
#: knots of a group
KNOTS = 64


def _bin(value: Column, knots: Column, width: int) -> Column:
    at = F.size(F.filter(knots, lambda x: x <= value))
    low, high = F.get(knots, at - 1), F.get(knots, at)
    part = F.least(F.floor((value - low) / (high - low) * width), F.lit(width - 1))
    inner = 1 + F.coalesce(F.greatest(part, F.lit(0)), F.lit(0))
    return (at * (width + 1) + F.when(value == low, 0).otherwise(inner)).cast("int")


def _binned(df: DataFrame, keys: list[str], value: str, bins: int, groups: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows with their bin, and per bin its count, first rank and extremes.

    The bin table has about ``groups * (bins + KNOTS)`` rows.  It is broadcast if
    the caller states the number of groups and that product is small, else
    Spark chooses the join from the measured size.
    """
    small = groups is not None and groups * (bins + 2 * KNOTS) * 64 <= BROADCAST_LIMIT
    hint = F.broadcast if small else (lambda d: d)
    steps = F.array(*[F.lit(k / KNOTS) for k in range(KNOTS + 1)])
    knots = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, steps, F.lit(2000))).alias("_knots"))
    rows = (
        df.join(hint(knots), keys)
        .withColumn("_bin", _bin(F.col(value), F.col("_knots"), max(1, bins // KNOTS)))
        .drop("_knots")
    )
    stats = rows.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return rows, hint(stats.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))


def average_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str = "rank",
    bins: int = BINS,
    groups: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of ``value`` within ``keys``; ties get their mean rank."""
    rows, stats = _binned(df, keys, value, bins, groups)
    single = F.col("_min") == F.col("_max")
    # rows of a one-valued bin stay spread out: their rank needs no sorting
    joined = (
        rows.join(stats, [*keys, "_bin"])
        .withColumn("_part", F.when(single, F.spark_partition_id()).otherwise(-1))
        .withColumn("_base", F.col("_before") + F.when(single, (F.col("_n") + 1) / 2).otherwise(0.0))
        .drop("_n", "_min", "_max", "_before")
    )
    order = Window.partitionBy(*keys, "_bin", "_part").orderBy(value)
    # first and last rank among equals; both come from one sorted pass
    first, last = F.rank().over(order), F.count(F.lit(1)).over(order)
    ranked = joined.withColumn("_first", first).withColumn("_last", last)
    rank = F.col("_base") + F.when(F.col("_part") < 0, (F.col("_first") + F.col("_last")) / 2).otherwise(0.0)
    return ranked.withColumn(out, rank).drop("_bin", "_part", "_base", "_first", "_last")


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = BINS, groups: int | None = None
) -> DataFrame:
    """One row per group: linearly interpolated quantiles named by ``probs``, and ``n``."""
    rows, stats = _binned(df, keys, value, bins, groups)
    total = stats.groupBy(*keys).agg(F.sum("_n").alias("n"))
    names = list(probs)
    wanted = (
        total.select(
            *keys,
            "n",
            F.inline(F.array(*[F.struct(F.lit(q).alias("_q"), F.lit(float(p)).alias("_p")) for q, p in probs.items()])),
        )
        .withColumn("_h", (F.col("n") - 1) * F.col("_p"))
        .select("*", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_pos"))
    )
    located = wanted.join(stats, keys).where(
        (F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_n"))
    )
    plain = located.where("_min = _max").select(*keys, "n", "_q", "_h", "_pos", F.col("_min").alias("_v"))
    mixed_bins = located.where("_min < _max").select(*keys, "_bin", "_before").distinct()
    ordered = rows.join(mixed_bins, [*keys, "_bin"]).select(
        *keys,
        (F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value)) - 1).alias("_pos"),
        F.col(value).alias("_v"),
    )
    sought = located.where("_min < _max").select(*keys, "n", "_q", "_h", "_pos")
    points = plain.unionByName(sought.join(ordered, [*keys, "_pos"]).select(*plain.columns))
    weight = F.when(F.col("_pos") == F.floor("_h"), 1 - (F.col("_h") - F.floor("_h"))).otherwise(
        F.col("_h") - F.floor("_h")
    )
    parts = points.groupBy(*keys, "n", "_q").agg(F.sum(weight * F.col("_v")).alias("_v"))
    return parts.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_q") == q, F.col("_v"))).alias(q) for q in names]
    )
