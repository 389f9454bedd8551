"""Noise, reliability and mean responses of channels from repeated trials.

Trials are ``(voxel, stim, trial, v)``.  Everything is derived from one grouped
pass that reduces them to ``(voxel, stim, n, mean, ss)``; the second grouping,
by voxel, only sees one row per voxel and stimulus, so a voxel with a third of
all trials costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.linalg import inverse_beta

#: trials per chunk when runs of equal stimuli are looked for
RUN_CHUNK = 1 << 20


def cell_stats(trials: DataFrame, group: str = "stim") -> DataFrame:
    """``(voxel, <group>, n, mean, ss)``; ss is the sum of squared deviations from the mean."""
    return trials.groupBy("voxel", group).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("ss")
    )


def run_lengths(trials: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """``(voxel, run, stim, n, mean, ss)``: consecutive trials of one stimulus, in trial order.

    The trial axis is cut into chunks.  Runs are numbered inside (voxel, chunk)
    and the numbers are shifted by a running total over the chunks; a run that
    crosses a border keeps one number.  No task sorts a whole voxel.
    """
    part = Window.partitionBy("voxel", "chunk").orderBy("trial")
    changed = F.coalesce((F.col("stim") != F.lag("stim").over(part)).cast("long"), F.lit(0))
    local = trials.withColumn("chunk", F.floor(F.col("trial") / chunk)).withColumn("changed", changed)
    numbered = local.withColumn("local", F.sum("changed").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy("voxel", "chunk", "local", "stim").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("ss")
    )
    # whole pieces, although only their stimulus is needed: then this branch and
    # the one below read the same columns and share the sorted exchange
    piece = F.struct("local", "stim", "n", "mean", "ss")
    borders = (
        pieces.groupBy("voxel", "chunk")
        .agg(F.min(piece).alias("first"), F.max(piece).alias("final"))
        .select(
            "voxel",
            "chunk",
            F.col("first.stim").alias("head"),
            F.col("final.stim").alias("tail"),
            F.col("final.local").alias("last"),
        )
    )
    chunks = Window.partitionBy("voxel").orderBy("chunk")
    opens = F.coalesce((F.col("head") != F.lag("tail").over(chunks)).cast("long"), F.lit(0))
    offsets = (
        borders.withColumn("opens", opens)
        .withColumn("before", F.coalesce(F.lag("last").over(chunks), F.lit(0)))
        .withColumn("shift", F.sum(F.col("opens") + F.col("before")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)))
        .select("voxel", "chunk", "shift")
    )
    runs = pieces.join(offsets, ["voxel", "chunk"]).withColumn("run", F.col("local") + F.col("shift"))
    return merge_stats(runs, ["voxel", "run", "stim"])


def merge_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the few ``(n, mean, ss)`` pieces of each key into one row."""
    pieces = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum("ss").alias("within"),
        F.collect_list(F.struct("n", F.col("mean").alias("m"))).alias("pieces"),
    )
    between = F.aggregate("pieces", F.lit(0.0), lambda acc, p: acc + p["n"] * F.pow(p["m"] - F.col("mean"), 2))
    return pieces.select(*keys, "n", "mean", (F.col("within") + between).alias("ss"))


def repetitions(stats: DataFrame) -> DataFrame:
    """``(voxel, n_groups, min_reps, max_reps, consistent)``: is every stimulus repeated equally often?"""
    return stats.groupBy("voxel").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("min_reps"),
        F.max("n").alias("max_reps"),
        (F.min("n") == F.max("n")).alias("consistent"),
    )


def _noise() -> Column:
    """Pooled within-group variance; groups of one count as trials but add no deviation."""
    spare = F.sum(F.col("n")) - F.count(F.lit(1))
    none = F.raise_error(F.lit("noise cannot be estimated: no stimulus is repeated")).cast("double")
    return F.when(spare > 0, F.sum("ss") / spare).otherwise(none)


def noise_estimation(stats: DataFrame) -> DataFrame:
    """``(voxel, noise_var)`` from the statistics per stimulus or per run."""
    return stats.groupBy("voxel").agg(_noise().alias("noise_var"))


def voxel_reliability(stats: DataFrame) -> DataFrame:
    """``(voxel, n, mean, noise_var, total_var, reliability)``.

    ``total_var`` (ddof 1) is pooled from the same statistics, so the trials
    are read once.  A constant voxel has no reliability (NULL).
    """
    # both branches read n, mean and ss, so that they share one exchange
    centre = stats.groupBy("voxel").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        _noise().alias("noise"),
    )
    # deviations from the voxel's mean, not a difference of large squares
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))
    pooled = (
        stats.join(centre, "voxel")
        .groupBy("voxel", F.col("total").alias("n"), F.col("grand").alias("mean"), F.col("noise").alias("noise_var"))
        .agg((F.sum("ss") + between).alias("spread"))
        .select("voxel", "n", "mean", "noise_var", (F.col("spread") / (F.col("n") - 1)).alias("total_var"))
    )
    ratio = F.when(F.col("total_var") > 0, 1 - F.col("noise_var") / F.col("total_var"))
    return pooled.withColumn("reliability", ratio)


def zscore(trials: DataFrame, facts: DataFrame) -> DataFrame:
    """Trials in units of their voxel's standard deviation (ddof 0); ``facts`` are those of :func:`voxel_reliability`.

    Voxels with more than a 200th of all trials are fewer than 200: they are sent to all tasks, and their trials are exchanged by a hash of
    stimulus and trial, so that such a voxel is no hot key. Trials of voxels without facts are left out.
    """
    sd = F.sqrt(F.col("total_var") * (F.col("n") - 1) / F.col("n"))
    params = facts.select("voxel", "n", F.struct(F.col("mean").alias("m"), F.when(sd > 0, sd).alias("sd")).alias("own"))
    # one row
    limit = F.broadcast(facts.agg((F.sum("n") / 200).alias("limit")))
    large = F.broadcast(params.crossJoin(limit).where("n > limit").select("voxel", F.col("own").alias("hot")))
    hot = F.col("hot").isNotNull()
    met = trials.select("voxel", "stim", "trial", "v").join(large, "voxel", "left").withColumns(
        {"key": F.when(~hot, F.col("voxel")), "part": F.when(hot, F.pmod(F.xxhash64("stim", "trial"), F.lit(256))).otherwise(0)}
    )
    rest = params.select(F.col("voxel").alias("key"), F.lit(0).cast("long").alias("part"), "own")
    use = F.coalesce("hot", "own")
    return met.join(rest, ["key", "part"], "left").where(use.isNotNull()).select("voxel", "stim", "trial", ((F.col("v") - use["m"]) / use["sd"]).alias("v"))


def zscore_stats(stats: DataFrame) -> DataFrame:
    """The statistics the z-scored trials would have, without touching the trials."""
    facts = voxel_reliability(stats)
    var = F.col("total_var") * (F.col("tn") - 1) / F.col("tn")
    params = facts.select("voxel", F.col("n").alias("tn"), F.col("mean").alias("m"), "total_var")
    joined = stats.join(params, "voxel").withColumn("var", F.when(var > 0, var))
    return joined.select(
        "voxel", "stim", "n", ((F.col("mean") - F.col("m")) / F.sqrt("var")).alias("mean"), (F.col("ss") / F.col("var")).alias("ss")
    )


def fit_noise(voxels: DataFrame) -> DataFrame:
    """``(a, b, n)``: Beta(a, 1) fitted to noise / total variance by maximum likelihood.

    The maximum is at ``-n / Σ ln x``; a is kept at or above 1e-6.
    """
    logs = F.sum(F.ln(F.col("noise_var") / F.col("total_var")))
    n = F.count(F.lit(1))
    a = F.when(logs < 0, F.greatest(-n / logs, F.lit(1e-6))).otherwise(F.lit(float("inf")))
    return voxels.agg(a.alias("a"), F.lit(1.0).alias("b"), n.alias("n"))


def beta_loglik(voxels: DataFrame, a: float) -> DataFrame:
    """``(neg_loglik)`` of Beta(a, 1) for the noise ratios; infinite unless a > 0."""
    if a <= 0:
        return voxels.agg(F.lit(float("inf")).alias("neg_loglik"))
    logs = F.sum(F.ln(F.col("noise_var") / F.col("total_var")))
    return voxels.agg((-(F.count(F.lit(1)) * F.ln(F.lit(float(a))) + (a - 1) * logs)).alias("neg_loglik"))


def _centres(n_vals: int) -> list[float]:
    if n_vals < 1:
        raise ValueError("a grid has at least one value")
    return [(2 * k + 1) / (2 * n_vals) for k in range(n_vals)]


def fitted_noise_grid(voxels: DataFrame, n_vals: int = 10) -> DataFrame:
    """``(noise_id, noise_var)``: quantiles, at bin centres, of the Beta(a, 1) fitted to the noise ratios."""
    points = F.posexplode(F.array(*[F.lit(q) for q in _centres(n_vals)])).alias("noise_id", "q")
    return fit_noise(voxels).select("a", points).select("noise_id", F.pow("q", 1 / F.col("a")).alias("noise_var"))


def beta_noise_grid(spark: SparkSession, a: float, b: float, n_vals: int = 10) -> DataFrame:
    """The same quantiles of a given Beta(a, b); they are constants of the plan."""
    if a <= 0 or b <= 0:
        raise ValueError("a Beta distribution needs positive parameters")
    values = [(k, float(inverse_beta(q, a, b))) for k, q in enumerate(_centres(n_vals))]
    return spark.createDataFrame(values, "noise_id int, noise_var double")


def group_by_first_appearance(trials: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """``(voxel, stim, trial, v, position)``: trials ordered stimulus by stimulus.

    Stimuli are ordered by their first trial, trials of a stimulus by number.
    Trials are counted per (voxel, stimulus, chunk of the trial axis); running
    totals of the counts give where a chunk starts, and only the trials of one
    such chunk are sorted together.
    """
    cut = trials.withColumn("chunk", F.floor(F.col("trial") / chunk))
    pieces = cut.groupBy("voxel", "stim", "chunk").agg(F.min("trial").alias("first"), F.count(F.lit(1)).alias("n"))
    stims = pieces.groupBy("voxel", "stim").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    up_to = (Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(Window.partitionBy("voxel").orderBy("first").rowsBetween(*up_to)), F.lit(0))
    starts = stims.select("voxel", "stim", start.alias("start"))
    earlier = F.sum("n").over(Window.partitionBy("voxel", "stim").orderBy("chunk").rowsBetween(*up_to))
    offsets = pieces.join(starts, ["voxel", "stim"]).select(
        "voxel", "stim", "chunk", (F.col("start") + F.coalesce(earlier, F.lit(0))).alias("offset")
    )
    inside = F.row_number().over(Window.partitionBy("voxel", "stim", "chunk").orderBy("trial"))
    return (
        cut.join(offsets, ["voxel", "stim", "chunk"])
        .withColumn("position", F.col("offset") + inside)
        .select("voxel", "stim", "trial", "v", "position")
    )


def in_region(trials: DataFrame, region: DataFrame, scale: float = 1.0) -> DataFrame:
    """Trials of the voxels listed in ``region (voxel)``, divided by ``scale``."""
    return trials.join(region.select("voxel"), "voxel", "left_semi").withColumn("v", F.col("v") / scale)


def scatter(coordinates: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Every coordinate row with its voxel's values, 0 where there are none."""
    return coordinates.join(values.select("voxel", *columns), "voxel", "left").fillna(0.0, subset=columns)

