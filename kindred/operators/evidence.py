"""Gaussian log-evidence of channels under candidate models, and posteriors.

A model is a trace-normalised Gram matrix K over the stimuli.  Channel responses
y are scored under ``C = s K + ν diag(1/w)``.  With weights shared by all
channels, W½ K W½ is decomposed once per model; a channel then costs one
matrix-vector product, and every further noise value only O(stimuli).
Channels with weights of their own or unseen stimuli share a decomposition per
model and pattern of weights and gaps; patterns are sorted together before channels form blocks.
Channels travel in blocks (one Arrow batch each), so that a model matrix is
sent once per block instead of once per channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.gram import pack
from kindred.operators.ranks import quantiles
from kindred.session import BROADCAST_LIMIT

_LOG_2PI = float(np.log(2 * np.pi))
#: responses per block of channels: 4 MB
_BLOCK_CELLS = 500_000


def channel_profiles(stats: DataFrame, index: DataFrame, dim: int, standardize: bool = True) -> DataFrame:
    """``(voxel, y, w, noise_var, signal_var, total_var)`` from per-stimulus statistics.

    y holds the mean responses and w the numbers of presentations, both in the
    order of ``index (stim, i)``; a stimulus the voxel never saw is NULL.  With
    ``standardize`` everything is in units of the voxel's standard deviation
    (ddof 0) around its mean.  A voxel has at most ``dim`` statistics, so one
    grouping brings all of them together and no further exchange is needed.
    """
    cells = stats.join(F.broadcast(index) if dim * 64 <= BROADCAST_LIMIT else index, "stim")
    row = cells.groupBy("voxel").agg(F.sort_array(F.collect_list(F.struct("i", "n", "mean", "ss"))).alias("c"))

    def total(term) -> Column:
        return F.aggregate("c", F.lit(0.0), lambda acc, x: acc + term(x))

    row = row.withColumn("n", total(lambda x: x["n"])).withColumn(
        "centre", total(lambda x: x["n"] * x["mean"]) / F.col("n")
    )
    row = row.withColumn("within", total(lambda x: x["ss"])).withColumn(
        "between", total(lambda x: x["n"] * F.pow(x["mean"] - F.col("centre"), 2))
    )
    spare = F.col("n") - F.size("c")
    none = F.raise_error(F.lit("noise cannot be estimated: no stimulus is repeated")).cast("double")
    noise = F.when(spare > 0, F.col("within") / spare).otherwise(none)
    spread = F.col("within") + F.col("between")
    sd = F.sqrt(spread / F.col("n")) if standardize else F.lit(1.0)
    centre = F.col("centre") if standardize else F.lit(0.0)
    row = row.select(
        "voxel",
        F.when(sd > 0, sd).alias("sd"),
        centre.alias("centre"),
        noise.alias("noise"),
        (spread / (F.col("n") - 1)).alias("total"),
        "c",
    )
    filled = F.when(F.size("c") == dim, F.col("c")).otherwise(_with_gaps(dim))
    row = row.withColumn("c", filled)
    return row.select(
        "voxel",
        F.transform("c", lambda x: (x["mean"] - F.col("centre")) / F.col("sd")).alias("y"),
        F.transform("c", lambda x: x["n"].cast("double")).alias("w"),
        (F.col("noise") / (F.col("sd") * F.col("sd"))).alias("noise_var"),
        ((F.col("total") - F.col("noise")) / (F.col("sd") * F.col("sd"))).alias("signal_var"),
        (F.col("total") / (F.col("sd") * F.col("sd"))).alias("total_var"),
    )


def _with_gaps(dim: int) -> Column:
    """The statistics ``c`` of a voxel, with a NULL entry for every unseen stimulus."""
    by_index = F.map_from_entries(F.transform("c", lambda x: F.struct(x["i"], x)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: by_index[i])


def _eigen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples():
            w = np.ones(row.dim) if row.w is None else np.asarray(row.w, float)
            root = np.sqrt(w)
            k = np.asarray(row.m).reshape(row.dim, row.dim) * np.outer(root, root)
            lam, q = np.linalg.eigh(k)
            out.append((row.model, row.dim, lam, (root[:, None] * q).ravel(), w))
        yield pd.DataFrame(out, columns=["model", "dim", "lam", "q", "shared"])


def decompose(models: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(model, dim, lam, q, shared)``: one eigendecomposition per model.

    ``models`` is a Gram table of trace-normalised matrices, ``weights (i, w)``
    the presentation counts shared by all channels, kept in ``shared``.  lam and
    the columns of W^-½ q belong to W½ K W½.
    """
    packed = pack(models).withColumnRenamed("layer", "model")
    if weights is None:
        packed = packed.withColumn("w", F.lit(None).cast("array<double>"))
    else:
        w = F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda s: s["w"].cast("double"))
        packed = packed.join(F.broadcast(weights.agg(w.alias("w"))))
    return packed.mapInPandas(
        _eigen, "model string, dim int, lam array<double>, q array<double>, shared array<double>"
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``_BLOCK_CELLS`` responses: columns as lists, nested lists flattened."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = len(batch.column("y").flatten()) // batch.num_rows
        step = max(1, _BLOCK_CELLS // max(width, 1))
        for lo in range(0, batch.num_rows, step):
            arrays = []
            for column in batch.slice(lo, step).columns:
                flat = column.flatten() if pa.types.is_list(column.type) else column
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def _by_pattern(k: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Channels with weights of their own or unseen stimuli: one decomposition per pattern of weights and gaps.

    Per channel, the eigenvalues of its pattern's W½ K W½, the squared responses in that basis, the sum of the logarithms of its
    weights, and the number of stimuli it lacks. Unseen stimuli have weight zero and so the eigenvalue zero.
    """
    seen = np.isfinite(y)
    scale = np.where(seen, np.sqrt(np.where(seen, w, 1.0)), 0.0)
    patterns, which = np.unique(scale, axis=0, return_inverse=True)
    which = which.reshape(-1)
    z = np.where(seen, y, 0.0)
    lam, square = np.empty_like(y), np.empty_like(y)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(len(patterns) + 1))
    step = max(1, 8_000_000 // k.size)
    for lo in range(0, len(patterns), step):
        root = patterns[lo : lo + step]
        values, vectors = np.linalg.eigh(root[:, :, None] * k * root[:, None, :])
        for p in range(len(root)):
            rows = order[edges[lo + p] : edges[lo + p + 1]]
            lam[rows] = values[p]
            square[rows] = (z[rows] @ (root[p][:, None] * vectors[p])) ** 2
    return lam, square, 2 * np.log(np.where(seen, np.where(scale > 0, scale, 1.0), 1.0)).sum(axis=1), (~seen).sum(axis=1)


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            voxels, n = np.asarray(row.voxel), row.dim
            y = np.asarray(row.y, float).reshape(len(voxels), n)
            lam, q = np.asarray(row.lam), np.asarray(row.q).reshape(n, n)
            w = None if row.w is None else np.asarray(row.w, float).reshape(len(voxels), n)
            if row.grid is None:
                noises = [(None, np.asarray(row.noise_var, float), np.asarray(row.signal_var, float))]
            else:
                noises = [
                    (g["noise_id"], np.full(len(voxels), g["noise_var"]), np.full(len(voxels), g["signal_var"]))
                    for g in row.grid
                ]
            slow = np.ones(len(voxels), bool) if w is not None else ~np.isfinite(y).all(axis=1)
            shared = np.asarray(row.shared, float)
            logw = float(np.log(shared).sum())
            square = np.where(slow[:, None], 0.0, y) @ q
            square *= square
            if slow.any():
                own = np.broadcast_to(shared, y.shape)[slow] if w is None else w[slow]
                plain = q / shared[:, None]
                own_lam, own_square, own_logw, gaps = _by_pattern((plain * lam) @ plain.T, y[slow], own)
            for noise_id, nu, s in noises:
                spread = s[:, None] * lam + nu[:, None]
                # an estimated signal variance may be negative; the score then
                # takes the absolute determinant
                with np.errstate(divide="ignore", invalid="ignore"):
                    ll = -0.5 * ((np.log(np.abs(spread)) + square / spread).sum(axis=1) - logw + n * _LOG_2PI)
                    if slow.any():
                        spread = s[slow, None] * own_lam + nu[slow, None]
                        # unseen stimuli add the noise alone to the determinant; they are taken out again
                        logdet = np.log(np.abs(spread)).sum(axis=1) - gaps * np.log(np.abs(nu[slow]))
                        ll[slow] = -0.5 * (logdet + (own_square / spread).sum(axis=1) - own_logw + (n - gaps) * _LOG_2PI)
                # a channel without a single response holds no evidence for any model
                ll = np.where(np.isfinite(y).any(axis=1), ll, np.nan)
                yield pd.DataFrame({"voxel": voxels, "model": row.model, "noise_id": noise_id, "ll": ll})


def loglik(
    channels: DataFrame,
    models: DataFrame,
    noise_var: float | None = None,
    signal_var: float | None = None,
    grid: DataFrame | None = None,
    weights: DataFrame | None = None,
    model_bytes: int | None = None,
) -> DataFrame:
    """``(voxel, model, noise_id, ll)``.

    The noise is, in this order: one value for all (``noise_var``), each value
    of ``grid (noise_id, noise_var)`` for all, or the columns ``noise_var`` and
    ``signal_var`` of ``channels``.  A missing signal variance is one minus the
    noise.  ``weights (i, w)`` are presentation counts shared by all channels;
    a ``w`` column of ``channels`` gives them per channel instead.  A ``mu``
    column of ``channels`` is a mean response to subtract from y first.

    ``model_bytes`` bounds the decomposed models (models x stimuli² x 8); with
    it and below the limit they are broadcast, else joined on a salted key.
    """
    has_own = "w" in channels.columns
    if has_own and weights is not None:
        raise ValueError("weights are given twice")
    null = F.lit(None).cast("double")
    if noise_var is None and grid is None:
        if "noise_var" not in channels.columns:
            raise ValueError("no noise given")
        nu = F.col("noise_var")
        sv = F.col("signal_var") if "signal_var" in channels.columns else 1 - nu
    else:
        nu = F.lit(float(noise_var)) if grid is None else null
        sv = null if grid is not None else (1 - nu if signal_var is None else F.lit(float(signal_var)))
    y = F.col("y") if "mu" not in channels.columns else F.zip_with("y", "mu", lambda a, b: a - b)
    columns = [F.col("voxel"), nu.cast("double").alias("noise_var"), sv.cast("double").alias("signal_var"), y.alias("y")]
    columns += ["w"] if has_own else []
    voxel_type = channels.schema["voxel"].dataType.simpleString()
    lists = "voxel array<%s>, noise_var array<double>, signal_var array<double>, y array<double>" % voxel_type
    rows = channels.select(*columns)
    # the same pattern of weights and gaps lies together, without an exchange
    gaps = F.transform("y", lambda v: v.isNull())
    rows = rows.sortWithinPartitions(F.xxhash64(gaps, *(["w"] if has_own else []))) if has_own else rows
    blocks = rows.mapInArrow(_blocks, lists + (", w array<double>" if has_own else ""))
    if not has_own:
        blocks = blocks.withColumn("w", F.lit(None).cast("array<double>"))

    parts = decompose(models, weights)
    if grid is None:
        kind = "array<struct<noise_id:int,noise_var:double,signal_var:double>>"
        parts = parts.withColumn("grid", F.lit(None).cast(kind))
    else:
        signal = (1 - F.col("noise_var")) if signal_var is None else F.lit(float(signal_var))
        entry = F.struct(F.col("noise_id").cast("int").alias("noise_id"), "noise_var", signal.alias("signal_var"))
        parts = parts.join(F.broadcast(grid.agg(F.sort_array(F.collect_list(entry)).alias("grid"))))
    # every block meets every model: the salt spreads a model's copies evenly
    cores = channels.sparkSession.sparkContext.defaultParallelism
    salts = 1 if model_bytes is not None and model_bytes <= BROADCAST_LIMIT else 4 * cores
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("voxel"), F.lit(salts)).cast("int"))
    joined = blocks.join(F.broadcast(parts) if salts == 1 else parts, "salt")
    schema = f"voxel {voxel_type}, model string, noise_id int, ll double"
    return joined.drop("salt").mapInPandas(_score, schema)


def marginal(scores: DataFrame) -> DataFrame:
    """``(voxel, model, ll)``: log-sum of the likelihoods over the noise values."""
    return _log_sum(scores, ["voxel", "model"]).withColumnRenamed("lse", "ll")


def _log_sum(scores: DataFrame, keys: list[str]) -> DataFrame:
    """ln Σ e^ll per key.  Groups are as small as (models x noise values)."""
    values = scores.groupBy(*keys).agg(F.collect_list("ll").alias("lls"))
    top = F.array_max("lls")
    total = F.aggregate("lls", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return values.select(*keys, (top + F.ln(total)).alias("lse"))


def log_posterior(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``log_post``: ll minus its log-sum over all rows with the same ``keys``.

    By default that is over a voxel's models and noise values; more keys keep
    further dimensions (subjects, say) apart.
    """
    part = Window.partitionBy(*(keys or ["voxel"]))
    top = F.max("ll").over(part)
    shifted = scores.withColumn("_top", top)
    total = F.sum(F.exp(F.col("ll") - F.col("_top"))).over(part)
    return shifted.withColumn("log_post", F.col("ll") - F.col("_top") - F.ln(total)).drop("_top")


def posterior(log_posts: DataFrame) -> DataFrame:
    """Add ``post``, the exponential of ``log_post``."""
    return log_posts.withColumn("post", F.exp("log_post"))


def winner_counts(log_posts: DataFrame, order: str = "model") -> DataFrame:
    """``(model, n_voxels)`` for the models that win somewhere; the first of equals wins.

    Channels without evidence (NULL throughout) have no winner.
    """
    known = log_posts.where("log_post is not null")
    winners = known.groupBy("voxel").agg(F.min_by("model", F.struct(-F.col("log_post"), F.col(order))).alias("model"))
    return winners.groupBy("model").agg(F.count(F.lit(1)).alias("n_voxels"))


def boxplot(log_posts: DataFrame, models: int | None = None) -> DataFrame:
    """``(model, n, whisker_lo, q1, median, q3, whisker_hi)`` with whiskers at the extremes.

    Rows without evidence are left out.
    """
    probs = {"whisker_lo": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "whisker_hi": 1.0}
    return quantiles(log_posts.select("model", "log_post").where("log_post is not null"), ["model"], "log_post", probs, groups=models)
