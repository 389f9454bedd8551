"""Gram matrices over a bounded set of stimuli, one row per cell.

Rows are ``(layer, i, j, v)`` with both triangles present and i, j counting the
stimuli from 0.  Per-layer facts (dimension, trace) are one row per layer, and
per-stimulus facts one row per (layer, stimulus): both are joined, never
gathered by a window over a whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.functions.scalars import noise_level
from kindred.operators.moments import outer_parts, outer_sums
from kindred.session import scratch_path


#: distinct stimuli from which limits of number ranges are taken, and ranges at most
_SAMPLE, _RANGES = 4096, 256


def stimulus_index(df: DataFrame, stim: str = "stim") -> DataFrame:
    """``(stim, i)``: the distinct stimuli in their natural order, counting from 0.

    Stimuli are numbered inside value ranges and shifted by the numbers of stimuli in earlier ranges. The limits are quantiles
    of a random sample of the stimuli; they balance the work and don't change a number. Where the sample has all stimuli already, the
    list is a table of these few rows and the input is not read again.
    """
    stims = df.select(F.col(stim).alias("stim")).distinct()
    sample = stims.orderBy(F.xxhash64("stim"), "stim").limit(_SAMPLE).sort("stim").collect()
    kind = stims.schema["stim"].dataType
    if len(sample) < _SAMPLE and kind.typeName() in ("byte", "short", "integer", "long", "string"):
        columns = {"stim": pa.array([r["stim"] for r in sample], to_arrow_type(kind)), "i": pa.array(range(len(sample)), pa.int32())}
        return df.sparkSession.createDataFrame(pa.table(columns))
    step = max(64, -(-len(sample) // _RANGES))
    limits = [F.lit(r["stim"]) for r in sample[step::step] if r["stim"] is not None]
    within = F.size(F.filter(F.array(*limits), lambda limit: limit <= F.col("stim"))) if limits else F.lit(0)
    placed = stims.select("stim", within.alias("range"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row of at most _RANGES sizes
    all_sizes = sizes.agg(F.sort_array(F.collect_list(F.struct("range", "n"))).alias("all"))
    entry = F.explode(F.transform("all", lambda x, k: F.struct(x["range"].alias("range"), F.aggregate(F.slice("all", 1, k), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("before"))))
    starts = all_sizes.select(entry.alias("e")).select("e.range", "e.before")
    number = F.row_number().over(Window.partitionBy("range").orderBy("stim")) - 1
    return placed.withColumn("k", number).join(F.broadcast(starts), "range").select("stim", (F.col("k") + F.col("before")).cast("int").alias("i"))


def _by_feature(acts: DataFrame, index: DataFrame) -> DataFrame:
    """Rows are brought together by (layer, feature), which spreads evenly and grows with the features."""
    return (
        acts.join(index, "stim")
        .groupBy("layer", "feat")
        .agg(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v"))).alias("x"))
    )


def gram_cells(acts: DataFrame, index: DataFrame, dim: int) -> DataFrame:
    """``(layer, i, j, v)`` of the upper triangle, without zero cells.

    Each task adds up its features' outer products and only these sums are exchanged. An activation given twice is an error.
    """
    return outer_sums(_by_feature(acts, index), "x", dim, key="layer", sparse=True).withColumnsRenamed({"key": "layer", "s": "v"})


def _filled(dim: int):
    """Sums of equal cells, which arrive row by row, with the zeros between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, None

        def flush() -> pa.RecordBatch:
            layer, i = at
            n = dim - i
            return pa.RecordBatch.from_arrays(
                [pa.array([layer] * n, pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(np.arange(i, dim, dtype=np.int32)), pa.array(row[i:])],
                ["layer", "i", "j", "v"],
            )

        for batch in batches:
            layers = batch.column(0).to_numpy(zero_copy_only=False)
            i, j, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            starts = np.flatnonzero(np.append(True, (layers[1:] != layers[:-1]) | (i[1:] != i[:-1]))) if len(i) else []
            for lo, hi in zip(starts, [*starts[1:], len(i)]):
                if (layers[lo], i[lo]) != at:
                    if at is not None:
                        yield flush()
                    at, row = (layers[lo], int(i[lo])), np.zeros(dim)
                np.add.at(row, j[lo:hi], s[lo:hi])
        if at is not None:
            yield flush()

    return run


def gram_from_features(acts: DataFrame, index: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Uncentred second moments of ``acts (layer, stim, feat, v)``, for any number of stimuli.

    Absent activations count as zero; a stimulus that the index lacks is left out. The result has every cell: partial sums
    meet by (layer, row), where the zeros of the row are filled in, so zeros are never exchanged.
    """
    index = stimulus_index(acts) if index is None else index
    if dim is None:
        dim = index.count()
    parts, _ = outer_parts(_by_feature(acts, index), "x", dim, key="layer", sparse=True)
    # a zero for every row, so that none is missing
    anchors = acts.select(F.col("layer").cast("string").alias("key")).distinct().join(index.select("i")).select("key", "i", F.col("i").alias("j"), F.lit(0.0).alias("s"))
    rows = parts.unionByName(anchors).repartition("key", "i").sortWithinPartitions("key", "i", "j")
    return mirror(rows.mapInArrow(_filled(dim), "layer string, i int, j int, v double"))


def mirror(upper: DataFrame) -> DataFrame:
    """Add the lower triangle."""
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return upper.select("layer", F.inline(both), "v").select("layer", "i", "j", "v")


def layer_pairs(gram: DataFrame) -> DataFrame:
    """``(a, b)`` for every two layers a < b; the list of names is collected in one row."""
    names = gram.select("layer").distinct().agg(F.sort_array(F.collect_list("layer")).alias("all"))
    return names.select("all", F.posexplode("all").alias("p", "a")).select(
        "a", F.explode(F.slice("all", F.col("p") + 2, F.size("all"))).alias("b")
    )


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(gram: DataFrame) -> DataFrame:
    """``(layer, dim, m)`` with m row-major."""
    cells = F.sort_array(F.collect_list(F.struct("i", "j", "v")))
    return (
        gram.groupBy("layer")
        .agg((F.max("i") + 1).alias("dim"), cells.alias("c"))
        .select("layer", "dim", F.col("c.v").alias("m"))
    )


def unpack(packed: DataFrame) -> DataFrame:
    """Inverse of :func:`pack`."""
    return packed.select("layer", "dim", F.posexplode("m").alias("p", "v")).select(
        "layer", F.expr("cast(p div dim as int)").alias("i"), (F.col("p") % F.col("dim")).alias("j"), "v"
    )


def _diagonal(value: str = "v") -> Column:
    return F.when(F.col("i") == F.col("j"), F.col(value))


def layer_facts(gram: DataFrame) -> DataFrame:
    """``(layer, dim, trace)``."""
    return gram.groupBy("layer").agg(F.count(_diagonal()).alias("dim"), F.sum(_diagonal()).alias("trace"))


def validate(gram: DataFrame, rtol: float = 1e-5, atol: float = 1e-8, tolerance: float = 1e-4) -> DataFrame:
    """``(layer, dim, square, trace, symmetric, normalized)`` for every matrix.

    A cell and its mirror image meet in one group, so no self-join is needed.
    """
    lo, hi = F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")
    above = F.max(F.when(F.col("i") <= F.col("j"), F.col("v")))
    below = F.max(F.when(F.col("i") >= F.col("j"), F.col("v")))
    one, two = F.col("x"), F.col("y")

    def close(p: Column, q: Column) -> Column:
        return F.abs(p - q) <= atol + rtol * F.abs(q)

    pairs = gram.groupBy("layer", lo, hi).agg(above.alias("x"), below.alias("y"), F.count("v").alias("c"))
    same = F.coalesce(close(one, two) & close(two, one), F.lit(False))
    diag = F.col("lo") == F.col("hi")
    facts = pairs.groupBy("layer").agg(
        (F.max("hi") + 1).alias("dim"),
        F.sum("c").alias("cells"),
        F.sum(F.when(diag, one)).alias("trace"),
        F.bool_and(same).alias("symmetric"),
    )
    return facts.select(
        "layer",
        "dim",
        (F.col("cells") == F.col("dim").cast("long") * F.col("dim")).alias("square"),
        "trace",
        "symmetric",
        (F.abs(F.col("trace") - F.col("dim")) < tolerance).alias("normalized"),
    )


def require_comparable(gram: DataFrame) -> DataFrame:
    """Check a collection before comparing it: ≥ 2 square symmetric matrices of one size."""
    bad = validate(gram).agg(
        F.count("layer").alias("layers"),
        F.count_if(~F.col("square")).alias("ragged"),
        F.count_if(~F.col("symmetric")).alias("skewed"),
        F.count_distinct("dim").alias("dims"),
    ).first()
    if bad["layers"] == 0:
        raise ValueError("the collection is empty")
    if bad["layers"] == 1:
        raise ValueError("need more than one matrix")
    if bad["ragged"] or bad["dims"] != 1:
        raise ValueError("matrices must be square and of one size")
    if bad["skewed"]:
        raise ValueError("matrices must be symmetric")
    return gram


def well_formed(gram: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """The same cells; reading them fails unless all matrices are square, of one size and symmetric.

    A cell meets its mirror image in one exchange, and one row with the sizes meets every cell, so no job of its own is needed.
    """
    facts = gram.groupBy("layer").agg(F.count(F.lit(1)).alias("cells"), F.greatest(F.max("i"), F.max("j")).alias("last"))
    side = F.col("last").cast("long") + 1
    sizes = facts.agg((F.min("last") == F.max("last")).alias("equal"), F.bool_and(F.col("cells") == side * side).alias("square"))
    lo, hi = F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")
    both = gram.groupBy("layer", lo, hi).agg(F.max(F.when(F.col("i") <= F.col("j"), F.col("v"))).alias("x"), F.max(F.when(F.col("i") >= F.col("j"), F.col("v"))).alias("y"))
    near = F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.least(F.abs("x"), F.abs("y"))

    def failing(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("double")

    def checked(value: str) -> Column:
        sized = F.when(F.col("equal") & F.col("square"), F.col(value)).otherwise(failing("matrices must be square and of one size"))
        return F.when(F.coalesce(near, F.col("x").isNull() & F.col("y").isNull()), sized).otherwise(
            F.when(F.col("equal") & F.col("square"), failing("matrices must be symmetric")).otherwise(failing("matrices must be square and of one size"))
        )

    cells = both.join(F.broadcast(sizes)).select("layer", "lo", "hi", checked("x").alias("x"), checked("y").alias("y"))
    mirrored = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("x").alias("v")))).otherwise(
        F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("x").alias("v")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j"), F.col("y").alias("v")))
    )
    return cells.select("layer", F.inline(mirrored))


def condition(
    gram: DataFrame, noise_var: float | None = None, b: float = 0.01, normalize: bool = True
) -> DataFrame:
    """Trace-normalise and add noise, either, or neither.

    ``noise_var`` wins over ``b``, from which the noise is ``dim b / (1 + dim b)``;
    ``b=0`` without ``noise_var`` adds none.
    """
    noisy = bool(b) or noise_var is not None
    if not normalize and not noisy:
        return gram
    joined = gram.join(F.broadcast(layer_facts(gram)), "layer")
    value = F.col("v") * F.col("dim") / F.col("trace") if normalize else F.col("v")
    if noisy:
        nu = noise_level(F.col("dim"), noise_var, b)
        value = (1 - nu) * value + F.when(F.col("i") == F.col("j"), nu).otherwise(0.0)
    return joined.select("layer", "i", "j", value.alias("v"))


def trace_norm(gram: DataFrame) -> DataFrame:
    """Scale every matrix to a trace equal to its dimension."""
    return condition(gram, b=0.0)


def add_noise(
    gram: DataFrame,
    noise_var: float,
    signal_var: float | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """``s K + ν I``, or ``s K + ν diag(1 / w)`` given ``weights (i, w)``.

    Only ``signal_var=None`` means "one minus the noise"; a zero is a zero.
    """
    signal = 1 - noise_var if signal_var is None else signal_var
    noise = F.lit(float(noise_var))
    if weights is not None:
        gram = gram.join(weights.select("i", "w"), "i", "left")
        missing = F.raise_error(F.lit("no weight for a stimulus")).cast("double")
        noise = F.when(F.col("w") > 0, noise / F.col("w")).otherwise(missing)
    value = signal * F.col("v") + F.when(F.col("i") == F.col("j"), noise).otherwise(0.0)
    return gram.select("layer", "i", "j", value.alias("v"))


def double_center(gram: DataFrame) -> DataFrame:
    """Subtract row and column means, add the mean of the matrix."""
    means = gram.groupBy("layer", "i").agg(F.avg("v").alias("mean"))
    grand = means.groupBy("layer").agg(F.avg("mean").alias("grand"))
    value = F.col("v") - F.col("ri.mean") - F.col("rj.mean") + F.col("grand")
    return (
        gram.alias("g")
        .join(means.alias("ri"), ["layer", "i"])
        .join(means.withColumnRenamed("i", "j").alias("rj"), ["layer", "j"])
        .join(F.broadcast(grand), "layer")
        .select("layer", "i", "j", value.alias("v"))
    )


def _with_diagonals(gram: DataFrame) -> DataFrame:
    """Add ``vii`` and ``vjj`` to every cell."""
    diag = gram.where("i = j").select("layer", "i", F.col("v").alias("d"))
    return (
        gram.join(diag.withColumnRenamed("d", "vii"), ["layer", "i"])
        .join(diag.withColumnsRenamed({"i": "j", "d": "vjj"}), ["layer", "j"])
        .select("layer", "i", "j", "v", "vii", "vjj")
    )


def squared_distances(gram: DataFrame) -> DataFrame:
    """Squared Euclidean distance of stimuli i and j: ``v_ii + v_jj - 2 v_ij``."""
    return _with_diagonals(gram).select(
        "layer", "i", "j", (F.col("vii") + F.col("vjj") - 2 * F.col("v")).alias("v")
    )


def cosine_similarity(gram: DataFrame) -> DataFrame:
    """``v_ij / sqrt(v_ii v_jj)``, exactly 1 on the diagonal."""
    cos = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("v") / F.sqrt(F.col("vii") * F.col("vjj")))
    return _with_diagonals(gram).select("layer", "i", "j", cos.alias("v"))


def minmax(gram: DataFrame) -> DataFrame:
    """Map every matrix linearly onto [-1, 1]; a constant matrix is an error."""
    span = gram.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(
        F.raise_error(F.lit("all values of a matrix are the same")).cast("double")
    )
    return gram.join(F.broadcast(span), "layer").select(
        "layer", "i", "j", (2 * (F.col("v") - F.col("lo")) / width - 1).alias("v")
    )


def same_class(classes: DataFrame, layer: str = "ideal") -> DataFrame:
    """Gram of one-hot class codes of ``classes (stim, label)``: 1 within a class, else 0.

    It is the Gram of a layer with one feature per class.
    """
    one_hot = classes.select(
        F.lit(layer).alias("layer"), "stim", F.col("label").cast("string").alias("feat"), F.lit(1.0).alias("v")
    )
    return gram_from_features(one_hot)


def max_relative_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(layer, max_abs, max_rel)`` between two computations of the same matrices."""
    both = x.alias("x").join(y.alias("y"), ["layer", "i", "j"], "full")
    gap = F.abs(F.coalesce("x.v", F.lit(0.0)) - F.coalesce("y.v", F.lit(0.0)))
    top = F.greatest(F.abs("x.v"), F.abs("y.v"))
    return both.groupBy("layer").agg(
        F.max(gap).alias("max_abs"), F.max(F.when(top > 0, gap / top).otherwise(0.0)).alias("max_rel")
    )
