"""All-pairs comparison of Gram matrices over a bounded set of stimuli.

Entrywise measures are grouped sums over matrix cells.  Measures that need a
decomposition run on pairs of packed matrices, joined by an equi-join on the
partner so that the pairs spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import linalg as la
from kindred.functions.pair_measures import Conditioned
from kindred.functions.scalars import clamp_cosine
from kindred.operators.gram import condition, cosine_similarity, double_center, materialize, pack, require_comparable, squared_distances, well_formed
from kindred.operators.ranks import average_ranks
from kindred.plans.registry import Measure, Params, evaluate, resolve_all
from kindred.schema import DIST
from kindred.session import small_batches


_SUMS = ("n", "sxy", "sx", "sy", "sxx", "syy")


def _outer_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums over its cells: a few small matrix products over (cells x layers), with a mask of what is there."""
    names: dict[str, int] = {}
    total = np.zeros((6, 0, 0))
    for batch in batches:
        lists = batch.column("ls")
        rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        codes = lists.flatten().field(0).dictionary_encode()
        for name in codes.dictionary.to_pylist():
            names.setdefault(name, len(names))
        layer = np.array([names[x] for x in codes.dictionary.to_pylist()], int)[codes.indices.to_numpy(zero_copy_only=False)]
        grown = np.zeros((6, len(names), len(names)))
        grown[:, : total.shape[1], : total.shape[2]] = total
        total = grown
        there, z = np.zeros((2, batch.num_rows, len(names)))
        there[rows, layer] = 1
        z[rows, layer] = lists.flatten().field(1).to_numpy(zero_copy_only=False)
        square = z * z
        total += np.stack([there.T @ there, z.T @ z, z.T @ there, there.T @ z, square.T @ there, there.T @ square])
    order = sorted(names)
    at = np.array([names[x] for x in order], int)
    i, j = np.triu_indices(len(order), 1)
    columns = [pa.array([order[k] for k in i], pa.string()), pa.array([order[k] for k in j], pa.string())]
    yield pa.RecordBatch.from_arrays(columns + [pa.array(total[k][at[i], at[j]]) for k in range(6)], ["a", "b", *_SUMS])


def cell_products(cells: DataFrame, value: str = "v") -> DataFrame:
    """Sums over matching cells for every layer pair a < b.

    ``(a, b, n, sxy, sx, sy, sxx, syy)``.  The layers of one cell meet in one
    row, and a task adds up its rows as small matrix products over the layers.
    """
    per_cell = cells.groupBy("i", "j").agg(F.collect_list(F.struct(F.col("layer").cast("string").alias("layer"), F.col(value).cast("double").alias("v"))).alias("ls"))
    sums = per_cell.select("ls").mapInArrow(_outer_products, "a string, b string, " + ", ".join(f"{x} double" for x in _SUMS))
    return sums.groupBy("a", "b").agg(F.sum("n").cast("long").alias("n"), *[F.sum(x).alias(x) for x in _SUMS[1:]]).where("n > 0")


def _cosine() -> Column:
    return F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy")


def _pearson() -> Column:
    n = F.col("n")
    spread_x, spread_y = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    return (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread_x) / F.sqrt(spread_y)


def _named(measure: Measure, pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.select(F.lit(measure.name).alias("measure"), "a", "b", value.alias("value"))


def _entrywise(measure: Measure, gram: DataFrame) -> DataFrame:
    if measure.centred:
        alignment = _cosine()
        value = F.sqrt(F.greatest(alignment, F.lit(0.0))) if measure.name == "distcorr" else alignment
        return _named(measure, cell_products(double_center(gram)), value)
    # the mean is taken out before squaring: distances have a large common part
    upper = squared_distances(gram).where("i < j")
    if measure.name == "rsacorr":
        mean = upper.groupBy("layer").agg(F.avg("v").alias("mean"))
        upper = upper.join(F.broadcast(mean), "layer").withColumn("v", F.col("v") - F.col("mean"))
        return _named(measure, cell_products(upper), clamp_cosine(_cosine()))
    value = clamp_cosine(_cosine())
    return _named(measure, cell_products(upper), F.acos(value) if measure.name == "rsaarccos" else value)


def _rank(measure: Measure, gram: DataFrame) -> DataFrame:
    """Spearman correlation from mean ranks, without tie correction."""
    ranked = average_ranks(
        squared_distances(gram).where("i < j").withColumn("v", F.round("v", 12)), ["layer"], "v"
    )
    n = F.col("n").cast("double")
    centred = F.col("sxy") - n * (n + 1) * (n + 1) / 4
    return _named(measure, cell_products(ranked, "rank"), 12 * centred / (n * n * n - n))


def neighbours(gram: DataFrame, k: int) -> DataFrame:
    """``(layer, i, neighbours)``: the k most similar other stimuli, ties to the smaller index."""
    order = Window.partitionBy("layer", "i").orderBy(F.desc("sim"), "j")
    cos = cosine_similarity(gram).where("i <> j").withColumn("sim", F.round("v", 12))
    top = cos.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    ranked = F.sort_array(F.collect_list(F.struct("r", "j")))
    return top.groupBy("layer", "i").agg(ranked.alias("s")).select("layer", "i", F.col("s.j").alias("neighbours"))


def _neighbour(measure: Measure, gram: DataFrame, k: int) -> DataFrame:
    sets = neighbours(gram, k).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("layer", "neighbours"))).alias("ls"))
    pairs = sets.select("ls", F.posexplode("ls").alias("p", "x")).select(
        "x", F.explode(F.slice("ls", F.col("p") + 2, F.size("ls"))).alias("y")
    )
    overlap = F.size(F.array_intersect("x.neighbours", "y.neighbours")) / F.size(
        F.array_union("x.neighbours", "y.neighbours")
    )
    means = pairs.groupBy(F.col("x.layer").alias("a"), F.col("y.layer").alias("b")).agg(F.avg(overlap).alias("value"))
    return _named(measure, means, F.col("value"))


#: bytes of the matrices of a block of layers, about
_BLOCK_BYTES = 64 << 20
_MEETING = "g1 int, g2 int, kind int, layer string, dim int, m array<double>, mu array<double>, a string, b string, lacking array<string>"


class _Layer:
    """A conditioned matrix and its mean in a task, with decompositions that all its partners there share."""

    def __init__(self, layer: str, dim: int, m: np.ndarray, mu: np.ndarray | None):
        if len(m) != dim * dim:
            raise ValueError("matrices must be square and of one size")
        k = m.reshape(dim, dim)
        if not np.allclose(k, k.T):
            raise ValueError(f"matrices must be symmetric: {layer} is not")
        self.dim, self.mu, self.plain = dim, mu, la.Factors(k)


def _pair_values(a: str, b: str, x: _Layer, y: _Layer, measures: list[Measure], params: Params) -> Iterator[tuple[str, float | None]]:
    if x.dim != y.dim:
        raise ValueError("matrices must be square and of one size")
    delta = None
    if x.mu is not None or y.mu is not None:
        zero = np.zeros(x.dim)
        delta = (zero if x.mu is None else x.mu) - (zero if y.mu is None else y.mu)
    plain = centred = None
    for m in measures:
        rng = la.pair_rng(params.seed, a, b, params.portable) if m.family == "sampled" else None
        try:
            if m.centred:
                one, two = x.plain.centred, y.plain.centred
                centred = centred or Conditioned(one.matrix, two.matrix, x.dim, one=one, two=two)
            else:
                plain = plain or Conditioned(x.plain.matrix, y.plain.matrix, x.dim, delta=delta, one=x.plain, two=y.plain)
            yield m.name, evaluate(m, centred if m.centred else plain, params, rng)
        except np.linalg.LinAlgError:
            yield m.name, None


def _block_kernel(measures: list[Measure], params: Params):
    """Pairs of two blocks of layers; the matrices arrive before the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, layers = None, {}
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            g1, g2, kind, dim = (c[n].to_numpy(zero_copy_only=False) for n in ("g1", "g2", "kind", "dim"))
            rows = []
            for r in range(batch.num_rows):
                if (g1[r], g2[r]) != at:
                    at, layers = (g1[r], g2[r]), {}
                if kind[r] == 0:
                    name = c["layer"][r].as_py()
                    m, mu = c["m"][r].values.to_numpy(zero_copy_only=False), c["mu"][r]
                    layers[name] = _Layer(name, int(dim[r]), m, mu.values.to_numpy(zero_copy_only=False) if mu.is_valid else None)
                    continue
                a, b, lacks = c["a"][r].as_py(), c["b"][r].as_py(), c["lacking"][r].as_py()
                if a in layers and b in layers:
                    wanted = [m for m in measures if lacks is None or m.name in lacks]
                    rows += [(name, a, b, value) for name, value in _pair_values(a, b, layers[a], layers[b], wanted, params)]
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["measure", "a", "b", "value"])

    return run


def compare_packed(packed: DataFrame, todo: DataFrame | None, measures: list[Measure], params: Params, means: DataFrame | None = None) -> DataFrame:
    """``(measure, a, b, value)`` of conditioned packed matrices ``(layer, dim, m)``, a written table, for every pair a < b or those of ``todo``.

    Layers are dealt into blocks, and blocks meet pairwise: a matrix is sent to each block once, not to each partner, and what is decomposed of it
    serves all partners in that block.
    """
    small_batches(packed.sparkSession)
    facts = packed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    cores = packed.sparkSession.sparkContext.defaultParallelism
    enough = ceil(sqrt(4 * cores))
    blocks = int(max(1, min(facts["n"], max(enough, ceil(facts["n"] * facts["dim"] ** 2 * 8 / _BLOCK_BYTES)))))

    def block(layer: str) -> Column:
        return F.pmod(F.xxhash64(layer), F.lit(blocks)).cast("int")

    if means is None:
        packed = packed.withColumn("mu", F.lit(None).cast("array<double>"))
    else:
        packed = packed.join(means.select("layer", "mu"), "layer", "left")
    if todo is None:
        names = packed.select("layer")
        todo = names.select(F.col("layer").alias("a")).join(names.select(F.col("layer").alias("b")), F.col("a") < F.col("b"))
    lacking = F.col("measures") if "measures" in todo.columns else F.lit(None).cast("array<string>")
    null = {f.split()[0]: F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _MEETING.split(", ")}
    mine, other = F.col("g"), F.col("p")
    matrices = packed.withColumn("g", block("layer")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least(mine, other).alias("g1"), F.greatest(mine, other).alias("g2"), F.lit(0).alias("kind"), "layer", "dim", "m", "mu", null["a"], null["b"], null["lacking"]
    )
    pairs = todo.select(
        F.least(block("a"), block("b")).alias("g1"), F.greatest(block("a"), block("b")).alias("g2"), F.lit(1).alias("kind"),
        null["layer"], null["dim"], null["m"], null["mu"], "a", "b", lacking.alias("lacking"),
    )
    # few rows, but heavy to compute: one task a pair of blocks, whatever their size
    tasks = max(cores, min(blocks * (blocks + 1) // 2, 16 * cores))
    met = matrices.unionByName(pairs).repartition(tasks, "g1", "g2").sortWithinPartitions("g1", "g2", "kind")
    return met.mapInArrow(_block_kernel(measures, params), DIST)


def compare_gram(
    gram: DataFrame,
    measures,
    means: DataFrame | None = None,
    todo: DataFrame | None = None,
    check: bool = False,
    **options,
) -> DataFrame:
    """``(measure, a, b, value)`` for every pair a < b of layers and every measure.

    ``means (layer, mu)`` are optional mean vectors for the distribution
    measures; a layer without one has mean zero.  ``todo (a, b)`` restricts the
    work, and its column ``measures``, if there is one, says which measures a pair lacks.  Matrices that are asymmetric or of unequal size always fail when the result is read; ``check`` fails
    at once, at the price of a job of its own.  Options
    are those of :class:`kindred.plans.registry.Params`.
    """
    wanted, params = resolve_all(measures), Params(**options)
    params.check(wanted)
    if check:
        require_comparable(gram)
    if todo is not None:
        # everything below works on the matrices of the wanted pairs only
        used = todo.select(F.explode(F.array("a", "b")).alias("layer")).distinct()
        gram = gram.join(used, "layer", "left_semi")
    ready = condition(well_formed(gram), params.noise_var, params.b, params.normalize)
    parts = []
    dense = [m for m in wanted if m.family in ("spectral", "gaussian", "sampled")]
    if dense:
        parts.append(compare_packed(materialize(pack(ready), "packed"), todo, dense, params, means))
    for m in wanted:
        if m.family == "entrywise":
            part = _entrywise(m, ready)
        elif m.family == "rank":
            part = _rank(m, ready)
        elif m.family == "neighbour":
            part = _neighbour(m, ready, params.k)
        else:
            continue
        parts.append(part if todo is None else wanted_only(part, todo))
    result = parts[0].select("measure", "a", "b", "value")
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def wanted_only(dist: DataFrame, todo: DataFrame) -> DataFrame:
    """The results that ``todo (a, b[, measures])`` asks for."""
    if "measures" in todo.columns:
        return dist.join(todo.select(F.explode("measures").alias("measure"), "a", "b").distinct(), ["measure", "a", "b"], "left_semi")
    return dist.join(todo.select("a", "b").distinct(), ["a", "b"], "left_semi")


def symmetrize(dist: DataFrame) -> DataFrame:
    """The full matrix: both orders of each pair, and 0 (distance) or 1 (similarity) on the diagonal."""
    a, b = F.col("a"), F.col("b")
    both = dist.select(
        "measure",
        F.inline(F.array(F.struct("a", "b"), F.struct(b.alias("a"), a.alias("b")))),
        "value",
    )
    layers = dist.select("measure", F.explode(F.array("a", "b")).alias("a")).distinct()
    return both.unionByName(
        layers.select("measure", "a", F.col("a").alias("b"), diagonal_value(F.col("measure")).alias("value"))
    )


def diagonal_value(measure: Column) -> Column:
    from kindred.plans.registry import MEASURES

    similar = [m.name for m in MEASURES.values() if m.similarity]
    return F.when(measure.isin(similar), F.lit(1.0)).otherwise(F.lit(0.0))


def distance_form(dist: DataFrame) -> DataFrame:
    """Turn the similarities among ``dist`` into ``1 - value`` with a zero diagonal."""
    flipped = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(1 - F.col("value"))
    value = F.when(diagonal_value(F.col("measure")) == 1, flipped).otherwise(F.col("value"))
    return dist.select("measure", "a", "b", value.alias("value"))
