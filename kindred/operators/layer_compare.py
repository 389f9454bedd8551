"""All-pairs comparison of layers held as wide rows, for any number of stimuli.

With n stimuli and p, q features the n x n matrices XX' and YY' act on a space
of at most p + q dimensions; on the rest both equal the added noise times the
identity.  So every measure but the neighbour- and rank-based ones follows
from n, X'X, Y'Y, X'Y and a few sums: one scan, no shuffle of stimuli, and no
n x n matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import linalg as la
from kindred.functions import pair_measures as pm
from kindred.functions.scalars import noise_level
from kindred.operators import stimulus_pairs
from kindred.operators.gram_compare import wanted_only
from kindred.operators.moments import outer_sums
from kindred.plans.registry import MEASURES, Measure, Params, evaluate, resolve_all
from kindred.schema import DIST
from kindred.sources.activations import Layers


def _layout(layers: Layers) -> list[np.ndarray]:
    """Positions of each layer in the augmented vector (1, features, squared norms)."""
    ends = np.cumsum([1] + [layers.widths[n] for n in layers.names])
    return [np.append(np.arange(lo, hi), ends[-1] + i) for i, (lo, hi) in enumerate(zip(ends, ends[1:]))]


#: rows from which the pilot means are taken
PILOT_ROWS = 64


def pilot_means(layers: Layers) -> np.ndarray:
    """A rough mean of every feature, from a few rows.

    Moments are taken about it: their sums then stay as small as the spread of the features, and sums of squared
    distances do not lose their digits to a common offset. Any value is right, a near one is accurate.
    """
    total = sum(layers.widths[n] for n in layers.names)
    found = [r["x"] for r in layers.wide().select("x").limit(PILOT_ROWS).collect()]
    # rows of a wrong width fail where all rows are read
    rows = [np.asarray(x, float) for x in found if x is not None and len(x) == total and None not in x]
    return np.mean(rows, axis=0) if rows else np.zeros(total)


def layer_moments(layers: Layers, pilot: np.ndarray | None = None) -> DataFrame:
    """``(i, j, s)``: second moments of (1, all features less the pilot, squared norm per layer)."""
    widths = [layers.widths[n] for n in layers.names]
    total = sum(widths)
    starts = np.cumsum([0] + widths[:-1])
    shift = np.zeros(total) if pilot is None else pilot

    def augment(block: np.ndarray) -> np.ndarray:
        block = block - shift
        norms = np.add.reduceat(block * block, starts, axis=1)
        return np.hstack([np.ones((len(block), 1)), block, norms])

    return outer_sums(layers.wide(), "x", total, augment=augment)


def _owner(position, ends: list[int]):
    """The layer a moment's position belongs to; -1 for the constant. ``ends`` are the last positions of the layers' features."""
    within = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e < position))
    return F.when(position == 0, -1).when(position <= int(ends[-1]), within).otherwise(position - int(ends[-1]) - 1)


def pair_moments(layers: Layers, pilot: np.ndarray | None = None) -> DataFrame:
    """``(a, b, i, c)``: for every layer pair, the rows of moments that concern it, with c an array of (j, s).

    Each row is sent to the pairs that need it, so one exchange of the moment table replaces a five-way self-join of it;
    the rows of a pair arrive one after the other, and its kernel puts them together.
    """
    ends = np.cumsum([layers.widths[n] for n in layers.names]).tolist()
    moments = layer_moments(layers, pilot).withColumn("la", _owner(F.col("i"), ends)).withColumn("lb", _owner(F.col("j"), ends))
    m = moments.groupBy("la", "lb", "i").agg(F.collect_list(F.struct("j", "s")).alias("c"))
    everyone = F.sequence(F.lit(0), F.lit(len(ends) - 1))
    single = F.when(F.col("lb") < 0, everyone).otherwise(F.array("lb"))
    partners = F.flatten(
        F.transform(
            single,
            lambda l: F.transform(
                F.filter(everyone, lambda p: p != l),
                lambda p: F.struct(F.least(l, p).alias("a"), F.greatest(l, p).alias("b")),
            ),
        )
    )
    own = F.array(F.struct(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")))
    crossing = (F.col("la") >= 0) & (F.col("la") != F.col("lb"))
    return m.withColumn("pair", F.explode(F.when(crossing, own).otherwise(partners))).select("pair.a", "pair.b", "i", "c")


def _squared_distance_sums(n, aa, bb, ab, sx, sy, na, nb, saa, sbb, sab, ax, ay, bx, by):
    """Sums over i<j of d1, d2, d1², d2², d1·d2 for squared Euclidean distances."""

    def product(u, v, uv, su, sv, nu, nv, nunv, nu_v, nv_u):
        full = 2 * n * nunv + 2 * nu * nv - 4 * nu_v @ sv - 4 * nv_u @ su + 4 * np.sum(uv * uv)
        return full / 2

    d1, d2 = n * na - sx @ sx, n * nb - sy @ sy
    return (
        d1,
        d2,
        product(aa, aa, aa, sx, sx, na, na, saa, ax, ax),
        product(bb, bb, bb, sy, sy, nb, nb, sbb, by, by),
        product(aa, bb, ab, sx, sy, na, nb, sab, ay, bx),
    )


def _rsa(measure: str, n: int, sums, scale1: float, scale2: float, nu: float) -> float:
    count = n * (n - 1) / 2
    d1, d2, q1, q2, q12 = sums
    d1, q1, d2, q2, q12 = scale1 * d1, scale1**2 * q1, scale2 * d2, scale2**2 * q2, scale1 * scale2 * q12
    if measure == "rsacorr":
        c = (q12 - d1 * d2 / count) / np.sqrt(q1 - d1 * d1 / count) / np.sqrt(q2 - d2 * d2 / count)
    else:
        # the noise adds the same constant to every distance
        g = 2 * nu
        q1, q2, q12 = (
            q1 + 2 * g * d1 + g * g * count,
            q2 + 2 * g * d2 + g * g * count,
            q12 + g * (d1 + d2) + g * g * count,
        )
        c = q12 / np.sqrt(q1) / np.sqrt(q2)
    if 0 < abs(c) - 1 <= 1e-7:
        c = float(np.sign(c))
    return float(np.arccos(c)) if measure == "rsaarccos" else float(c)


def _pair_kernel(names: list[str], layout: list[np.ndarray], pilot: np.ndarray, measures: list[Measure], params: Params):
    def one(a: int, b: int, i, j, values, lacking) -> Iterator[tuple[str, float | None]]:
        ix, iy = layout[a], layout[b]
        index = np.concatenate([[0], ix, iy])
        order = np.sort(index)
        rank = np.searchsorted(order, index)
        t = np.zeros((len(index), len(index)))
        i, j = np.searchsorted(order, i), np.searchsorted(order, j)
        t[i, j] = t[j, i] = values
        t = t[np.ix_(rank, rank)]
        p = len(ix) - 1
        x, nx = slice(1, 1 + p), 1 + p
        y, ny = slice(2 + p, len(index) - 1), len(index) - 1
        n = int(round(t[0, 0]))
        aa, bb, ab, sx, sy = t[x, x], t[y, y], t[x, y], t[0, x], t[0, y]
        # moments about zero from those about the pilot
        c, d = pilot[ix[:-1] - 1], pilot[iy[:-1] - 1]
        whole = [
            m + np.outer(s1, c2) + np.outer(c1, s2) + n * np.outer(c1, c2)
            for m, s1, s2, c1, c2 in ((aa, sx, sx, c, c), (bb, sy, sy, d, d), (ab, sx, sy, c, d))
        ]
        tr1, tr2 = float(np.trace(whole[0])), float(np.trace(whole[1]))
        nu = noise_level(n, params.noise_var, params.b)
        signal = 1 - nu if (params.b or params.noise_var is not None) else 1.0
        scale1 = signal * (n / tr1 if params.normalize else 1.0)
        scale2 = signal * (n / tr2 if params.normalize else 1.0)

        def conditioned(xx, yy, xy, dims: int) -> pm.Conditioned:
            c1, c2 = la.common_core(xx, yy, xy)
            eye = nu * np.eye(len(c1))
            return pm.Conditioned(scale1 * c1 + eye, scale2 * c2 + eye, n, dims - len(c1), nu)

        plain = centred = sums = None
        for m in measures:
            if lacking is not None and m.name not in lacking:
                continue
            try:
                if m.name in ("rsacorr", "rsacos", "rsaarccos"):
                    if sums is None:
                        sums = _squared_distance_sums(
                            n, aa, bb, ab, sx, sy, t[0, nx], t[0, ny], t[nx, nx], t[ny, ny], t[nx, ny],
                            t[nx, x], t[nx, y], t[ny, x], t[ny, y],
                        )
                    value = _rsa(m.name, n, sums, scale1, scale2, nu)
                elif m.centred:
                    if centred is None:
                        centred = conditioned(
                            aa - np.outer(sx, sx) / n, bb - np.outer(sy, sy) / n, ab - np.outer(sx, sy) / n, n - 1
                        )
                    value = evaluate(m, centred, params, None)
                else:
                    if plain is None:
                        plain = conditioned(*whole, n)
                    if m.family in ("gaussian", "sampled") and plain.extra and not nu:
                        raise np.linalg.LinAlgError("singular without noise")
                    rng = la.pair_rng(params.seed, names[a], names[b], params.portable) if m.family == "sampled" else None
                    value = evaluate(m, plain, params, rng)
            except np.linalg.LinAlgError:
                value = None
            yield m.name, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, lacking = None, [], None

        def finish() -> pa.RecordBatch:
            i, j, s = (np.concatenate(x) for x in zip(*held))
            found = list(one(*at, i, j, s, lacking))
            n = len(found)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([names[at[0]]] * n, pa.string()), pa.array([names[at[1]]] * n, pa.string()), pa.array([f[1] for f in found], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["measure", "a", "b", "value"])

        for batch in batches:
            for a, b, i, cells, lacks in zip(*batch.columns):
                if (a.as_py(), b.as_py()) != at:
                    if held:
                        yield finish()
                    at, held, lacking = (a.as_py(), b.as_py()), [], lacks.as_py()
                j, s = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                held.append((np.full(len(j), i.as_py()), j, s))
        if held:
            yield finish()

    return run


def compare_layers(layers: Layers, measures, todo: DataFrame | None = None, **options) -> DataFrame:
    """``(measure, a, b, value)`` for every pair of layers and every measure.

    a precedes b in the layer catalogue.  A value is NULL where the measure is
    undefined (a Gaussian measure of singular matrices).  ``todo`` restricts
    the work to the given ``(a, b)`` or, with a column ``measures``, to what each pair lacks.  Options are those of
    :class:`kindred.plans.registry.Params`.
    """
    wanted, params = resolve_all(measures), Params(**options)
    params.check(wanted)
    if len(layers.names) < 2:
        raise ValueError("need at least two layers to compare")
    parts = []
    algebraic = [m for m in wanted if m.family not in ("rank", "neighbour")]
    if algebraic:
        names = layers.names
        pilot = pilot_means(layers)
        pairs = pair_moments(layers, pilot)
        everything = F.lit(None).cast("array<string>")
        if todo is None:
            pairs = pairs.withColumn("lacking", everything)
        else:
            lookup = F.array(*[F.lit(n) for n in names])
            lacking = F.flatten(F.collect_set("measures")) if "measures" in todo.columns else F.first(everything)
            keys = todo.groupBy(F.col("a").alias("ta"), F.col("b").alias("tb")).agg(lacking.alias("lacking"))
            same = (F.get(lookup, F.col("a")) == F.col("ta")) & (F.get(lookup, F.col("b")) == F.col("tb"))
            pairs = pairs.join(keys, same).drop("ta", "tb")
        # few pairs, each with a decomposition to compute: spread them whatever their size
        count = min(len(names) * (len(names) - 1) // 2, layers.df.sparkSession.sparkContext.defaultParallelism)
        pairs = pairs.select("a", "b", "i", "c", "lacking").repartition(count, "a", "b").sortWithinPartitions("a", "b")
        parts.append(pairs.mapInArrow(_pair_kernel(names, _layout(layers), pilot, algebraic, params), DIST))
    if MEASURES["rsarank"] in wanted:
        parts.append(_restrict(stimulus_pairs.rank_similarity(layers), todo))
    if MEASURES["jaccard"] in wanted:
        parts.append(_restrict(stimulus_pairs.neighbour_similarity(layers, params), todo))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _restrict(dist: DataFrame, todo: DataFrame | None) -> DataFrame:
    return dist if todo is None else wanted_only(dist, todo)
