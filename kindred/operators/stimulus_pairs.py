"""Measures that need every pair of stimuli: neighbour overlap and rank RSA.

Stimuli are hashed into blocks; an equi-join on (block, block) brings each pair
of blocks together and a matrix product works through it.  A task only ever
holds two blocks, and it emits k neighbours per stimulus rather than the pairs
themselves (for ranks the distances are the result of the step).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.scalars import noise_level
from kindred.operators.gram import materialize, stimulus_index
from kindred.operators.moments import outer_sums
from kindred.plans.registry import Params
from kindred.session import small_batches
from kindred.sources.activations import Layers

#: stimuli per block: two blocks of 64 features and one product take ~40 MB
BLOCK_ROWS = 2048
#: blocks a task works through for one block before it hands on its candidates
BLOCK_RUN = 256
#: stimuli from which first bin limits are taken; pairs handled together, and their numbers in all layers; pairs of a bin, about
PILOT, CHUNK_PAIRS, CHUNK_CELLS, BIN_PAIRS = 1024, 1 << 21, 1 << 24, 1 << 21
#: distances computed, or sorted, at a time
CACHED = 1 << 16
#: a bin with more than so many times its pairs is cut further; values that a task keeps of a bin, to cut it by
CROWDED, KEPT = 4, 64
#: decimals kept when two similarities or distances are compared
TIE_DECIMALS = 12


def _numbered(layers: Layers) -> tuple[DataFrame, DataFrame | None]:
    """``(stim, x)`` with integer stimuli; ids of another type are replaced by their numbers, given as ``(stim, i)``."""
    wide = layers.wide()
    if wide.schema["stim"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return wide, None
    index = stimulus_index(wide)
    return wide.join(index, "stim").select(F.col("i").cast("long").alias("stim"), "x"), index


def _block_pairs(layers: Layers, block_rows: int, ordered: bool, run: int) -> tuple[DataFrame, int]:
    """``(g1, g2, ids1, x1, ids2, x2)`` for every pair of blocks, and the number of stimuli.

    Unless ``ordered``, each unordered pair comes once (g1 <= g2).  A block
    meets ``run`` others in one task; longer rows of blocks are split up.
    """
    wide, _ = _numbered(layers)
    n = wide.count()
    # wide layers get smaller blocks: a block stays below 16 MB
    block_rows = max(64, min(block_rows, 2_000_000 // sum(layers.widths.values())))
    cores = wide.sparkSession.sparkContext.defaultParallelism
    # unordered pairs are of very unequal number in a task unless there are several for each core
    wanted = 4 * cores if ordered else max(ceil(sqrt(2 * cores)), min(ceil(sqrt(8 * cores)), n // 1024))
    blocks = max(1, ceil(n / block_rows), min(wanted, ceil(n / 256)))
    packed = (
        wide.groupBy(F.pmod(F.xxhash64("stim"), F.lit(blocks)).cast("int").alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("stim").cast("long").alias("stim"), "x"))).alias("rows"))
        .select("g", F.col("rows.stim").alias("ids"), F.flatten("rows.x").alias("x"))
    )
    runs = ceil(blocks / run)
    first = F.lit(0) if ordered else F.floor(F.col("g") / run).cast("int")
    left = packed.select(F.col("g").alias("g1"), F.col("ids").alias("ids1"), F.col("x").alias("x1"),
                         F.explode(F.sequence(first, F.lit(runs - 1))).alias("run"))
    partners = F.sequence(F.lit(0), F.lit(blocks - 1) if ordered else F.col("g"))
    right = packed.select(F.col("g").alias("g2"), F.col("ids").alias("ids2"), F.col("x").alias("x2"),
                          F.floor(F.col("g") / run).cast("int").alias("run"), F.explode(partners).alias("g1"))
    # an explicit partition count, because block pairs are few and heavy to
    # compute: coalescing them by size would put them all into one task
    parts = max(cores, min(blocks * runs, (16 if ordered else 64) * cores))
    joined = left.repartition(parts, "g1", "run").join(right.repartition(parts, "g1", "run"), ["g1", "run"])
    return joined.select("g1", "g2", "ids1", "x1", "ids2", "x2"), n


def _blocks(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for r in range(batch.num_rows):
            g1, g2 = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            sides = []
            for c in (2, 4):
                ids = batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                x = batch.column(c + 1)[r].values.to_numpy(zero_copy_only=False)
                sides.append((ids, x.reshape(len(ids), width).astype(np.float64, copy=False)))
            yield g1, g2, sides[0], sides[1]


def _slices(layers: Layers) -> list[slice]:
    ends = np.cumsum([0] + [layers.widths[n] for n in layers.names])
    return [slice(int(lo), int(hi)) for lo, hi in zip(ends, ends[1:])]


#: similarities closer than this may round to the same value
_SLACK = 10.0**-TIE_DECIMALS


def _top(similarity: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest rounded entries per row; ties go to the earlier column."""
    rows, cols = similarity.shape
    if cols <= k:
        return np.tile(np.arange(cols), (rows, 1))
    best = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    cut = np.take_along_axis(similarity, best, axis=1).min(axis=1)
    tied = np.flatnonzero((similarity >= cut[:, None] - _SLACK).sum(axis=1) > k)
    if len(tied):
        rounded = np.round(similarity[tied], TIE_DECIMALS)
        best[tied] = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    return best


def _merge(found: tuple[np.ndarray, np.ndarray], similarity: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k per row of ``found (similarity, id)`` and of a further block.

    Only entries that reach a row's present k-th similarity are looked at, which
    are few once some blocks have passed.
    """
    count, k = found[0].shape
    # np.nonzero of a matrix is several times slower than of its flat form
    row, col = np.divmod(np.flatnonzero(similarity >= found[0][:, -1:] - _SLACK), max(similarity.shape[1], 1))
    rows = np.concatenate([np.repeat(np.arange(count), k), row])
    sims = np.concatenate([found[0].ravel(), np.round(similarity[row, col], TIE_DECIMALS)])
    others = np.concatenate([found[1].ravel(), ids[col]])
    order = np.lexsort((others, -sims, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(count))[rows]
    order = order[place < k]
    return sims[order].reshape(count, k), others[order].reshape(count, k)


def nearest(layers: Layers, params: Params, block_rows: int = BLOCK_ROWS, run: int = BLOCK_RUN) -> DataFrame:
    """``(layer, ord, stim, neighbours)``: the k stimuli with the highest cosine, ids as they are in the layers' table."""
    found = _nearest(layers, params, block_rows, run)
    index = _numbered(layers)[1]
    if index is None:
        return found
    entries = found.select("layer", "ord", F.col("stim").alias("me"), F.posexplode("neighbours").alias("r", "other"))
    named = entries.join(index.select(F.col("i").cast("long").alias("other"), F.col("stim").alias("name")), "other")
    lists = named.groupBy("layer", "ord", "me").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("s"))
    return lists.join(index.select(F.col("i").cast("long").alias("me"), "stim"), "me").select("layer", "ord", "stim", F.col("s.name").alias("neighbours"))


def _nearest(layers: Layers, params: Params, block_rows: int = BLOCK_ROWS, run: int = BLOCK_RUN) -> DataFrame:
    """The same with numbers for ids that are no integers.

    The cosine is that of the conditioned matrix, whose noise shrinks it the
    more the shorter a vector is.  A stimulus is never its own neighbour; ties
    go to the smaller stimulus id.  A task carries the best k of one block
    through up to ``run`` other blocks and emits them when the next block comes, so it holds one block's.
    """
    names, cuts, width, k = layers.names, _slices(layers), sum(layers.widths.values()), params.k
    pairs, n = _block_pairs(layers, block_rows, ordered=True, run=run)
    nu = noise_level(n, params.noise_var, params.b)
    signal = 1 - nu if (params.b or params.noise_var is not None) else 1.0
    starts = np.array([c.start for c in cuts])

    def add_norms(block):
        return np.add.reduceat(block * block, starts, axis=1)

    # mean squared norm per layer: one number per layer, needed by every block
    mean_norm = np.ones(len(names))
    if params.normalize and nu:
        ones = outer_sums(
            layers.wide(), "x", width, augment=lambda z: np.hstack([np.ones((len(z), 1)), add_norms(z)])
        )
        for row in ones.where("i = 0 and j > 0").collect():
            mean_norm[row["j"] - 1] = row["s"] / n

    def unit(x: np.ndarray, layer: int) -> np.ndarray:
        part = x[:, cuts[layer]] * np.sqrt(signal / mean_norm[layer])
        return part / np.sqrt((part * part).sum(axis=1, keepdims=True) + nu)

    def improve(found: tuple, u: np.ndarray, w: np.ndarray, there: np.ndarray, same: bool) -> tuple:
        parts = []
        for lo in range(0, len(u), 512):
            sim = u[lo : lo + 512] @ w.T
            if same:
                sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -np.inf
            before = found[0][lo : lo + 512], found[1][lo : lo + 512]
            if np.isneginf(before[0]).all():
                columns = _top(sim, k)
                got, ids = before[0].copy(), before[1].copy()
                got[:, : columns.shape[1]] = np.round(np.take_along_axis(sim, columns, axis=1), TIE_DECIMALS)
                ids[:, : columns.shape[1]] = there[columns]
                parts.append(_merge((got, ids), sim[:, :0], there[:0]))  # sorts them
            else:
                parts.append(_merge(before, sim, there))
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    schema = pa.schema([("layer", pa.int32()), ("stim", pa.int64()), ("other", pa.int64()), ("sim", pa.float64())])

    def search(batches):
        best: dict = {}

        def leave():
            for (_, layer), (ids, (sim, other)) in best.items():
                keep = sim.ravel() > -np.inf
                columns = [
                    pa.array(np.full(keep.sum(), layer, np.int32)),
                    pa.array(np.repeat(ids, sim.shape[1])[keep]),
                    pa.array(other.ravel()[keep]),
                    pa.array(sim.ravel()[keep]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            best.clear()

        for g1, g2, (ids1, x1), (ids2, x2) in _blocks(batches, width):
            if best and (g1, 0) not in best:
                yield from leave()
            for layer in range(len(names)):
                none = np.full((len(ids1), k), -np.inf), np.zeros((len(ids1), k), np.int64)
                _, found = best.get((g1, layer), (None, none))
                best[(g1, layer)] = ids1, improve(found, unit(x1, layer), unit(x2, layer), ids2, g1 == g2)
        yield from leave()

    found = pairs.mapInArrow(search, "layer int, stim long, other long, sim double")
    order = Window.partitionBy("layer", "stim").orderBy(F.desc("sim"), "other")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    name = F.get(F.array(*[F.lit(x) for x in names]), F.col("layer"))
    # still partitioned by (layer, stim): no further exchange
    return (
        top.groupBy("layer", "stim")
        .agg(F.sort_array(F.collect_list(F.struct("r", "other"))).alias("s"))
        .select(name.alias("layer"), F.col("layer").alias("ord"), "stim", F.col("s.other").alias("neighbours"))
    )


def neighbour_similarity(layers: Layers, params: Params) -> DataFrame:
    """Mean Jaccard overlap of the neighbour sets of each stimulus."""
    sets = _nearest(layers, params).groupBy("stim").agg(
        F.sort_array(F.collect_list(F.struct("ord", "layer", "neighbours"))).alias("ls")
    )
    # one entry per layer pair and stimulus, summed up before it is shuffled
    last = F.size("ls")
    joined = (
        sets.select("ls", F.posexplode("ls").alias("p", "x"))
        .select(F.col("x").alias("x"), F.explode(F.slice("ls", F.col("p") + 2, last)).alias("y"))
        .select(
            F.col("x.layer").alias("a"),
            F.col("y.layer").alias("b"),
            (
                F.size(F.array_intersect("x.neighbours", "y.neighbours"))
                / F.size(F.array_union("x.neighbours", "y.neighbours"))
            ).alias("overlap"),
        )
    )
    return joined.groupBy("a", "b").agg(F.avg("overlap").alias("value")).select(
        F.lit("jaccard").alias("measure"), "a", "b", "value"
    )


def distances(layers: Layers, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(i, j, d)``: squared Euclidean distances of stimuli i < j, one per layer."""
    names, cuts, width = layers.names, _slices(layers), sum(layers.widths.values())
    pairs, _ = _block_pairs(layers, block_rows, ordered=False, run=1)

    def run(batches):
        for g1, g2, (ids1, x1), (ids2, x2) in _blocks(batches, width):
            same = g1 == g2
            for lo in range(0, len(ids1), 256):
                left, ids = x1[lo : lo + 256], ids1[lo : lo + 256]
                grid = np.empty((len(ids), len(ids2), len(names)))
                for c, cut in enumerate(cuts):
                    u, w = left[:, cut], x2[:, cut]
                    d = (u * u).sum(1)[:, None] + (w * w).sum(1) - 2 * (u @ w.T)
                    # equal vectors must give equal distances whatever the rounding
                    scale = np.maximum((u * u).sum(1)[:, None], (w * w).sum(1))
                    grid[:, :, c] = np.where(d < 1e-13 * scale, 0.0, d)
                keep = np.triu(np.ones((len(ids), len(ids2)), bool), lo + 1) if same else np.ones((len(ids), len(ids2)), bool)
                one, two = np.broadcast_to(ids[:, None], keep.shape)[keep], np.broadcast_to(ids2, keep.shape)[keep]
                values = pa.FixedSizeListArray.from_arrays(pa.array(grid[keep].ravel()), len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), values.cast(pa.list_(pa.float64()))],
                    names=["i", "j", "d"],
                )

    return pairs.mapInArrow(run, "i long, j long, d array<double>")


def _splitters(layers: Layers, bins: int) -> list[np.ndarray]:
    """Distances of each layer at even steps of their distribution among a bounded sample of stimuli.

    They only balance the work; any values give the same ranks.
    """
    rows = layers.wide().orderBy(F.xxhash64("stim"), "stim").limit(PILOT).select("x").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), -1)
    out = []
    for cut in _slices(layers):
        d = _distance(x[:, cut], x[:, cut])[np.triu_indices(len(x), 1)]
        out.append(np.unique(np.quantile(d, np.linspace(0, 1, bins + 1), method="nearest")) if len(d) else np.zeros(0))
    return out


def _distance(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    uu, ww, twice = (u * u).sum(1), (w * w).sum(1), -2 * u
    largest = np.fmax.reduce(ww, initial=0)
    d = np.empty((len(u), len(w)))
    # a few rows at a time, which stay in the processor's cache
    step = max(1, CACHED // max(len(w), 1))
    for lo in range(0, len(u), step):
        part, norms = d[lo : lo + step], uu[lo : lo + step, None]
        np.add(norms, ww, out=part)
        part += twice[lo : lo + step] @ w.T
        # equal vectors must give equal distances whatever the rounding; only distances as small as this are looked at
        row, col = np.divmod(np.flatnonzero(part < 1e-13 * np.fmax(np.fmax.reduce(norms, axis=None), largest)), max(len(w), 1))
        row, col = (x[part[row, col] < 1e-13 * np.maximum(norms[row, 0], ww[col])] for x in (row, col))
        part[row, col] = 0.0
    return d


def _bands(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
    """``(chunk, left, right, first)``: stimuli whose pairs are handled together.

    In a block with itself ``first`` is the place of the first left stimulus, and a pair counts once; else it is -1.
    """
    pairs = min(CHUNK_PAIRS, CHUNK_CELLS // count)
    for g1, g2, (_, x1), (_, x2) in _blocks(batches, width):
        step = max(1, pairs // max(len(x2), 1))
        for lo in range(0, len(x1), step):
            if g1 != g2 or lo + 1 < len(x2):
                yield f"{g1}:{g2}:{lo}", x1[lo : lo + step], x2, lo if g1 == g2 else -1


def _band_distances(left: np.ndarray, right: np.ndarray, first: int, cut: slice) -> np.ndarray:
    """Distances of the pairs of a band in one layer."""
    d = _distance(np.ascontiguousarray(left[:, cut]), np.ascontiguousarray(right[:, cut]))
    return d.ravel() if first < 0 else d[np.triu(np.ones(d.shape, bool), first + 1)]


def _chunks(batches: Iterator[pa.RecordBatch], cuts: list[slice], width: int, splitters: list[np.ndarray]):
    """``(chunk, layer, d, ends)``: sorted distances of some pairs of stimuli and where each bin ends among them.

    Bin 2k lies below splitter k, bin 2k + 1 is the splitter itself.
    """
    for chunk, left, right, first in _bands(batches, width, len(cuts)):
        for c, cut in enumerate(cuts):
            d = _band_distances(left, right, first, cut)
            d.sort()
            ends = np.full(2 * len(splitters[c]) + 1, len(d))
            ends[:-1:2], ends[1::2] = np.searchsorted(d, splitters[c], side="left"), np.searchsorted(d, splitters[c], side="right")
            yield chunk, c, d, ends


def _bin_counts(pairs: DataFrame, layers: Layers, splitters: list[np.ndarray]) -> DataFrame:
    """``(layer, bin, total)``; a task leaves one row per bin it has met."""
    cuts, width = _slices(layers), sum(layers.widths.values())

    def run(batches):
        counts = [np.zeros(2 * len(s) + 1, np.int64) for s in splitters]
        for _, c, _, ends in _chunks(batches, cuts, width, splitters):
            counts[c] += np.diff(ends, prepend=0)
        for c, n in enumerate(counts):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["layer", "bin", "n"])

    return pairs.mapInArrow(run, "layer int, bin int, n long").groupBy("layer", "bin").agg(F.sum("n").alias("total"))


def _bin_values(pairs: DataFrame, layers: Layers, splitters: list[np.ndarray], wanted: set[tuple[int, int]]) -> DataFrame:
    """``(layer, bin, some)``: up to ``KEPT`` values a task of each wanted bin, in even steps through what it has met."""
    cuts, width = _slices(layers), sum(layers.widths.values())

    def run(batches):
        some: dict[tuple[int, int], np.ndarray] = {}
        for _, c, d, ends in _chunks(batches, cuts, width, splitters):
            for layer, k in wanted:
                if layer == c:
                    found = np.concatenate([some.get((c, k), d[:0]), d[ends[k - 1] if k else 0 : ends[k]]])
                    some[c, k] = np.sort(found)[:: max(1, -(-len(found) // KEPT))]
        for (c, k), values in some.items():
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([k], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["layer", "bin", "some"])

    return pairs.mapInArrow(run, "layer int, bin int, some binary")


def _refined(pairs: DataFrame, layers: Layers, splitters: list[np.ndarray]) -> tuple[list[np.ndarray], DataFrame]:
    """Splitters that leave no bin of several values with more than ``CROWDED * BIN_PAIRS`` pairs, and the bins' totals.

    Crowded bins are cut by values that tasks have kept of them, in rounds; each round puts at least one splitter into every
    crowded bin, and a value that occurs very often soon has a bin of its own.
    """
    while True:
        totals = materialize(_bin_counts(pairs, layers, splitters), "bins")
        crowded = {(r["layer"], r["bin"]): r["total"] for r in totals.where((F.col("bin") % 2 == 0) & (F.col("total") > CROWDED * BIN_PAIRS)).collect()}
        if not crowded:
            return splitters, totals
        kept: dict[tuple[int, int], list[np.ndarray]] = {}
        for r in _bin_values(pairs, layers, splitters, set(crowded)).collect():
            kept.setdefault((r["layer"], r["bin"]), []).append(np.frombuffer(r["some"]))
        splitters = list(splitters)
        for key, parts in kept.items():
            cuts = np.quantile(np.concatenate(parts), np.linspace(0, 1, int(crowded[key] // BIN_PAIRS) + 2)[1:-1], method="nearest")
            splitters[key[0]] = np.union1d(splitters[key[0]], cuts)


def _pieces(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of ``values`` in pieces of so many values, without copying them."""
    offsets = np.append(0, np.cumsum(lengths)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(d: np.ndarray) -> bytes:
    """Sorted distances, whose steps as whole numbers take four or five bytes each, if they fit: no bit is lost.

    The first comes whole; four bytes of each step, then the fifth of each. Eight bytes a distance are kept as they are.
    """
    bits = d.view(np.int64)
    steps = np.diff(bits)
    # a bit pattern below another's is no step: distances are neither negative nor, but for NaN, out of order
    low, high = steps.min(initial=0), steps.max(initial=0)
    if low < 0 or high >= 1 << 40 or len(d) < 2:
        return d.tobytes()
    parts = [d[:1].tobytes(), steps.astype(np.uint32).tobytes()]
    return b"".join(parts if high < 1 << 32 else [*parts, (steps >> 32).astype(np.uint8).tobytes()])


def _unpacked(n: int, data: pa.Buffer) -> np.ndarray:
    """The distances that :func:`_packed` has packed, if any."""
    if len(data) in (0, 8 * n):
        return np.frombuffer(data, np.float64)
    bits = np.empty(n, np.int64)
    bits[:1] = np.frombuffer(data, np.int64, 1)
    bits[1:] = np.frombuffer(data, np.uint32, n - 1, 8)
    if len(data) == 8 + 5 * (n - 1):
        bits[1:] += np.frombuffer(data, np.uint8, n - 1, 4 + 4 * n).astype(np.int64) << 32
    return np.cumsum(bits, out=bits).view(np.float64)


def _binned_distances(pairs: DataFrame, layers: Layers, splitters: list[np.ndarray]) -> DataFrame:
    """``(chunk, layer, bin, n, d)``: sorted distances of a chunk of pairs by layer and bin.

    Which pairs they belong to is not kept: their order says it, once the distances are computed again.
    The distances of a splitter's own bin are all equal and need no sorting, so only their number is kept.
    """
    cuts, width = _slices(layers), sum(layers.widths.values())

    def run(batches):
        for chunk, c, d, ends in _chunks(batches, cuts, width, splitters):
            n = np.diff(ends, prepend=0)
            bins = np.flatnonzero(n)
            packed = [b"" if k % 2 else _packed(d[ends[k] - n[k] : ends[k]]) for k in bins]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(bins)), pa.array(np.full(len(bins), c, np.int32)), pa.array(bins.astype(np.int32)), pa.array(n[bins]), pa.array(packed, pa.binary())],
                ["chunk", "layer", "bin", "n", "d"],
            )

    return pairs.mapInArrow(run, "chunk string, layer int, bin int, n long, d binary")


def _order(d: np.ndarray) -> np.ndarray:
    """The order of the distances, as by ``argsort`` (equal ones in any order), by sorting their bits and places as whole numbers.

    Such numbers are sorted several times faster. What does not fit beside the place is cut off; distances that are equal without it are ordered anew.
    """
    if not len(d):
        return np.zeros(0, np.int64)
    bits, wide = d.view(np.uint64), max(len(d) - 1, 1).bit_length()
    low = bits.min()
    cut = max(0, int(bits.max() - low).bit_length() + wide - 64)
    key = bits - low
    key >>= np.uint64(cut)
    key <<= np.uint64(wide)
    key |= np.arange(len(d), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << wide) - 1)).view(np.int64)
    if cut:
        key >>= np.uint64(wide)
        same = key[1:] == key[:-1]
        open_ = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(open_) > len(d) // 16:
            return np.argsort(d)
        order[open_] = order[open_][np.lexsort((bits[order[open_]], key[open_]))]
    return order


def _doubled_ranks(parts: list[np.ndarray]) -> np.ndarray:
    """Twice the mean rank of each value among all parts, one part after the other.

    Many values come in sorted parts. These are cut at common values into ranges that stay in the processor's cache while they are sorted.
    """
    d = np.concatenate(parts)
    ranges = min(len(d) // CACHED, len(d) // (256 * len(parts)))
    if ranges < 2:
        return _sorted_doubled_ranks(d)
    sample = np.sort(d[:: max(1, len(d) // (64 * ranges))])
    cuts = np.unique(sample[len(sample) * np.arange(1, ranges) // ranges])
    starts = np.cumsum([0] + [len(x) for x in parts])
    # equal values fall in the same range
    edges = np.stack([np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]) + start for x, start in zip(parts, starts)])
    twice, before = np.empty(len(d), np.int32), 0
    for lows, highs in zip(edges.T[:-1].tolist(), edges.T[1:].tolist()):
        ranks = _sorted_doubled_ranks(np.concatenate([d[lo:hi] for lo, hi in zip(lows, highs)]))
        ranks += 2 * before
        at = 0
        for lo, hi in zip(lows, highs):
            twice[lo:hi] = ranks[at : at + hi - lo]
            at += hi - lo
        before += len(ranks)
    return twice


def _sorted_doubled_ranks(d: np.ndarray) -> np.ndarray:
    # equal distances get equal ranks, so their order is of no account
    order = _order(d)
    value = d[order]
    tied = (value[1:] == value[:-1]) | np.isnan(value[:-1])
    twice = np.empty(len(d), np.int32)
    if tied.any():
        first = np.flatnonzero(np.append(True, ~tied))
        size = np.diff(np.append(first, len(d)))
        twice[order] = np.repeat(2 * first + size + 1, size)
    else:
        twice[order] = np.arange(2, 2 * len(d) + 2, 2, dtype=np.int32)
    return twice


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean ranks inside each (layer, bin); its parts arrive one after the other.

    A rank is ``base`` and half of its entry in ``place``, four bytes a pair; in a bin with one value all have the rank ``base``.
    The other columns stay as they are.
    """

    def finish(rows: list[pa.RecordBatch], values: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        first, n = table.slice(0, 1).to_pylist()[0], table.column("n").to_numpy()
        if first["bin"] % 2:
            base, twice, lengths = first["before"] + (first["total"] + 1) / 2, np.zeros(0, np.int32), np.zeros(len(n), int)
        else:
            base, twice, lengths = float(first["before"]), _doubled_ranks(values), n
        kept = [c for c in table.schema.names if c not in ("total", "before", "d")]
        return pa.RecordBatch.from_arrays([*(table.column(c) for c in kept), pa.array(np.full(len(n), base)), _pieces(twice, lengths)], [*kept, "base", "place"])

    rows, values, held = [], [], None
    for batch in batches:
        layer, bin_ = batch.column("layer").to_numpy(), batch.column("bin").to_numpy()
        starts = np.flatnonzero(np.append(True, (layer[1:] != layer[:-1]) | (bin_[1:] != bin_[:-1]))) if len(layer) else []
        d = [_unpacked(n, x.as_buffer()) for n, x in zip(batch.column("n").to_pylist(), batch.column("d"))]
        for lo, hi in zip(starts, [*starts[1:], len(layer)]):
            # parts of a one-valued bin need not wait for each other
            if rows and ((layer[lo], bin_[lo]) != held or bin_[lo] % 2):
                yield finish(rows, values)
                rows, values = [], []
            held = layer[lo], bin_[lo]
            rows.append(batch.slice(lo, hi - lo).select([c for c in batch.schema.names if c != "d"]))
            values += d[lo:hi]
    if rows:
        yield finish(rows, values)


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a chunk in a bin ascend: the first goes to ``base``, and the steps to the others into two bytes each, if they fit."""
    for batch in batches:
        base, places = batch.column("base").to_numpy().copy(), []
        for r, place in enumerate(batch.column("place")):
            twice = np.frombuffer(place.as_buffer(), np.int32)
            if len(twice):
                base[r] += twice[0] / 2
                steps = np.diff(twice)
                places.append(steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.int32).tobytes())
            else:
                places.append(b"")
        columns = [batch.column(c) for c in ("chunk", "layer", "bin", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(base), pa.array(places, pa.binary())], ["chunk", "layer", "bin", "n", "base", "place"])


def _unstepped(n: int, base: float, steps: bytes) -> np.ndarray:
    """The ranks that :func:`_stepped` has packed; without steps all are equal."""
    if not len(steps):
        return np.full(n, base)
    ranks = np.empty(n)
    ranks[0] = base
    np.multiply(np.frombuffer(steps, np.uint16 if len(steps) == 2 * (n - 1) else np.int32), 0.5, out=ranks[1:])
    # sums of halves far below 2^52: exact
    return np.cumsum(ranks, out=ranks)


def _rank_products(cuts: list[slice], width: int):
    """Sums of products of the ranks; a chunk's stimuli arrive before its ranks, these by layer and bin."""
    count = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((count, count)), 0
        left, right, first = np.zeros((0, width)), None, -1
        at, z, ranks = (None, -1), np.zeros((count, 0)), []

        def place() -> None:
            nonlocal z
            layer = at[1]
            if layer < 0:
                return
            d = _band_distances(left, right, first, cuts[layer])
            if layer == 0:
                z = np.empty((count, len(d)))
            # as many ranks in ascending order as there are pairs, else this fails
            z[layer, _order(d)] = np.concatenate([_unstepped(*r) for r in ranks])
            if layer == count - 1:
                sums[:] += z @ z.T

        for batch in batches:
            for r, (chunk, layer, bin_, m, base) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "layer", "bin", "n", "base")))):
                if (chunk, layer) != at:
                    place()
                    at, ranks = (chunk, layer), []
                data = batch.column("place")[r].as_buffer()
                if layer >= 0:
                    ranks.append((m, base, data))
                    n += m if layer == 0 else 0
                elif bin_ == 0:
                    left, first = np.frombuffer(data).reshape(-1, width), m
                else:
                    right = np.frombuffer(data).reshape(-1, width)
        place()
        i, j = np.triu_indices(count, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j]), pa.array(np.full(len(i), n))], ["i", "j", "s", "n"])

    return run


def rank_similarity(layers: Layers) -> DataFrame:
    """Spearman correlation of the distances, without tie correction.

    Neither trace normalisation nor added noise changes the order of the distances, so the raw vectors are used.

    Distances are computed block by block. Those of a chunk of pairs are sorted and travel to their bins, where the sorted parts of
    all chunks give the ranks; these travel back in the same order to their chunk, where the distances are computed
    once more to say which pair has which rank, the ranks of all layers meet and
    only sums of products go on. Bins follow the distribution of the distances and are cut until none is crowded, so a task sorts
    a bounded number of them; their number grows with the pairs.
    """
    names, cuts, width = layers.names, _slices(layers), sum(layers.widths.values())
    spark = layers.df.sparkSession
    small_batches(spark)
    pairs, n_stimuli = _block_pairs(layers, BLOCK_ROWS, ordered=False, run=1)
    bins = int(max(64, n_stimuli * n_stimuli / 2 // BIN_PAIRS))
    splitters, totals = _refined(pairs, layers, _splitters(layers, bins))
    # 64 MB of distances a task, or all cores
    tasks = int(max(8 * spark.sparkContext.defaultParallelism, n_stimuli * n_stimuli / 2 * len(names) * 8 // (64 << 20)))
    # the distances are computed three times: cheaper than keeping all pairs until they are counted, or sending their places
    parts = _binned_distances(pairs, layers, splitters)
    before = Window.partitionBy("layer").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    spread = F.when(F.col("bin") % 2 == 1, F.xxhash64("chunk")).otherwise(0)
    located = parts.join(totals, ["layer", "bin"]).repartition(tasks, "layer", "bin", spread).sortWithinPartitions("layer", "bin")
    columns, packed = ["chunk", "layer", "bin", "n", "total", "before", "d"], "chunk string, layer int, bin int, n long, base double, place binary"
    ranked = located.select(*columns).mapInArrow(lambda batches: _stepped(_ranked(batches)), packed)

    def stimuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, left, right, first in _bands(batches, width, len(cuts)):
            columns = [pa.array([chunk] * 2), pa.array([-1, -1], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([first] * 2, pa.int64()), pa.array([0.0, 0.0])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([left.tobytes(), right.tobytes()], pa.binary())], ["chunk", "layer", "bin", "n", "base", "place"])

    met = pairs.mapInArrow(stimuli, packed).unionByName(ranked).repartition(tasks, "chunk").sortWithinPartitions("chunk", "layer", "bin")
    products = met.mapInArrow(_rank_products(cuts, width), "i int, j int, s double, n long")
    sums = products.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").cast("double").alias("n"))
    # ranks of n values always sum to n (n + 1) / 2, so only n is needed to centre
    name, n = F.array(*[F.lit(x) for x in names]), F.col("n")
    return sums.select(
        F.lit("rsarank").alias("measure"),
        F.get(name, F.col("i")).alias("a"),
        F.get(name, F.col("j")).alias("b"),
        (12 * (F.col("s") - n * (n + 1) * (n + 1) / 4) / (n * n * n - n)).alias("value"),
    )
