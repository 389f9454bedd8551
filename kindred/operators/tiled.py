"""Gram matrices too large for a task: built, conditioned, factorised and compared as tables of square tiles.

Rows are ``(layer, r, c, cells)`` with r >= c: tiles of the lower triangle, row-major doubles; the last tile of a row is
smaller. A task holds a few tiles, whatever the number of stimuli. The Cholesky factorisation is left-looking: for each
column of tiles, the earlier columns' products come together at the tiles of this column, and the finished column is written once to
the shared folder. Inverses go row by row in the same way. A matrix with T rows of tiles takes 3 T small jobs to factorise and 2 T to invert, over
all layers at once; each job exchanges the tiles that its products need. Symmetrised KL inverts each layer once, and a pair
of layers costs no more than its tiles; Bhattacharyya and Hellinger factorise the middle of each pair.

From the factors follow the log-determinants and traces of the Gaussian measures. A matrix that is not positive
definite has factors of NaN, and measures that need them are NULL.

The work is cubic in the stimuli. Layers of few features need none of it: beside the noise their matrices have no more dimensions than
features, so :func:`compare_features` forms second moments of the features instead, and tiles only for more features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.scalars import noise_level
from kindred.operators.layer_compare import compare_layers
from kindred.plans.registry import Params, resolve_all
from kindred.session import scratch_path, small_batches
from kindred.sources.activations import Layers

#: stimuli of a tile: 8 MB each
SIDE = 1024
#: features of a block, about: a strip holds at most so many values of every stimulus
_BLOCK_FEATURES = 256
#: features of all layers together up to which their moments take the place of tiles
FEW_FEATURES = 1024
#: partitions of the exchange that forms tiles, at most
_MAX_PARTS = 4096
_TILE = "layer string, r int, c int, cells binary"
_MEASURES = ("kldiv", "bhattacharyya", "hellinger")

Batches = Iterator[pa.RecordBatch]


def _size(dim: int, side: int, k: int) -> int:
    """Stimuli of tile row k."""
    return min(side, dim - k * side)


def _tile(cells: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cells).reshape(rows, -1)


def _row(layer: str, r: int, c: int, tile: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([layer]), pa.array([r], pa.int32()), pa.array([c], pa.int32()), pa.array([np.ascontiguousarray(tile).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["layer", "r", "c", "cells"])


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back; row groups are closed by bytes after every row, since a row may have megabytes."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    options = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tile_side(dim: int) -> int:
    """Stimuli of a tile for a matrix of ``dim``: eight rows of tiles, each tile between 2 MB and 32 MB.

    What the factorisation exchanges falls with the side, what a task holds (a few tiles) grows with its square.
    """
    return min(2048, max(512, -(-dim // 8)))


def tiles_from_features(acts: DataFrame, index: DataFrame, dim: int, side: int = SIDE) -> DataFrame:
    """Tiles of the uncentred second moments of ``acts (layer, stim, feat, v)``; ``index (stim, i)`` numbers the stimuli.

    Stimuli are cut into strips and features dealt into blocks. The strips of a tile's two sides come together at the tile, block after block,
    and their products are added up there, so that no unfinished tile is exchanged; a strip goes to each tile of its row and column. Where
    there are fewer tiles than cores, the blocks of a tile are dealt over salts and the salts' tiles are added. Absent
    activations count as zero, and every tile is there.
    """
    small_batches(acts.sparkSession)
    count = -(-dim // side)
    tiles = count * (count + 1) // 2
    blocks = max(1, -(-acts.agg(F.approx_count_distinct("feat")).first()[0] // _BLOCK_FEATURES))
    salts = min(blocks, max(1, -(-acts.sparkSession.sparkContext.defaultParallelism // tiles)))
    block = F.pmod(F.xxhash64("feat"), F.lit(blocks)).cast("int")
    cells = acts.join(index, "stim").select(
        F.col("layer").cast("string").alias("layer"), block.alias("block"), F.expr(f"cast(i div {side} as int)").alias("s"), F.struct(F.xxhash64("feat").alias("f"), (F.col("i") % side).cast("int").alias("i"), F.col("v").cast("double").alias("v")).alias("x")
    )
    strips = cells.groupBy("layer", "block", "s").agg(F.collect_list("x").alias("x"))
    # a strip is the left side of the tiles of its row, and the right side of those of its column; on the diagonal it is both and goes once
    place = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    sent = strips.select("layer", "block", "s", place.alias("t"), "x").select(
        "layer", F.greatest("s", "t").alias("r"), F.least("s", "t").alias("c"), F.pmod("block", F.lit(salts)).alias("salt"), "block", (F.col("t") > F.col("s")).cast("int").alias("right"), "x"
    )
    every = acts.select(F.col("layer").cast("string").alias("layer")).distinct().select("layer", place.alias("r")).select("layer", "r", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("c"))
    nothing = F.array().cast(sent.schema["x"].dataType)
    sent = sent.unionByName(every.select("*", F.lit(0).alias("salt"), F.lit(-1).alias("block"), F.lit(0).alias("right"), nothing.alias("x")))

    def matrix(x, rows: int, names: np.ndarray) -> np.ndarray:
        f, i, v = (x.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        at = np.minimum(np.searchsorted(names, f), len(names) - 1)
        there = names[at] == f
        out = np.zeros((rows, len(names)))
        np.add.at(out, (i[there], at[there]), v[there])
        return out

    def product(x, y, r: int, c: int):
        names = np.unique(x.field(0).to_numpy())
        if r != c:
            names = np.intersect1d(names, y.field(0).to_numpy())
        if not len(names):
            return 0.0
        one = matrix(x, _size(dim, side, r), names)
        return one @ (one if r == c else matrix(y, _size(dim, side, c), names)).T

    def sums(batches: Batches) -> Batches:
        at, total, left = None, None, (None, None)
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in ("layer", "r", "c", "salt", "block", "right")))
            for (layer, r, c, salt, block, right), x in zip(keys, batch.column("x")):
                if (layer, r, c, salt) != at:
                    if at is not None:
                        yield _row(*at[:3], total)
                    at, total = (layer, r, c, salt), np.zeros((_size(dim, side, r), _size(dim, side, c)))
                if r == c:
                    total += product(x.values, x.values, r, c)
                elif not right:
                    left = (at, block), x.values
                elif left[0] == (at, block):
                    total += product(left[1], x.values, r, c)
        if at is not None:
            yield _row(*at[:3], total)

    # the number is given, since the strips are small beside the tiles they make
    keys = ["layer", "r", "c", "salt"]
    parts = sent.repartition(min(tiles * salts, _MAX_PARTS), *keys).sortWithinPartitions(*keys, "block", "right").mapInArrow(sums, _TILE)
    return parts if salts == 1 else _summed(parts, dim, side)


def _summed(parts: DataFrame, dim: int, side: int) -> DataFrame:
    """Sums of equal tiles."""

    def add(batches: Batches) -> Batches:
        at, total = None, None
        for batch in batches:
            for layer, r, c, cells in zip(*(x.to_pylist() for x in batch.columns)):
                if (layer, r, c) != at:
                    if at is not None:
                        yield _row(*at, total)
                    at, total = (layer, r, c), np.zeros((_size(dim, side, r), _size(dim, side, c)))
                total += _tile(cells, len(total))
        if at is not None:
            yield _row(*at, total)

    keys = ["layer", "r", "c"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, _TILE)


def condition_tiles(tiles: DataFrame, dim: int, side: int = SIDE, noise_var: float | None = None, b: float = 0.01, normalize: bool = True) -> DataFrame:
    """Trace-normalised tiles with noise on the diagonal, like :func:`kindred.operators.gram.condition`."""

    def traces(batches: Batches) -> Batches:
        for batch in batches:
            for layer, r, _, cells in zip(*(x.to_pylist() for x in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([float(np.trace(_tile(cells, _size(dim, side, r))))])], ["layer", "trace"])

    # one number per layer
    trace = tiles.where("r = c").mapInArrow(traces, "layer string, trace double").groupBy("layer").agg(F.sum("trace").alias("trace"))
    nu = noise_level(dim, noise_var, b) if b or noise_var is not None else 0.0

    def scaled(batches: Batches) -> Batches:
        for batch in batches:
            for layer, r, c, cells, total in zip(*(x.to_pylist() for x in batch.columns)):
                tile = _tile(cells, _size(dim, side, r)) * ((1 - nu) * (dim / total if normalize else 1.0))
                yield _row(layer, r, c, tile + nu * np.eye(len(tile)) if r == c else tile)

    return tiles.join(F.broadcast(trace), "layer").select("layer", "r", "c", "cells", "trace").mapInArrow(scaled, _TILE)


def _meeting(parts: list[DataFrame], task, schema: str = _TILE) -> DataFrame:
    """Rows ``(layer, at, j, side, cells)`` brought together by (layer, at), in the order of (j, side), and handed to ``task``."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.repartition("layer", "at").sortWithinPartitions("layer", "at", "j", "side").mapInArrow(task, schema)


def _groups(batches: Batches):
    """``(layer, at, rows)`` with rows an iterator of (j, side, cells), one group after the other."""

    def rows():
        for batch in batches:
            yield from zip(*(x.to_pylist() for x in batch.select(["layer", "at", "j", "side", "cells"]).columns))

    stream = rows()
    head = next(stream, None)
    while head is not None:
        layer, at = head[:2]
        done: list = []

        def own(first=head):
            yield first[2:]
            for row in stream:
                if row[:2] != (layer, at):
                    done.append(row)
                    return
                yield row[2:]

        group = own()
        yield layer, at, group
        for _ in group:  # whatever the task has left
            pass
        head = done[0] if done else None


def _reduced(group, rows: int) -> np.ndarray:
    """The first tile of a group less the products of the pairs of tiles that follow."""
    total, left = None, None  # without a first tile it counts as zero
    for j, side, cells in group:
        if j < 0:
            total = _tile(cells, rows).copy()
        elif side == 0:
            left = cells
        else:
            right = np.frombuffer(cells)
            one = _tile(left, rows)
            product = one @ right.reshape(-1, one.shape[1]).T
            total = -product if total is None else total - product
    return total


def cholesky(tiles: DataFrame, dim: int, side: int = SIDE) -> tuple[list[DataFrame], list[DataFrame]]:
    """Columns of the lower factor, and the inverses of its diagonal tiles ``(layer, r, c, cells)``; all are written tables."""
    tiles = _written(tiles, "tiles")
    count, columns, inverses = -(-dim // side), [], []
    for k in range(count):
        # tiles (i, k) less the products of rows i and k of the earlier columns
        parts = [tiles.where(f"c = {k}").select("layer", F.col("r").alias("at"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "cells")]
        for j, column in enumerate(columns):
            below = column.where(f"r >= {k}")
            parts.append(below.select("layer", F.col("r").alias("at"), F.lit(j).alias("j"), F.lit(0).alias("side"), "cells"))
            row = below.where(f"r = {k}").select("layer", F.explode(F.sequence(F.lit(k), F.lit(count - 1))).alias("at"), F.lit(j).alias("j"), F.lit(1).alias("side"), "cells")
            parts.append(row)

        def panel(batches: Batches, k=k) -> Batches:
            for layer, i, group in _groups(batches):
                yield _row(layer, i, k, _reduced(group, _size(dim, side, i)))

        reduced = _written(_meeting(parts, panel), "panel")

        def root(batches: Batches, k=k) -> Batches:
            for batch in batches:
                for layer, cells in zip(batch.column("layer").to_pylist(), batch.column("cells").to_pylist()):
                    a = _tile(cells, _size(dim, side, k))
                    try:
                        low = np.linalg.cholesky((a + a.T) / 2)
                        inverse = np.linalg.inv(low)
                    except np.linalg.LinAlgError:
                        low = inverse = np.full_like(a, np.nan)
                    yield _row(layer, k, k, low)
                    yield _row(layer, k, -1, inverse)

        diagonal = _written(reduced.where(f"r = {k}").mapInArrow(root, _TILE), "diagonal")
        inverses.append(diagonal.where("c < 0"))

        def finish(batches: Batches, k=k) -> Batches:
            for batch in batches:
                for layer, i, cells, inverse in zip(*(x.to_pylist() for x in batch.columns)):
                    yield _row(layer, i, k, _tile(cells, _size(dim, side, i)) @ np.tril(_tile(inverse, _size(dim, side, k))).T)

        below = reduced.where(f"r > {k}").join(diagonal.where("c < 0").select("layer", F.col("cells").alias("inverse")), "layer")
        lower = below.select("layer", "r", "cells", "inverse").mapInArrow(finish, _TILE)
        columns.append(_written(lower.unionByName(diagonal.where("c >= 0")), "column"))
    return columns, inverses


def log_determinants(columns: list[DataFrame], dim: int, side: int = SIDE) -> DataFrame:
    """``(layer, logdet)`` from a lower factor."""

    def logs(batches: Batches) -> Batches:
        for batch in batches:
            for layer, r, cells in zip(*(x.to_pylist() for x in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([2 * float(np.log(np.diag(_tile(cells, _size(dim, side, r)))).sum())])], ["layer", "part"])

    diagonal = columns[0].where("r = 0")
    for k, column in enumerate(columns[1:], 1):
        diagonal = diagonal.unionByName(column.where(f"r = {k}"))
    return diagonal.select("layer", "r", "cells").mapInArrow(logs, "layer string, part double").groupBy("layer").agg(F.sum("part").alias("logdet"))


def inverted(columns: list[DataFrame], inverses: list[DataFrame], dim: int, side: int = SIDE) -> DataFrame:
    """Tiles of the inverse matrices, lower triangle, from :func:`cholesky`; a written table.

    First Y = inverse(L), row by row: row i needs row i of L and the earlier rows of Y, and its tiles (i, k) are the targets of step i. Then the
    inverse is Y^T Y, a row of tiles a step.
    """
    count = -(-dim // side)
    rows: list[DataFrame] = []
    for i in range(count):
        targets = F.explode(F.sequence(F.lit(0), F.lit(i)))
        parts = [inverses[i].select("layer", targets.alias("at"), F.lit(count).alias("j"), F.lit(2).alias("side"), "cells")]
        for j in range(i):
            below = F.explode(F.sequence(F.lit(0), F.lit(j)))
            parts.append(columns[j].where(f"r = {i}").select("layer", below.alias("at"), F.lit(j).alias("j"), F.lit(0).alias("side"), "cells"))
            # transposed, so that all steps multiply alike
            parts.append(rows[j].select("layer", F.col("c").alias("at"), F.lit(j).alias("j"), F.lit(1).alias("side"), "cells"))

        def solved(batches: Batches, i=i) -> Batches:
            n = _size(dim, side, i)
            for layer, k, group in _groups(batches):
                last = None

                def products():
                    nonlocal last
                    for row in group:
                        if row[1] == 2:
                            last = row[2]
                        else:
                            yield row

                reduced = _reduced(products(), n)
                own = np.tril(_tile(last, n))
                yield _row(layer, i, k, (own if reduced is None else own @ reduced).T)

        rows.append(_written(_meeting(parts, solved), "solved"))

    found: list[DataFrame] = []
    for r in range(count):
        parts = []
        for i in range(r, count):
            targets = F.explode(F.sequence(F.lit(0), F.lit(r)))
            parts.append(rows[i].where(f"c = {r}").select("layer", targets.alias("at"), F.lit(i).alias("j"), F.lit(0).alias("side"), "cells"))
            parts.append(rows[i].where(f"c <= {r}").select("layer", F.col("c").alias("at"), F.lit(i).alias("j"), F.lit(1).alias("side"), "cells"))

        def squared(batches: Batches, r=r) -> Batches:
            for layer, c, group in _groups(batches):
                yield _row(layer, r, c, -_reduced(group, _size(dim, side, r)))

        found.append(_written(_meeting(parts, squared), "inverse"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def trace_ratios(tiles: DataFrame, inverse: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, trace)``: trace of inverse(S_b) S_a for ``pairs (a, b)``, the sum of the products of their cells.

    Layers are inverted once each, whatever the number of pairs; a pair costs one meeting of equal tiles.
    """
    one = tiles.select(F.col("layer").alias("a"), "r", "c", F.col("cells").alias("x"))
    two = inverse.select(F.col("layer").alias("b"), "r", "c", F.col("cells").alias("y"))

    def products(batches: Batches) -> Batches:
        for batch in batches:
            # a tile beside the diagonal stands for two
            sums = [
                (1 if r == c else 2) * float(np.frombuffer(x) @ np.frombuffer(y))
                for r, c, x, y in zip(*(batch.column(k).to_pylist() for k in ("r", "c", "x", "y")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sums)], ["a", "b", "part"])

    met = pairs.join(one, "a").join(two, ["b", "r", "c"]).select("a", "b", "r", "c", "x", "y")
    return met.mapInArrow(products, "a string, b string, part double").groupBy("a", "b").agg(F.sum("part").alias("trace"))


def compare_tiles(tiles: DataFrame, dim: int, measures, side: int = SIDE, **options) -> DataFrame:
    """``(measure, a, b, value)`` for every pair a < b of layers: symmetrised KL, Bhattacharyya, Hellinger.

    ``tiles`` are raw Gram tiles of one size; options are those of :class:`kindred.plans.registry.Params`.
    """
    wanted, params = resolve_all(measures), Params(**options)
    unknown = [m.name for m in wanted if m.name not in _MEASURES]
    if unknown:
        raise NotImplementedError(f"not available on tiles: {unknown}")
    ready = _written(condition_tiles(tiles, dim, side, params.noise_var, params.b, params.normalize), "conditioned")
    names = ready.select("layer").distinct()
    pairs = _written(names.select(F.col("layer").alias("a")).join(names.select(F.col("layer").alias("b")), F.col("a") < F.col("b")), "pairs")
    columns, inverses = cholesky(ready, dim, side)
    parts = []
    if any(m.name != "kldiv" for m in wanted):
        one, two = (ready.select(F.col("layer").alias(n), "r", "c", F.col("cells").alias(f"cells_{n}")) for n in "ab")

        def middle(batches: Batches) -> Batches:
            for batch in batches:
                for layer, r, c, x, y in zip(*(v.to_pylist() for v in batch.columns)):
                    yield _row(layer, r, c, (_tile(x, _size(dim, side, r)) + _tile(y, _size(dim, side, r))) / 2)

        both = pairs.join(one, "a").join(two, ["b", "r", "c"]).select(F.format_string("%s\\u0001%s", "a", "b").alias("layer"), "r", "c", "cells_a", "cells_b")
        mid = log_determinants(cholesky(both.mapInArrow(middle, _TILE), dim, side)[0], dim, side).select(F.col("layer").alias("pair"), F.col("logdet").alias("mid"))
        own = log_determinants(columns, dim, side)
        found = pairs.withColumn("pair", F.format_string("%s\\u0001%s", "a", "b")).join(mid, "pair")
        for n in "ab":
            found = found.join(own.select(F.col("layer").alias(n), F.col("logdet").alias(f"log_{n}")), n)
        distance = F.greatest(0.5 * (F.col("mid") - 0.5 * (F.col("log_a") + F.col("log_b"))), F.lit(0.0))
        found = _written(found.select("a", "b", F.when(~F.isnan("mid") & ~F.isnan("log_a") & ~F.isnan("log_b"), distance).alias("d")), "logdets")
        for m in wanted:
            if m.name != "kldiv":
                value = F.col("d") if m.name == "bhattacharyya" else F.sqrt(-F.expm1(-F.col("d")))
                parts.append(found.select(F.lit(m.name).alias("measure"), "a", "b", value.alias("value")))
    if any(m.name == "kldiv" for m in wanted):
        ordered = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        traces = trace_ratios(ready, inverted(columns, inverses, dim, side), ordered).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("trace").alias("t"))
        divergence = F.greatest(0.25 * F.col("t") - dim / 2, F.lit(0.0))
        parts.append(traces.select(F.lit("kldiv").alias("measure"), "a", "b", F.when(~F.isnan("t"), divergence).alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _wide_layers(acts: DataFrame, index: DataFrame, features: list) -> Layers:
    """The activations as one row per stimulus of the index; absent ones are zero, and those given twice are added."""
    spark = acts.sparkSession
    places = spark.createDataFrame([(*f, p) for p, f in enumerate(features)], acts.select("layer", "feat").schema.add("p", "integer"))
    placed = acts.alias("x").join(F.broadcast(places).alias("y"), F.col("x.layer").eqNullSafe(F.col("y.layer")) & F.col("x.feat").eqNullSafe(F.col("y.feat")))
    sums = placed.groupBy("stim", "p").agg(F.sum(F.col("v").cast("double")).alias("v"))
    entries = sums.groupBy("stim").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0)))
    rows = index.join(entries, "stim", "left").select(F.col("i").alias("stim"), every.alias("x"))
    columns, widths = {}, {}
    for name in dict.fromkeys(str(f["layer"]) for f in features):
        own = [p for p, f in enumerate(features) if str(f["layer"]) == name]
        columns[name], widths[name] = F.slice("x", own[0] + 1, len(own)), len(own)
    return Layers(rows, "stim", columns, widths, F.col("x"))


def compare_features(acts: DataFrame, index: DataFrame, dim: int, measures, **options) -> DataFrame:
    """The values of :func:`compare_tiles` for ``acts (layer, stim, feat, v)`` over all stimuli of ``index (stim, i)``.

    Up to :data:`FEW_FEATURES` features, the stimuli are read once and never meet each other; with more, tiles are formed.
    """
    wanted = resolve_all(measures)
    features = acts.select("layer", "feat").distinct().limit(FEW_FEATURES + 1).collect()
    if len(features) > FEW_FEATURES or len({f["layer"] for f in features}) < 2 or any(m.name not in _MEASURES for m in wanted):
        side = tile_side(dim)
        return compare_tiles(tiles_from_features(acts, index, dim, side), dim, measures, side, **options)
    features.sort(key=lambda f: (str(f["layer"]), str(f["feat"])))
    return compare_layers(_wide_layers(acts, index, features), measures, **options)
