import numpy as np
import pytest
from conftest import random_cov
from test_compare import values

from kindred.operators import tiled as T
from kindred.operators.gram_compare import compare_gram
from kindred.operators import gram as G

NAMES = ["kldiv", "bhattacharyya", "hellinger"]


def acts_of(spark, n=23, features=9, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(layer, f"s{i:03d}", f, float(v)) for layer in "abc" for i in range(n) for f, v in enumerate(rng.standard_normal(features)) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "layer string, stim string, feat int, v double")


@pytest.mark.parametrize("side", [5, 8, 23, 100])
def test_tiles_equal_whole_matrices(spark, side):
    acts = acts_of(spark)
    index = G.stimulus_index(acts)
    dim = index.count()
    whole = {(r.layer, r.i, r.j): r.v for r in G.gram_from_features(acts, index, dim).collect()}
    tiles = T.tiles_from_features(acts, index, dim, side)
    got = {}
    for t in tiles.collect():
        cells = np.frombuffer(t.cells).reshape(T._size(dim, side, t.r), -1)
        for (i, j), v in np.ndenumerate(cells):
            got[t.layer, t.r * side + i, t.c * side + j] = v
    assert all(whole[k] == pytest.approx(v, abs=1e-12) for k, v in got.items())
    assert {(k[0], *sorted(k[1:])) for k in got} == {(k[0], *sorted(k[1:])) for k in whole}


@pytest.mark.parametrize("side", [8, 23])
def test_blocks_and_salts_of_many_features(spark, side):
    """A thousand features are several blocks; one tile, and fewer tiles than cores, are dealt over salts."""
    acts = acts_of(spark, features=1000, seed=5)
    index = G.stimulus_index(acts)
    order = [r.stim for r in index.orderBy("i").collect()]
    rows = {layer: np.zeros((23, 1000)) for layer in "abc"}
    for r in acts.collect():
        rows[r.layer][order.index(r.stim), r.feat] = r.v
    tiles = T.tiles_from_features(acts, index, 23, side).collect()
    assert len(tiles) == len({(t.layer, t.r, t.c) for t in tiles}) == 3 * (6 if side == 8 else 1)
    for t in tiles:
        cells = np.frombuffer(t.cells).reshape(T._size(23, side, t.r), -1)
        want = rows[t.layer] @ rows[t.layer].T
        assert np.allclose(cells, want[t.r * side :, t.c * side :][: cells.shape[0], : cells.shape[1]], atol=1e-10)


def test_side_of_tiles():
    assert [T.tile_side(n) for n in (1, 1000, 8000, 15000, 10**6)] == [512, 512, 1000, 1875, 2048]


@pytest.mark.parametrize("side", [7, 12])
def test_measures_equal_those_of_whole_matrices(spark, side):
    acts = acts_of(spark, seed=2)
    index = G.stimulus_index(acts)
    dim = index.count()
    want = values(compare_gram(G.gram_from_features(acts, index, dim), NAMES, b=0.05))
    got = values(T.compare_tiles(T.tiles_from_features(acts, index, dim, side), dim, NAMES, side, b=0.05))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_singular_matrices_are_undefined(spark):
    acts = acts_of(spark, seed=3)
    index = G.stimulus_index(acts)
    dim = index.count()
    got = values(T.compare_tiles(T.tiles_from_features(acts, index, dim, 8), dim, NAMES, 8, b=0))
    assert len(got) == 9 and all(v is None or v > 1e3 for v in got.values())
    with pytest.raises(NotImplementedError):
        T.compare_tiles(acts, dim, "cka")


def test_factor_of_one_matrix(spark):
    k = random_cov(17, 4)
    side = 6
    rows = [("m", r, c, np.ascontiguousarray(k[r * side : (r + 1) * side, c * side : (c + 1) * side]).tobytes()) for r in range(3) for c in range(r + 1)]
    columns, _ = T.cholesky(spark.createDataFrame(rows, T._TILE), 17, side)
    low = np.zeros((17, 17))
    for column in columns:
        for t in column.collect():
            tile = np.frombuffer(t.cells).reshape(T._size(17, side, t.r), -1)
            low[t.r * side : t.r * side + len(tile), t.c * side : t.c * side + tile.shape[1]] = tile
    assert np.allclose(low, np.linalg.cholesky(k))
    assert T.log_determinants(columns, 17, side).first().logdet == pytest.approx(np.linalg.slogdet(k).logabsdet)


def test_inverse_and_traces(spark):
    side, names = 6, "abc"
    whole = {m: random_cov(17, k) for k, m in enumerate(names)}
    rows = [(m, r, c, np.ascontiguousarray(whole[m][r * side : (r + 1) * side, c * side : (c + 1) * side]).tobytes()) for m in names for r in range(3) for c in range(r + 1)]
    tiles = spark.createDataFrame(rows, T._TILE)
    inverse = T.inverted(*T.cholesky(tiles, 17, side), 17, side)
    got = inverse.collect()
    assert len(got) == 18
    for t in got:
        cells = np.frombuffer(t.cells).reshape(T._size(17, side, t.r), -1)
        assert np.allclose(cells, np.linalg.inv(whole[t.layer])[t.r * side :, t.c * side :][: cells.shape[0], : cells.shape[1]])
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    traces = {(r.a, r.b): r.trace for r in T.trace_ratios(tiles, inverse, pairs).collect()}
    assert traces == {(a, b): pytest.approx(np.trace(np.linalg.inv(whole[b]) @ whole[a])) for a in names for b in names}


@pytest.mark.parametrize("b", [0.05, 0.0])
def test_few_features_need_no_tiles(spark, monkeypatch, b):
    acts = acts_of(spark, seed=6)
    # a stimulus without activations, one activation in two parts, and one of a stimulus that is not in the index
    index = G.stimulus_index(acts.select("stim").union(spark.createDataFrame([("none",)], "stim string")))
    acts = acts.union(spark.createDataFrame([("a", "s003", 1, 0.5), ("b", "s003", 1, 0.25), ("b", "s003", 1, 0.25)], acts.schema))
    dim = index.count()
    want = values(T.compare_tiles(T.tiles_from_features(acts, index, dim, 7), dim, NAMES, 7, b=b))

    def formed(*_):
        raise AssertionError("tiles were formed")

    with monkeypatch.context() as patch:
        patch.setattr(T, "tiles_from_features", formed)
        got = values(T.compare_features(acts, index, dim, NAMES, b=b))
        with pytest.raises(AssertionError, match="tiles were formed"):
            patch.setattr(T, "FEW_FEATURES", 5)
            T.compare_features(acts, index, dim, NAMES, b=b)
    assert set(got) == set(want)
    # without noise the matrices are singular, and factors of rounding errors are no reference
    assert all(got[k] is None if not b else got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
    monkeypatch.setattr(T, "FEW_FEATURES", 5)
    tiles = values(T.compare_features(acts, index, dim, NAMES, b=0.05))
    assert set(tiles) == set(want) and (not b or tiles == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()})
