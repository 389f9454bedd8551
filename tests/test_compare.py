import numpy as np
import pyarrow as pa
import pytest
from brute import condition, measure
from conftest import gram_frame, matrices_of, random_cov
from pyspark.sql import functions as F

from kindred.functions import linalg as la
from kindred.operators import gram as G
from kindred.operators import gram_compare as GC
from kindred.operators import moments as M
from kindred.operators.gram_compare import compare_gram, distance_form, symmetrize
from kindred.operators.layer_compare import compare_layers
from kindred.operators.stimulus_pairs import distances, nearest
from kindred.operators import stimulus_pairs as SP
from kindred.plans.registry import ALIASES, MEASURES, Params, forget_measure, register_measure
from kindred.sources.activations import extract

EXACT = [m for m in MEASURES if m not in ("tvd", "jsd")]
GAUSSIAN = ["kldiv", "bhattacharyya", "hellinger", "wasserstein"]


def values(df):
    return {(r.measure, r.a, r.b): r.value for r in df.collect()}


def stimuli(spark, n=30, copies=0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 9)) + 0.5
    if copies:
        x[:copies] = x[0]
    rows = [(int(i) * 7 + 1, x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(5)
    cut = {"one": (1, 2), "three": (3, 3), "tail": (6, 4)}
    layers = extract(df, "id", {k: F.slice("x", s, w) for k, (s, w) in cut.items()})
    return layers, {k: x[:, s - 1 : s - 1 + w] for k, (s, w) in cut.items()}


@pytest.mark.parametrize("n, copies", [(30, 0), (30, 12), (5, 0)])
@pytest.mark.parametrize("options", [{}, {"noise_var": 0.3}, {"b": 0.2, "normalize": False}])
def test_layers_agree_with_full_matrices(spark, n, copies, options):
    layers, x = stimuli(spark, n, copies)
    got = values(compare_layers(layers, EXACT, lmbd=0.1, k=3, **options))
    assert len(got) == 3 * len(EXACT)
    for (name, a, b), value in got.items():
        k1, k2 = (condition(x[l] @ x[l].T, **options) for l in (a, b))
        assert value == pytest.approx(measure(name, k1, k2), abs=2e-7), (name, a, b)


def test_raw_matrices_without_noise(spark):
    layers, x = stimuli(spark)
    names = ["cka", "rsacos", "procrustes", "nbs", "wasserstein", "gulp", "kldiv"]
    got = values(compare_layers(layers, names, b=0, normalize=False, lmbd=0.1))
    for (name, a, b), value in got.items():
        if name == "kldiv":
            assert value is None  # singular: undefined, and does not fail the job
        else:
            assert value == pytest.approx(measure(name, x[a] @ x[a].T, x[b] @ x[b].T), abs=1e-6), name


def test_gram_route_agrees_with_full_matrices(spark):
    covs = {c: random_cov(12, s, scale) for c, s, scale in (("a", 1, 1.0), ("b", 2, 1e7), ("c", 3, 1e-4))}
    got = values(compare_gram(gram_frame(spark, covs), EXACT, lmbd=0.001, k=3))
    assert len(got) == 3 * len(EXACT)
    for (name, a, b), value in got.items():
        want = measure(name, condition(covs[a]), condition(covs[b]), lmbd=0.001)
        assert value == pytest.approx(want, abs=2e-7), (name, a, b)


def test_both_routes_agree(spark):
    layers, _ = stimuli(spark)
    names = EXACT + ["tvd", "jsd"]
    one = values(compare_layers(layers, names, lmbd=0.1, k=3))
    from kindred.sources.activations import features_long

    two = values(compare_gram(G.gram_from_features(features_long(layers)), names, lmbd=0.1, k=3))
    for (name, a, b), value in one.items():
        other = two[(name, min(a, b), max(a, b))]
        assert value == pytest.approx(other, abs=0.02 if name in ("tvd", "jsd") else 1e-6), name


@pytest.mark.parametrize("name", [m for m in EXACT if m not in ("mahalanobis",)])
def test_equal_matrices(spark, name):
    cov = random_cov(8, 5)
    got = compare_gram(gram_frame(spark, {"a": cov, "b": cov.copy()}), name, lmbd=0.1, k=3).first().value
    want = {"nbs": 8.0, "rsaarccos": 0.0}.get(name, 1.0 if MEASURES[name].similarity else 0.0)
    assert got == pytest.approx(want, abs=2e-7)


def test_distances_grow_with_the_perturbation(spark):
    base = random_cov(5, 0)
    rng = np.random.default_rng(9)
    bump = rng.standard_normal((5, 5))
    bump = (bump + bump.T) / 2
    steps = {f"e{i}": base + eps * bump for i, eps in enumerate((1e-2, 1e-3, 1e-4, 1e-5))}
    got = values(compare_gram(gram_frame(spark, {"base": base, **steps}), GAUSSIAN))
    for name in GAUSSIAN:
        series = [got[(name, "base", f"e{i}")] for i in range(4)]
        assert all(x >= y >= 0 for x, y in zip(series, series[1:])), (name, series)
        assert series[-1] < 1e-3


@pytest.mark.parametrize("smallest", [0.0, 1e-3, 1e-7])
def test_nearly_singular_matrices(spark, smallest):
    covs = {n: random_cov(5, s, first=smallest) for n, s in (("a", 1), ("b", 2))}
    for value in values(compare_gram(gram_frame(spark, covs), [*GAUSSIAN, "tvd", "jsd"], samples=2000)).values():
        assert value is not None and np.isfinite(value) and value >= 0


def test_sampled_measures_match_the_analytic_value_and_repeat(spark):
    lam = 3.0
    covs = {"a": np.diag([lam, 1.0, 1.0]), "b": np.eye(3)}
    from math import erf, log, sqrt

    cut = sqrt(lam * log(lam) / (lam - 1))
    phi = lambda z: 0.5 * (1 + erf(z / sqrt(2)))
    exact = 2 * (phi(cut) - phi(cut / sqrt(lam)))
    frame = gram_frame(spark, covs)
    options = {"b": 0, "normalize": False, "samples": 40_000}
    first = values(compare_gram(frame, ["tvd", "jsd"], seed=1, **options))
    again = values(compare_gram(frame.repartition(7), ["tvd", "jsd"], seed=1, **options))
    other = values(compare_gram(frame, ["tvd", "jsd"], seed=2, **options))
    assert first[("tvd", "a", "b")] == pytest.approx(exact, abs=4 / sqrt(40_000))
    assert first == again and first != other
    assert 0 < first[("jsd", "a", "b")] < 1


def test_sampling_does_not_depend_on_the_partitioning(spark):
    layers, _ = stimuli(spark)
    from dataclasses import replace

    again = replace(layers, df=layers.df.repartition(2))
    one, two = (values(compare_layers(x, "tvd", samples=500)) for x in (layers, again))
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_means_enter_the_distribution_measures(spark):
    covs = {"a": random_cov(4, 1), "b": random_cov(4, 2)}
    mu = np.array([0.5, -1.0, 0.0, 2.0])
    means = spark.createDataFrame([("a", mu.tolist())], "layer string, mu array<double>")
    frame = gram_frame(spark, covs)
    names = ["wasserstein", "mahalanobis", "kldiv", "bhattacharyya", "tvd", "jsd"]
    raw = {"b": 0, "normalize": False}
    with_means, without = (values(compare_gram(frame, names, means=m, **raw)) for m in (means, None))
    x, y = covs["a"], covs["b"]
    maha2 = mu @ np.linalg.inv((x + y) / 2) @ mu
    key = lambda n: (n, "a", "b")
    assert with_means[key("mahalanobis")] == pytest.approx(np.sqrt(maha2))
    assert with_means[key("wasserstein")] ** 2 == pytest.approx(without[key("wasserstein")] ** 2 + mu @ mu)
    assert with_means[key("bhattacharyya")] == pytest.approx(without[key("bhattacharyya")] + maha2 / 8)
    kl = mu @ (np.linalg.inv(x) + np.linalg.inv(y)) @ mu / 4
    assert with_means[key("kldiv")] == pytest.approx(without[key("kldiv")] + kl)
    assert with_means[key("tvd")] > without[key("tvd")] and with_means[key("jsd")] > without[key("jsd")]
    rooted = values(compare_gram(frame, "bhattacharyya", means=means, root_mean_term=True, **raw))
    assert rooted[key("bhattacharyya")] == pytest.approx(without[key("bhattacharyya")] + np.sqrt(maha2) / 8)


def test_mean_shift_in_sampling_has_the_right_size():
    lam, shift = la.relative_spectrum(np.diag([2.0, 3.0]), la.Factors(np.diag([4.0, 1.0])), np.array([2.0, 0.0]))
    assert sorted(lam) == pytest.approx([0.5, 3.0]) and np.linalg.norm(shift) == pytest.approx(1.0)
    at_p, at_q = la.log_ratios(lam, shift, 200_000, np.random.default_rng(0))
    # mean log ratio under p is the directed Kullback-Leibler divergence
    kl = 0.5 * (lam - 1 - np.log(lam) + shift**2).sum()
    assert at_p.mean() == pytest.approx(kl, abs=0.02)
    assert at_q.mean() == pytest.approx(-0.5 * (1 / lam - 1 + np.log(lam) + shift**2 / lam).sum(), abs=0.02)


def test_missing_parameters_are_reported(spark):
    layers, _ = stimuli(spark)
    with pytest.raises(ValueError, match="lmbd"):
        compare_layers(layers, "gulp")
    with pytest.raises(ValueError, match="k"):
        compare_layers(layers, "jaccard")
    with pytest.raises(ValueError, match="two layers"):
        compare_layers(layers.select("one"), "cka")


def test_blocks_do_not_change_neighbours_or_distances(spark):
    layers, x = stimuli(spark, n=150, copies=50)
    small, big, cut = (
        {(r.layer, r.stim): tuple(r.neighbours) for r in nearest(layers, Params(k=4), rows, run).collect()}
        for rows, run in ((64, 256), (4096, 256), (64, 1))
    )
    assert small == big == cut and len(small) == 3 * 150
    assert all(stim not in found and len(found) == 4 for (_, stim), found in small.items())
    # among 49 exact copies the smallest ids win
    assert small[("one", 1)] == (8, 15, 22, 29)
    d = distances(layers, 64).toPandas()
    assert len(d) == 150 * 149 // 2 and (d.i < d.j).all() and not d.duplicated(["i", "j"]).any()
    copies = d[(d.i <= 49 * 7 + 1) & (d.j <= 49 * 7 + 1)]
    assert len(copies) == 50 * 49 // 2 and all(max(v) == 0 for v in copies.d)


@pytest.mark.parametrize("pilot", [5, 40])
def test_crowded_bins_are_cut(spark, monkeypatch, pilot):
    """Nearly all distances lie close together, beside outliers that the first splitters may all come from."""
    monkeypatch.setattr(SP, "PILOT", pilot)
    monkeypatch.setattr(SP, "BIN_PAIRS", 50)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((120, 4)), 3)
    x[:6] *= 10.0 ** np.arange(1, 7)[:, None]
    x[20:40] = x[20]
    rows = [(f"stim {i:03d}", v.tolist()) for i, v in enumerate(x)]
    layers = extract(spark.createDataFrame(rows, "id string, x array<double>"), "id", {"a": F.slice("x", 1, 2), "b": F.slice("x", 3, 2)})
    pairs, _ = SP._block_pairs(layers, 64, False, 1)
    splitters, totals = SP._refined(pairs, layers, SP._splitters(layers, 4))
    counts = totals.collect()
    assert max(r.total for r in counts if r.bin % 2 == 0) <= SP.CROWDED * 50
    assert sum(r.total for r in counts if r.layer == 0) == 120 * 119 // 2
    got = compare_layers(layers, "rsarank").first().value

    def ranks(y):
        d = ((y[:, None] - y) ** 2).sum(-1)[np.triu_indices(120, 1)]
        _, which, count = np.unique(np.round(d, 9), return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[which]

    one, two = ranks(x[:, :2]), ranks(x[:, 2:])
    n = len(one)
    assert got == pytest.approx(12 * (one @ two - n * (n + 1) ** 2 / 4) / (n**3 - n), abs=1e-6)


def test_names_as_ids(spark):
    layers, x = stimuli(spark, n=40, copies=10)
    named = extract(layers.df.withColumn("name", F.format_string("s%05d", layers.stim)), "name", dict(layers.columns), widths=dict(layers.widths))
    plain = {(r.layer, f"s{r.stim:05d}"): [f"s{o:05d}" for o in r.neighbours] for r in nearest(layers, Params(k=3)).collect()}
    assert {(r.layer, r.stim): r.neighbours for r in nearest(named, Params(k=3)).collect()} == plain
    names = ["jaccard", "rsarank", "cka"]
    assert values(compare_layers(named, names, k=3)) == pytest.approx(values(compare_layers(layers, names, k=3)))


def test_symmetrize_and_distance_form(spark):
    covs = {n: random_cov(4, s) for n, s in (("a", 1), ("b", 2), ("c", 3))}
    full = symmetrize(compare_gram(gram_frame(spark, covs), ["cka", "kldiv"]))
    got = values(full)
    assert len(got) == 18
    for m, diagonal in (("cka", 1.0), ("kldiv", 0.0)):
        assert all(got[(m, x, x)] == diagonal for x in covs)
        assert all(got[(m, x, y)] == got[(m, y, x)] for x in covs for y in covs)
    flipped = values(distance_form(full))
    assert flipped[("cka", "a", "a")] == 0 and flipped[("cka", "a", "b")] == pytest.approx(1 - got[("cka", "a", "b")])
    assert flipped[("kldiv", "a", "b")] == got[("kldiv", "a", "b")]


def test_todo_restricts_the_work(spark):
    layers, _ = stimuli(spark)
    todo = spark.createDataFrame([("one", "tail")], "a string, b string")
    assert set(values(compare_layers(layers, ["cka", "rsarank", "jaccard"], todo=todo, k=2))) == {
        (m, "one", "tail") for m in ("cka", "rsarank", "jaccard")
    }


def test_conditioning_matches_its_definition(spark):
    covs = {n: random_cov(6, s, 3.0) for n, s in (("a", 12), ("b", 13))}
    frame = gram_frame(spark, covs)
    for options in ({}, {"noise_var": 0.4}, {"b": 0}, {"normalize": False}, {"b": 0, "normalize": False}, {"noise_var": 0.0}):
        got = matrices_of(G.condition(frame, **options))
        for name, k in covs.items():
            assert np.allclose(got[name], condition(k, **options), atol=1e-12), options


def test_noise_with_weights_and_explicit_signal(spark):
    k = random_cov(3, 1)
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "i int, w double")
    got = matrices_of(G.add_noise(gram_frame(spark, {"a": k}), 0.4, weights=weights))["a"]
    assert np.allclose(got, 0.6 * k + 0.4 * np.diag([1, 0.5, 0.25]))
    assert np.allclose(matrices_of(G.add_noise(gram_frame(spark, {"a": k}), 0.4, signal_var=0.0))["a"], 0.4 * np.eye(3))
    with pytest.raises(Exception, match="no weight"):
        G.add_noise(gram_frame(spark, {"a": k}), 0.4, weights=weights.where("i < 2")).collect()


def test_hand_computed_grams(spark):
    acts = [("a", s, f, float(v)) for s, row in enumerate([[1, 2], [2, 4], [3, 6]]) for f, v in enumerate(row)]
    acts += [("t", 0, f, float(f + 1)) for f in range(4)] + [("t", 1, f, float(f + 5)) for f in range(4)]
    acts += [("t", 2, 0, 0.0)]
    got = matrices_of(G.gram_from_features(spark.createDataFrame(acts, "layer string, stim long, feat int, v double")))
    assert got["a"].tolist() == [[5, 10, 15], [10, 20, 30], [15, 30, 45]]
    assert got["t"][:2, :2].tolist() == [[30, 70], [70, 174]] and not got["t"][2].any()


def on_a_grid(lam, shift):
    """Total variation and Jensen-Shannon of N(shift, lam) and N(0, 1) by summing over a fine grid."""
    x = np.linspace(-60, 60, 1_200_001) * max(1, np.sqrt(lam))
    p, q = np.exp(-((x - shift) ** 2) / 2 / lam) / np.sqrt(2 * np.pi * lam), np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    middle = np.maximum((p + q) / 2, 1e-300)
    divergence = sum(np.where(d > 0, d * np.log2(np.maximum(d, 1e-300) / middle), 0).sum() for d in (p, q)) / 2
    return np.abs(p - q).sum() / 2 * (x[1] - x[0]), divergence * (x[1] - x[0])


@pytest.mark.parametrize("lam, shift", [(0.5, 0.0), (4.0, 0.0), (1.001, 0.0), (1e-3, 0.1), (50.0, 3.0), (1.0, 2.0), (1.0, 0.0), (2.0, -9.0)])
def test_integrated_divergences_of_one_dimension(lam, shift):
    tv, js = on_a_grid(lam, shift)
    one = np.array([lam]), np.array([shift])
    assert la.exact_total_variation(*one) == pytest.approx(tv, abs=1e-7)
    assert la.exact_jensen_shannon(*one) == pytest.approx(js, abs=1e-7)
    # dimensions in which both are equal change nothing
    more = np.append(np.ones(5), lam), np.append(np.zeros(5), shift)
    assert la.exact_total_variation(*more) == pytest.approx(la.exact_total_variation(*one), abs=1e-12)


@pytest.mark.parametrize("dims", [2, 16, 300])
def test_estimates_lie_near_the_integrals(dims):
    rng = np.random.default_rng(dims)
    lam, shift = np.exp(rng.normal(0, 3 / dims, dims)), rng.normal(0, 1 / dims, dims)
    at_p, at_q = la.log_ratios(lam, shift, 100_000, rng)
    tv = (np.maximum(-np.expm1(-at_p), 0).mean() + np.maximum(-np.expm1(at_q), 0).mean()) / 2
    js = 1 - (np.logaddexp(0, -at_p).mean() + np.logaddexp(0, at_q).mean()) / (2 * np.log(2))
    assert la.exact_total_variation(lam, shift) == pytest.approx(tv, abs=4 / np.sqrt(100_000))
    assert la.exact_jensen_shannon(lam, shift) == pytest.approx(js, abs=4 / np.sqrt(100_000))


def test_stimuli_are_numbered_in_order(spark):
    assert [(r.stim, r.i) for r in G.stimulus_index(spark.range(3, 6), "id").orderBy("stim").collect()] == [(3, 0), (4, 1), (5, 2)]


def moment_rows(spark, x, parts=3):
    rows = [("k", [(i, float(v)) for i, v in enumerate(r) if v], [float(v) for v in r]) for r in x]
    return spark.createDataFrame(rows, "key string, sparse array<struct<i:int,v:double>>, dense array<double>").repartition(parts)


@pytest.mark.parametrize("cells, tile, cost", [(16_000_000, 2048, 300), (60, 2048, 300), (60, 3, 300), (60, 4, 0), (100, 5, 1)])
@pytest.mark.parametrize("density", [0.05, 0.9])
def test_sums_of_any_width(spark, monkeypatch, cells, tile, cost, density):
    monkeypatch.setattr(M, "_MAX_CELLS", cells)
    monkeypatch.setattr(M, "_TILE", tile)
    monkeypatch.setattr(M, "_SPARSE_COST", cost)
    monkeypatch.setattr(M, "_STRIP_CELLS", 4 * tile)
    rng = np.random.default_rng(1)
    x = np.where(rng.random((40, 13)) < density, rng.standard_normal((40, 13)), 0)
    frame = moment_rows(spark, x)
    for column, sparse, key in (("sparse", True, "key"), ("dense", False, "key"), ("dense", False, None)):
        total = np.zeros((13, 13))
        for r in M.outer_sums(frame, column, 13, key=key, sparse=sparse).collect():
            assert r.i <= r.j and total[r.i, r.j] == 0 != r.s
            total[r.i, r.j] = r.s
        assert np.allclose(total, np.triu(x.T @ x))


def test_what_leaves_a_task_follows_tiles_and_not_rows(monkeypatch):
    monkeypatch.setattr(M, "_TILE", 5)
    rng = np.random.default_rng(2)
    counts = set()
    for n in (50, 500, 2000):
        for strip in (5, 40, 5000):
            monkeypatch.setattr(M, "_STRIP_CELLS", strip)
            x = rng.standard_normal((n, 13))
            batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], ["v"])
            strips = [b.to_pylist()[0] for b in M._strips(13, None, False, False, 2)([batch])]
            strips.sort(key=lambda r: (r["r"], r["c"], r["salt"]))
            out = list(M._tile_rows(5)([pa.RecordBatch.from_pylist(strips)]))
            counts.add(sum(b.num_rows for b in out))
            total = np.zeros((13, 13))
            for row in (r for b in out for r in b.to_pylist()):
                cells = np.frombuffer(row["cells"])
                total[row["i"], row["first"] : row["first"] + len(cells)] += cells
            assert np.allclose(total, np.triu(x.T @ x))
    # 13 rows, cut into 3 + 2 + 1 tiles' rows, each at most once per salt
    assert max(counts) <= 2 * (5 * 3 + 5 * 2 + 3 * 1)


def test_stimuli_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(G, "_RANGES", 5)
    monkeypatch.setattr(G, "_SAMPLE", 400)
    names = [f"stim {k * 7919 % 1000:04d}" for k in range(1000)] + [None, "", "ä"]
    frame = spark.createDataFrame([(n,) for n in names * 2], "s string").repartition(4)
    got = {r.stim: r.i for r in G.stimulus_index(frame, "s").collect()}
    order = [None, ""] + sorted(set(names) - {None, "", "ä"}) + ["ä"]
    assert got == {n: i for i, n in enumerate(order)}
    assert G.stimulus_index(frame.where("false"), "s").count() == 0


def test_an_activation_given_twice_is_an_error(spark):
    acts = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 0, 5.0), ("a", 2, 0, 2.0)], "layer string, stim long, feat int, v double")
    with pytest.raises(Exception, match="more than once"):
        G.gram_from_features(acts).collect()


def test_matrices_of_unequal_size_are_not_compared(spark):
    frame = gram_frame(spark, {"a": random_cov(3, 1), "b": random_cov(5, 2)})
    for name in ("cka", "rsacorr", "kldiv"):
        with pytest.raises(Exception, match="square and of one size"):
            compare_gram(frame, name).collect()
    with pytest.raises(Exception, match="square and of one size"):
        compare_gram(gram_frame(spark, {"a": random_cov(3, 1), "b": random_cov(3, 2)}).where("not (layer = 'a' and i = 0 and j = 1)"), "cka").collect()


@pytest.mark.parametrize("name", ["cka", "rsacorr", "rsarank", "jaccard", "kldiv"])
def test_asymmetric_matrices_are_not_compared(spark, name):
    bad = random_cov(4, 2)
    bad[0, 3] += 0.5
    frame = gram_frame(spark, {"a": random_cov(4, 1), "b": bad})
    with pytest.raises(Exception, match="symmetric"):
        compare_gram(frame, name, k=1).collect()


def test_a_layer_is_decomposed_once_for_all_its_partners(monkeypatch):
    covs = {f"l{k}": random_cov(5, k) for k in range(7)}
    rows = [(0, 0, 0, n, 5, m.ravel().tolist(), None, None, None, None) for n, m in covs.items()]
    rows += [(0, 0, 1, None, None, None, None, a, b, None) for a in covs for b in covs if a < b]
    names = [f.split()[0] for f in GC._MEETING.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.string(), pa.list_(pa.string())]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
    counts = {"eigh": 0, "cholesky": 0, "solve": 0}
    plain = {n: getattr(np.linalg, n) for n in counts}
    for name in ("eigh", "cholesky"):
        monkeypatch.setattr(np.linalg, name, lambda *x, name=name: (counts.update({name: counts[name] + 1}), plain[name](*x))[1])
    measures = [MEASURES[m] for m in ("wasserstein", "procrustes")]
    out = pa.Table.from_batches(GC._block_kernel(measures, Params())([batch]))
    assert out.num_rows == 2 * 21 and counts["eigh"] == 2 * 7
    counts["eigh"] = 0
    out = pa.Table.from_batches(GC._block_kernel([MEASURES["kldiv"], MEASURES["tvd"]], Params())([batch]))
    # one eigenvalue problem a pair, and one factor a layer that comes second
    assert out.num_rows == 2 * 21 and counts == {"eigh": 21, "cholesky": 6, "solve": 0}


@pytest.mark.parametrize("size", [1, 4000])
def test_blocks_of_layers_do_not_change_values(spark, monkeypatch, size):
    monkeypatch.setattr(GC, "_BLOCK_BYTES", size)
    covs = {f"l{k}": random_cov(6, k) for k in range(9)}
    names = ["wasserstein", "kldiv", "gulp", "nbs"]
    got = values(compare_gram(gram_frame(spark, covs), names, b=0.05, lmbd=0.1))
    assert len(got) == 4 * 36
    for (m, a, b), v in got.items():
        assert v == pytest.approx(measure(m, condition(covs[a], b=0.05), condition(covs[b], b=0.05), lmbd=0.1), rel=1e-6, abs=1e-7)


def test_products_of_cells_where_layers_lack_some(spark):
    rng = np.random.default_rng(6)
    cells = {(layer, i, j): float(rng.standard_normal()) for layer in "dbca" for i in range(6) for j in range(6) if rng.random() < 0.7}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "layer string, i int, j int, v double").repartition(3)
    got = {(r.a, r.b): r for r in GC.cell_products(frame).collect()}
    assert set(got) == {(a, b) for a in "abcd" for b in "abcd" if a < b}
    for (a, b), r in got.items():
        both = [(cells[a, i, j], cells[b, i, j]) for i in range(6) for j in range(6) if (a, i, j) in cells and (b, i, j) in cells]
        x, y = np.array(both).T
        assert r.n == len(x) and np.allclose([r.sxy, r.sx, r.sy, r.sxx, r.syy], [x @ y, x.sum(), y.sum(), x @ x, y @ y])
    assert GC.cell_products(frame.where("layer = 'a'")).count() == 0 == GC.cell_products(frame.where("false")).count()


@pytest.mark.parametrize("scale", [(1e6, 1.0), (1e-6, 1.0), (1e4, 1e-3), (1e6, 1e6)])
def test_scale_does_not_matter(spark, scale):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8)) + 0.3
    names = [m for m in EXACT if m not in ("jaccard",)] + ["tvd", "jsd"]

    def compared(f, g):
        rows = [(i, (x[i] * np.repeat([f, g], 4)).tolist()) for i in range(60)]
        layers = extract(spark.createDataFrame(rows, "id long, x array<double>"), "id", {"a": F.slice("x", 1, 4), "b": F.slice("x", 5, 4)})
        return values(compare_layers(layers, names, lmbd=0.1, k=3, noise_var=0.4, samples=200))

    plain, scaled = compared(1.0, 1.0), compared(*scale)
    for key, value in plain.items():
        assert scaled[key] == pytest.approx(value, rel=1e-9, abs=1e-12), key


def test_offsets_do_not_cost_digits(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 6))

    def compared(offset, names):
        rows = [(i, (x[i] + offset).tolist()) for i in range(80)]
        layers = extract(spark.createDataFrame(rows, "id long, x array<double>"), "id", {"a": F.slice("x", 1, 3), "b": F.slice("x", 4, 3)})
        return values(compare_layers(layers, names, b=0, normalize=False))

    names = ["rsacorr", "rsacos", "rsaarccos", "cka", "distcorr", "procrustes", "nbs"]
    plain, moved = compared(0.0, names), compared(1e6, names)
    for key, value in plain.items():
        assert moved[key] == pytest.approx(value, rel=1e-6), key


def test_one_hot_gram_marks_equal_classes(spark):
    classes = spark.createDataFrame([(10, "x"), (20, "y"), (30, "x")], "stim long, label string")
    assert matrices_of(G.same_class(classes))["ideal"].tolist() == [[1, 0, 1], [0, 1, 0], [1, 0, 1]]


def test_centering_distances_cosines_and_scaling(spark):
    k = random_cov(5, 4) + 0.3
    frame = gram_frame(spark, {"a": k})
    h = np.eye(5) - 0.2
    assert np.allclose(matrices_of(G.double_center(frame))["a"], h @ k @ h)
    d = np.diag(k)
    assert np.allclose(matrices_of(G.squared_distances(frame))["a"], d[:, None] + d - 2 * k)
    assert np.allclose(matrices_of(G.cosine_similarity(frame))["a"], k / np.sqrt(np.outer(d, d)))
    scaled = matrices_of(G.minmax(frame))["a"]
    assert scaled.min() == -1 and scaled.max() == 1
    with pytest.raises(Exception, match="the same"):
        G.minmax(gram_frame(spark, {"a": np.ones((2, 2))})).collect()


def test_validation_finds_every_defect(spark):
    good = random_cov(4, 1)
    skew = good.copy()
    skew[0, 1] += 0.1
    frame = gram_frame(spark, {"good": good * 4 / np.trace(good), "skew": skew})
    facts = {r.layer: r for r in G.validate(frame).collect()}
    assert facts["good"].symmetric and facts["good"].normalized and facts["good"].square and facts["good"].dim == 4
    assert not facts["skew"].symmetric and not facts["skew"].normalized
    for bad, words in (
        (frame, "symmetric"),
        (frame.where("layer = 'good'"), "more than one"),
        (frame.where("layer = 'none'"), "empty"),
        (frame.where("not (layer = 'good' and i = 2)"), "square"),
    ):
        with pytest.raises(ValueError, match=words):
            G.require_comparable(bad)


def test_asymmetric_matrices_are_refused(spark):
    skew = random_cov(4, 1)
    skew[0, 1] += 0.1
    frame = gram_frame(spark, {"a": random_cov(4, 2), "b": skew})
    with pytest.raises(Exception, match="symmetric"):
        compare_gram(frame, "kldiv").collect()
    with pytest.raises(ValueError, match="symmetric"):
        compare_gram(frame, "cka", check=True)


def test_pack_and_unpack(spark):
    covs = {n: random_cov(4, s) for n, s in (("a", 1), ("b", 2))}
    packed = G.pack(gram_frame(spark, covs).repartition(5))
    assert all(np.array_equal(np.reshape(r.m, (r.dim, r.dim)), covs[r.layer]) for r in packed.collect())
    again = matrices_of(G.unpack(packed))
    assert all(np.array_equal(again[n], covs[n]) for n in covs)


def test_measures_of_ones_own_and_variants(spark):
    def overlap(pair, params):
        return float((pair.s1 * pair.s2).sum()) + pair.extra * pair.floor**2

    own = register_measure("overlap sum", overlap, similarity=True, aliases=("common part",))
    for taken in ("cka", "Common-Part", "KL divergence"):
        with pytest.raises(ValueError, match="already"):
            register_measure(taken, overlap)
    covs = {"a": random_cov(6, 1), "b": random_cov(6, 2)}
    got = values(compare_gram(gram_frame(spark, covs), ["common_part", "jsd", "nbs"], samples=500))
    assert got["overlapsum", "a", "b"] == pytest.approx((condition(covs["a"]) * condition(covs["b"])).sum())
    varied = values(compare_gram(gram_frame(spark, covs), ["jsd", "nbs"], samples=500, jsd_sqrt=True, nbs_unit=True))
    assert varied["jsd", "a", "b"] == pytest.approx(got["jsd", "a", "b"] ** 0.5)
    assert varied["nbs", "a", "b"] == pytest.approx(got["nbs", "a", "b"] / 6)
    forget_measure(own)
    assert "overlapsum" not in MEASURES and "commonpart" not in ALIASES


def test_rank_similarity_with_an_outlier_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 6))
    x[0] *= 100
    x[1:40] = np.round(x[1:40])
    x[50:70] = x[50]
    rows = [(i, x[i].tolist()) for i in range(90)]
    layers = extract(spark.createDataFrame(rows, "id long, x array<double>").repartition(3), "id", {"a": F.slice("x", 1, 2), "b": F.slice("x", 3, 4)})
    want = measure("rsarank", x[:, :2] @ x[:, :2].T, x[:, 2:] @ x[:, 2:].T)
    assert values(compare_layers(layers, "rsarank"))["rsarank", "a", "b"] == pytest.approx(want, abs=1e-9)
    # no bin but the one-valued ones holds much more than its share
    monkeypatch.setattr(SP, "BLOCK_ROWS", 16)
    bins = SP._binned_distances(SP._block_pairs(layers, 16, False, 1)[0], layers, SP._splitters(layers, 64)).where("bin % 2 = 0").groupBy("layer", "bin").agg(F.sum("n").alias("n"))
    assert bins.agg(F.max("n")).first()[0] < 4 * 90 * 89 / 2 / 64


AWKWARD = {
    "plain": lambda rng: rng.chisquare(8, 40000),
    "ties": lambda rng: np.round(rng.chisquare(8, 40000), 3),
    "close": lambda rng: rng.chisquare(8, 40000) * 1e-9 + 1e5,
    "equal": lambda rng: np.zeros(40000),
    "odd": lambda rng: np.append(rng.chisquare(8, 40000), [0, 0, 5e-324, 1e308, np.inf, np.nan, np.inf, np.nan]),
    "one": lambda rng: np.array([2.5]),
    "none": lambda rng: np.zeros(0),
}


@pytest.mark.parametrize("kind", AWKWARD)
def test_sorted_distances_and_their_ranks_travel_without_losing_a_bit(kind):
    d = AWKWARD[kind](np.random.default_rng(6))
    ordered = np.sort(d)
    order = SP._order(d)
    assert np.array_equal(d[order], ordered, equal_nan=True) and np.array_equal(np.sort(order), np.arange(len(d)))
    for part in np.array_split(ordered, 3):
        assert SP._unpacked(len(part), pa.py_buffer(SP._packed(part))).tobytes() == part.tobytes()
    parts = [np.sort(x) for x in np.array_split(d, 7)]
    _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    doubled = (2 * np.cumsum(count) - count + 1)[which]
    assert np.array_equal(SP._doubled_ranks(parts), doubled)
    steps = [[f"{k}", 0, 2, len(x), 10.0, x.astype(np.int32).tobytes()] for k, x in enumerate(np.split(doubled, np.cumsum([len(x) for x in parts])[:-1]))]
    names = ["chunk", "layer", "bin", "n", "base", "place"]
    sent = [r for batch in SP._stepped(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in steps])])) for r in batch.to_pylist()]
    assert np.array_equal(np.concatenate([SP._unstepped(r["n"], r["base"], r["place"])[: r["n"]] for r in sent if r["n"]] or [[]]), 10 + doubled / 2)


def test_many_ranks_are_sorted_range_by_range(monkeypatch):
    """Ranges of a bin stay small, and neither equal values nor NaN are torn apart."""
    monkeypatch.setattr(SP, "CACHED", 1 << 12)
    sizes, one = [], SP._sorted_doubled_ranks
    monkeypatch.setattr(SP, "_sorted_doubled_ranks", lambda d: (sizes.append(len(d)), one(d))[1])
    rng = np.random.default_rng(7)
    parts = [np.sort(np.append(np.round(rng.chisquare(8, 6000), 3), [np.nan] * 3)) for _ in range(10)]
    _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    assert np.array_equal(SP._doubled_ranks(parts), (2 * np.cumsum(count) - count + 1)[which])
    assert len(sizes) >= 10 and max(sizes) < 3 * SP.CACHED


@pytest.mark.parametrize("kind", ["long", "string"])
def test_distances_are_exchanged_in_few_rows_and_bytes(spark, kind):
    """A pair in a layer takes less than seven bytes on the way to its bin, and a chunk has few rows in a layer."""
    x = np.random.default_rng(9).standard_normal((1500, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select(F.col("id").cast(kind), "x")
    layers = extract(rows, "id", {"a": F.slice("x", 1, 2), "b": F.slice("x", 3, 4)})
    sent = SP._binned_distances(SP._block_pairs(layers, SP.BLOCK_ROWS, False, 1)[0], layers, SP._splitters(layers, 16))
    rows, pairs, size = sent.agg(F.count("*"), F.sum("n"), F.sum(sum(F.length(c) for c, t in sent.dtypes if t == "binary"))).first()
    assert pairs == 1500 * 1499 and size < 7 * pairs and rows <= 2 * 6 * (2 * 17 + 1)


@pytest.mark.parametrize("side", [7, 64])
def test_bands_and_small_distances(monkeypatch, side):
    """Every pair comes once, and copies have no distance, whatever the rounding."""
    monkeypatch.setattr(SP, "CACHED", 16)
    monkeypatch.setattr(SP, "CHUNK_PAIRS", 100)
    x = np.random.default_rng(10).standard_normal((2, side, 5)) * 1e3 + 1e5
    x[1, :3], x[0, -1], x[1, 4, 0] = x[0, :3], x[0, 0], np.nan
    blocks = [(0, 0, (None, x[0]), (None, x[0])), (0, 1, (None, x[0]), (None, x[1]))]
    monkeypatch.setattr(SP, "_blocks", lambda batches, width: iter(blocks))
    got = [SP._band_distances(left, right, first, slice(1, 4)) for _, left, right, first in SP._bands(None, 5, 3)]
    y, i, j = x[:, :, 1:4], *np.triu_indices(side, 1)
    want = np.concatenate([((y[0][i] - y[0][j]) ** 2).sum(1), ((y[0][:, None] - y[1]) ** 2).sum(-1).ravel()])
    got = np.concatenate(got)
    assert len(got) == len(want) and np.allclose(np.sort(got), np.sort(want), rtol=1e-2, atol=1) and (got == 0).sum() == (want == 0).sum()
    whole = SP._distance(x[0], x[1])
    assert np.isnan(whole[:, 4]).all() and (np.delete(whole, 4, 1) == 0).sum() == 4 and (np.diag(whole)[:3] == 0).all()


def test_ranks_travel_in_four_bytes_a_pair_and_equal_distances_without_any():
    inf, nan = np.inf, np.nan
    parts = [("x", 0, [3.0, 1.0, 3.0]), ("y", 0, [2.0, 1.0, inf, nan, inf, nan]), ("x", 1, [9.0] * 5)]
    rows = [{"chunk": c, "layer": 0, "bin": b, "n": len(d), "total": 9 if b == 0 else 5, "before": 100, "at": np.arange(len(d), dtype=np.int32).tobytes(),
             "d": b"" if b else np.array(d).tobytes()} for c, b, d in parts]
    found = [r for batch in SP._ranked(iter([pa.RecordBatch.from_pylist(rows)])) for r in batch.to_pylist()]
    ranks = [r["base"] + (np.frombuffer(r["place"], np.int32) / 2 if r["place"] else np.zeros(len(r["at"]) // 4)) for r in found]
    assert [x.tolist() for x in ranks] == [[104.5, 101.5, 104.5], [103.0, 101.5, 106.5, 108.5, 106.5, 108.5], [103.0] * 5]
    assert [len(r["place"]) for r in found] == [12, 24, 0]


@pytest.mark.parametrize("sparse", [False, True])
def test_a_task_works_on_few_rows_at_a_time(monkeypatch, sparse):
    """However many rows there are, and however narrow or wide they are."""
    monkeypatch.setattr(M, "_ROW_CELLS", 60)
    sizes, block, entries = [], M._block, M._entries
    monkeypatch.setattr(M, "_block", lambda part, *rest: (sizes.append(part.num_rows), block(part, *rest))[1])
    monkeypatch.setattr(M, "_entries", lambda part, width: (sizes.append(part.num_rows), entries(part, width))[1])
    x = np.random.default_rng(3).standard_normal((500, 5))
    batches = [pa.RecordBatch.from_arrays([pa.array([[{"i": i, "v": v} for i, v in enumerate(r)] for r in x] if sparse else x.tolist())], ["v"])] * 2
    total = np.zeros((5, 5))
    for cells in M._whole_sums(5, None, False, sparse)(iter(batches)):
        for r in cells.to_pylist():
            total[r["i"], r["j"]] += r["s"]
    assert np.allclose(total, 2 * np.triu(x.T @ x)) and max(sizes) <= 12
    if sparse:  # a matrix of a million stimuli: parts follow what the rows hold, so several rows go together
        sizes.clear()
        sums = sum(sum(b.column(2).to_pylist()) for b in M._light_sums(10**6, False)(iter(batches)))
        assert sums == pytest.approx(2 * np.triu(x.T @ x).sum()) and set(sizes) <= {12, 8}


def test_wide_rows_are_summed_up_before_they_are_exchanged(monkeypatch):
    monkeypatch.setattr(M, "_TILE", 5)
    monkeypatch.setattr(M, "_STRIP_CELLS", 20)
    for n in (50, 2000):
        x = np.random.default_rng(4).standard_normal((n, 13))
        batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], ["v"])
        rows = [r for b in M._held_tiles(13, None, False, False)(iter([batch])) for r in b.to_pylist()]
        assert len(rows) == 5 * 3 + 5 * 2 + 3
        total = np.zeros((13, 13))
        for row in rows:
            cells = np.frombuffer(row["cells"])
            total[row["i"], row["first"] : row["first"] + len(cells)] += cells
        assert np.allclose(total, np.triu(x.T @ x))


def test_rows_of_a_salt_are_bounded(spark, monkeypatch):
    """A matrix too large for a task: the strips of more rows go to more salts."""
    for name, value in (("_MAX_CELLS", 60), ("_TILE", 5), ("_STRIP_CELLS", 40), ("_SALT_ROWS", 50)):
        monkeypatch.setattr(M, name, value)
    salts, strips = [], M._strips
    monkeypatch.setattr(M, "_strips", lambda *x: (salts.append(x[-1]), strips(*x))[1])
    x = np.random.default_rng(5).standard_normal((2000, 13))
    got = {(r.i, r.j): r.s for r in M.outer_sums(moment_rows(spark, x), "dense", 13).collect()}
    want = x.T @ x
    assert salts == [40] and all(v == pytest.approx(want[k]) for k, v in got.items()) and len(got) == 91


def test_rows_of_sparse_matrices_are_gathered_once(spark):
    """A matrix wider than a task: the rows are read back from a table, and without heavy rows nothing else is planned."""
    frame = moment_rows(spark, np.eye(13)[[0, 3, 3]])
    parts, once = M.outer_parts(frame.groupBy("key", "sparse").agg(F.count("*")), "sparse", 10**6, key="key", sparse=True)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert not once and "Exchange" not in plan and "Union" not in plan
    assert sorted((r.i, r.j, r.s) for r in parts.collect()) == [(0, 0, 1.0), (3, 3, 1.0)]
