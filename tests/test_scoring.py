import numpy as np
import pandas as pd
import pytest
from conftest import gram_frame, random_cov
from pyspark.sql import functions as F

from kindred.functions.linalg import _beta_cdf, inverse_beta
from kindred.operators import evidence as E
from kindred.operators import reliability as R
from kindred.operators.gram import trace_norm
from kindred.operators.ranks import average_ranks, quantiles


def trial_frame(spark, rows):
    return spark.createDataFrame(rows, "voxel long, stim string, trial long, v double")


def design(spark, stims, data, voxel=1):
    return trial_frame(spark, [(voxel, str(s), t, float(v)) for t, (s, v) in enumerate(zip(stims, data))])


@pytest.mark.parametrize(
    "stims, data, want",
    [
        ((1, 1, 1, 2, 2, 2, 3, 3, 3), (1, 3, 5, 10, 10, 10, 2, 4, 6), 16 / 6),
        ((1, 1, 2, 2, 2, 3), (5, 7, 10, 12, 14, 100), 10 / 3),
        ((1, 1, 1, 2, 2, 2), (5, 5, 5, 9, 9, 9), 0.0),
        ((1, 1, 2), (1, 3, 100), 2.0),
    ],
)
def test_noise_by_hand(spark, stims, data, want):
    trials = design(spark, stims, data)
    assert R.noise_estimation(R.cell_stats(trials)).first().noise_var == pytest.approx(want)
    facts = R.voxel_reliability(R.cell_stats(trials)).first()
    assert facts.noise_var == pytest.approx(want) and facts.total_var == pytest.approx(np.var(data, ddof=1))
    assert facts.reliability == pytest.approx(1 - want / np.var(data, ddof=1))


def test_noise_without_repetitions_is_an_error(spark):
    with pytest.raises(Exception, match="no stimulus is repeated"):
        R.noise_estimation(R.cell_stats(design(spark, (1, 2, 3, 4), (1, 2, 3, 4)))).collect()


def test_constant_voxel_has_no_reliability(spark):
    facts = R.voxel_reliability(R.cell_stats(design(spark, (1, 1, 2, 2), (5, 5, 5, 5)))).first()
    assert facts.total_var == 0 and facts.noise_var == 0 and facts.reliability is None


def test_large_offsets_do_not_spoil_the_variances(spark):
    data = np.array([1.0, 2.0, 4.0, 3.0, 5.0, 9.0]) + 1e9
    facts = R.voxel_reliability(R.cell_stats(design(spark, (1, 1, 2, 2, 3, 3), data))).first()
    assert facts.total_var == pytest.approx(np.var(data, ddof=1), rel=1e-6)


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_runs_are_found_across_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for voxel, size in ((1, 40), (2, 1), (3, 7)):
        stims = rng.integers(0, 2, size) if voxel != 3 else np.zeros(size, int)
        v = rng.standard_normal(size)
        rows += [(voxel, str(s), 10 * t, float(x)) for t, (s, x) in enumerate(zip(stims, v))]
        run = np.concatenate([[0], np.cumsum(stims[1:] != stims[:-1])])
        for r in np.unique(run):
            part = v[run == r]
            want.append((voxel, r, str(stims[run == r][0]), len(part), part.mean(), ((part - part.mean()) ** 2).sum()))
    got = sorted((r.voxel, r.run, r.stim, r.n, r.mean, r.ss) for r in R.run_lengths(trial_frame(spark, rows).repartition(5), chunk * 10).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_repetition_counts(spark):
    runs = R.run_lengths(design(spark, (1, 1, 2, 1, 1), range(5)))
    assert sorted((r.run, r.n) for r in runs.collect()) == [(0, 2), (1, 1), (2, 2)]
    assert not R.repetitions(runs).first().consistent
    assert R.repetitions(R.cell_stats(design(spark, (1, 1, 2, 2), range(4)))).first().consistent


@pytest.mark.parametrize("chunk", [3, 1000])
def test_trials_grouped_by_first_appearance(spark, chunk):
    stims = ["b", "a", "b", "c", "a", "b", "c", "a", "b"]
    got = R.group_by_first_appearance(design(spark, stims, range(9)), chunk).orderBy("position").collect()
    assert [r.stim for r in got] == list("bbbbaaacc") and [r.position for r in got] == list(range(1, 10))
    assert [r.trial for r in got] == [0, 2, 5, 8, 1, 4, 7, 3, 6]


def random_trials(spark, voxels=4, stims=5, seed=0, drop=()):
    rng = np.random.default_rng(seed)
    rows, trial = [], 0
    for v in range(voxels):
        for s in range(stims):
            for _ in range(int(rng.integers(2, 5))):
                if (v, s) not in drop:
                    rows.append((v, f"s{s}", trial, float(rng.standard_normal() + 1.5 * s)))
                trial += 1
    return rows


def test_zscores_and_profiles_agree_with_pandas(spark):
    rows = random_trials(spark, drop={(2, 1)})
    pdf = pd.DataFrame(rows, columns=["voxel", "stim", "trial", "v"])
    pdf["z"] = pdf.groupby("voxel").v.transform(lambda x: (x - x.mean()) / x.std(ddof=0))
    trials = trial_frame(spark, rows)
    stats = R.cell_stats(trials)
    z = R.zscore(trials, R.voxel_reliability(stats)).toPandas().set_index("trial").v
    assert np.allclose(z.sort_index(), pdf.set_index("trial").z.sort_index())
    direct = R.cell_stats(R.zscore(trials, R.voxel_reliability(stats))).toPandas().sort_values(["voxel", "stim"])
    short = R.zscore_stats(stats).toPandas().sort_values(["voxel", "stim"])
    assert np.allclose(direct[["n", "mean", "ss"]], short[["n", "mean", "ss"]])
    index = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "stim string, i int")
    for r in E.channel_profiles(stats, index, 5).collect():
        mine = pdf[pdf.voxel == r.voxel].groupby("stim").z.agg(["mean", "count", "var"])
        seen = [i for i in range(5) if f"s{i}" in mine.index]
        assert [i for i in range(5) if r.y[i] is not None] == seen
        assert np.allclose([r.y[i] for i in seen], mine["mean"]) and [r.w[i] for i in seen] == list(mine["count"])
        noise = (mine["var"] * (mine["count"] - 1)).sum() / (mine["count"].sum() - len(mine))
        assert r.noise_var == pytest.approx(noise)
        assert r.total_var == pytest.approx(mine["count"].sum() / (mine["count"].sum() - 1))
        assert r.signal_var == pytest.approx(r.total_var - noise)


def test_zscores_of_one_large_voxel_among_many(spark):
    rng = np.random.default_rng(6)
    rows = [(v, k % 2, k, float(x)) for v in range(300) for k, x in enumerate(rng.normal(v, 1 + v % 3, 1500 if v == 7 else 4))]
    trials = spark.createDataFrame([*rows, (None, 0, 0, 1.0), (7, 1, 5000, None)], "voxel int, stim int, trial int, v double")
    facts = R.voxel_reliability(R.cell_stats(trials.where("voxel is not null and voxel <> 9")))
    got = {(r.voxel, r.trial): r.v for r in R.zscore(trials, facts).collect()}
    frame = pd.DataFrame(rows, columns=["voxel", "stim", "trial", "v"]).query("voxel != 9")
    group = frame.groupby("voxel").v
    frame["z"] = (frame.v - group.transform("mean")) / group.transform("std", ddof=0)
    want = {(r.voxel, r.trial): r.z for r in frame.itertuples()}
    assert got.pop((7, 5000)) is None and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(z, abs=1e-9) for k, z in want.items())


def ratios(spark, n=50):
    rng = np.random.default_rng(0)
    total = rng.uniform(1, 2, n)
    noise = rng.uniform(0.1, 0.9, n) * total
    rows = [(i, float(x), float(t)) for i, (x, t) in enumerate(zip(noise, total))]
    return spark.createDataFrame(rows, "voxel long, noise_var double, total_var double"), noise / total


def test_noise_values_by_maximum_likelihood(spark):
    frame, x = ratios(spark)
    fit = R.fit_noise(frame).first()
    assert (fit.a, fit.b) == (pytest.approx(-len(x) / np.log(x).sum()), 1.0)
    best = R.beta_loglik(frame, fit.a).first()[0]
    assert all(R.beta_loglik(frame, fit.a * f).first()[0] > best for f in (0.9, 1.1))
    assert R.beta_loglik(frame, 0).first()[0] == R.beta_loglik(frame, -1).first()[0] == float("inf")
    grid = [r.noise_var for r in R.fitted_noise_grid(frame, 10).orderBy("noise_id").collect()]
    assert np.allclose(np.array(grid) ** fit.a, (2 * np.arange(10) + 1) / 20)


@pytest.mark.parametrize("a, b, n", [(2, 3, 3), (1.5, 1, 5), (2.5, 1.5, 7)])
def test_noise_values_of_a_given_distribution(spark, a, b, n):
    grid = [r.noise_var for r in R.beta_noise_grid(spark, a, b, n).orderBy("noise_id").collect()]
    t = (np.arange(400_000) + 0.5) / 400_000
    density = t ** (a - 1) * (1 - t) ** (b - 1)
    cdf = np.cumsum(density) / density.sum()
    assert np.allclose(np.interp(grid, t, cdf), (2 * np.arange(n) + 1) / (2 * n), atol=1e-5)


def test_noise_value_options_are_checked(spark):
    for a, b, n in ((0.0, 1.0, 3), (1.0, -1.0, 3), (1.0, 1.0, 0)):
        with pytest.raises(ValueError):
            R.beta_noise_grid(spark, a, b, n)


def test_beta_quantiles_in_closed_form():
    assert inverse_beta(0.3, 2.0, 1.0) == pytest.approx(0.3**0.5)
    assert inverse_beta(0.3, 1.0, 4.0) == pytest.approx(1 - 0.7**0.25, abs=1e-12)
    assert _beta_cdf(0.5, 3.0, 3.0) == pytest.approx(0.5) and _beta_cdf(0.0, 2, 2) == 0 and _beta_cdf(1.0, 2, 2) == 1


def log_density(y, cov):
    sign, logdet = np.linalg.slogdet(cov)
    return -0.5 * (logdet + y @ np.linalg.inv(cov) @ y + len(y) * np.log(2 * np.pi))


def scoring_inputs(spark, n=6, voxels=5, seed=1, gaps=False, own=False):
    rng = np.random.default_rng(seed)
    covs = {m: random_cov(n, s) for m, s in (("m0", 1), ("m1", 2))}
    covs = {m: k * n / np.trace(k) for m, k in covs.items()}
    y = rng.standard_normal((voxels, n))
    w = rng.integers(1, 5, (voxels, n)).astype(float)
    nu, sv = rng.uniform(0.2, 0.8, voxels), rng.uniform(0.3, 0.9, voxels)
    rows = []
    for v in range(voxels):
        values = [float(x) for x in y[v]]
        if gaps and v == 1:
            values[2] = None
        rows.append((v, values, float(nu[v]), float(sv[v])) + (([float(x) for x in w[v]],) if own else ()))
    schema = "voxel long, y array<double>, noise_var double, signal_var double" + (", w array<double>" if own else "")
    return covs, gram_frame(spark, covs), spark.createDataFrame(rows, schema), y, w, nu, sv


def scores(df):
    return {(r.voxel, r.model): r.ll for r in df.collect()}


@pytest.mark.parametrize("limit", [None, 1000])
def test_evidence_with_one_noise_value(spark, limit):
    covs, gram, channels, y, *_ = scoring_inputs(spark)
    got = scores(E.loglik(channels.repartition(3), gram, noise_var=0.8, model_bytes=limit))
    assert len(got) == 10
    for (v, m), ll in got.items():
        assert ll == pytest.approx(log_density(y[v], 0.2 * covs[m] + 0.8 * np.eye(6)))


def test_evidence_with_noise_per_voxel_shared_weights_and_gaps(spark):
    covs, gram, channels, y, _, nu, sv = scoring_inputs(spark, gaps=True)
    w = np.array([1.0, 2, 3, 4, 5, 6])
    weights = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i int, w double")
    for (v, m), ll in scores(E.loglik(channels, gram, weights=weights)).items():
        keep = np.array([i for i in range(6) if not (v == 1 and i == 2)])
        cov = (sv[v] * covs[m] + nu[v] * np.diag(1 / w))[np.ix_(keep, keep)]
        assert ll == pytest.approx(log_density(y[v][keep], cov))


def test_evidence_with_weights_per_voxel(spark):
    covs, gram, channels, y, w, nu, sv = scoring_inputs(spark, own=True)
    for (v, m), ll in scores(E.loglik(channels, gram)).items():
        assert ll == pytest.approx(log_density(y[v], sv[v] * covs[m] + nu[v] * np.diag(1 / w[v])))
    with pytest.raises(ValueError, match="twice"):
        E.loglik(channels, gram, weights=spark.createDataFrame([(0, 1.0)], "i int, w double"))


def test_one_decomposition_per_pattern_of_weights_and_gaps(monkeypatch):
    rng = np.random.default_rng(8)
    k = random_cov(6, 1)
    patterns = rng.integers(1, 4, (5, 6)).astype(float)
    w = patterns[rng.integers(0, 5, 200)]
    y = rng.standard_normal((200, 6))
    y[w[:, 0] == 2, 3] = np.nan
    plain, counted = np.linalg.eigh, []
    monkeypatch.setattr(np.linalg, "eigh", lambda m: (counted.append(len(m)), plain(m))[1])
    lam, square, logw, gaps = E._by_pattern(k, y, w)
    assert sum(counted) == len({(*a, *np.isnan(b)) for a, b in zip(w.tolist(), y)}) == 5
    nu, s = 0.3, 0.8
    for c in range(0, 200, 17):
        seen = np.isfinite(y[c])
        cov = s * k[np.ix_(seen, seen)] + nu * np.diag(1 / w[c][seen])
        want = np.linalg.slogdet(cov).logabsdet + y[c][seen] @ np.linalg.solve(cov, y[c][seen])
        spread = s * lam[c] + nu
        got = np.log(np.abs(spread)).sum() - gaps[c] * np.log(nu) + (square[c] / spread).sum() - logw[c]
        assert got == pytest.approx(want)


def test_evidence_with_a_mean(spark):
    covs, gram, channels, y, *_ = scoring_inputs(spark)
    mu = np.arange(6.0)
    shifted = channels.withColumn("mu", F.array(*[F.lit(float(x)) for x in mu]))
    for (v, m), ll in scores(E.loglik(shifted, gram, noise_var=0.5)).items():
        assert ll == pytest.approx(log_density(y[v] - mu, 0.5 * covs[m] + 0.5 * np.eye(6)))


def test_evidence_needs_some_noise(spark):
    _, gram, channels, *_ = scoring_inputs(spark)
    with pytest.raises(ValueError, match="no noise"):
        E.loglik(channels.select("voxel", "y"), gram)


def test_noise_grid_marginal_and_posteriors(spark):
    covs, gram, channels, y, *_ = scoring_inputs(spark)
    noise = [0.2, 0.5, 0.7]
    grid = spark.createDataFrame(list(enumerate(noise)), "noise_id int, noise_var double")
    found = E.loglik(channels, gram, grid=grid).cache()
    cube = np.array([[[log_density(y[v], (1 - s) * covs[m] + s * np.eye(6)) for s in noise] for m in covs] for v in range(5)])
    for r in found.collect():
        assert r.ll == pytest.approx(cube[r.voxel, int(r.model[1]), r.noise_id])
    total = lambda x, axis: np.log(np.exp(x).sum(axis=axis))
    marginal = E.marginal(found)
    for (v, m), ll in scores(marginal).items():
        assert ll == pytest.approx(total(cube, 2)[v, int(m[1])])
    joint = E.posterior(E.log_posterior(found))
    assert joint.agg(F.sum("post")).first()[0] == pytest.approx(5)
    per_noise = E.posterior(E.log_posterior(found, ["voxel", "noise_id"]))
    assert per_noise.agg(F.sum("post")).first()[0] == pytest.approx(15)
    for r in E.log_posterior(marginal).collect():
        want = total(cube, 2)[r.voxel]
        assert r.log_post == pytest.approx(want[int(r.model[1])] - total(want, 0))


def test_posteriors_survive_extreme_scores(spark):
    frame = spark.createDataFrame([(1, "a", -1e5), (1, "b", -1e5 + 1), (1, "c", -9e5)], "voxel long, model string, ll double")
    got = {r.model: r.log_post for r in E.log_posterior(frame).collect()}
    assert got["b"] == pytest.approx(-np.log1p(np.exp(-1))) and got["c"] < -7e5


def test_winners_take_the_first_of_equals(spark):
    rows = [(1, "a", 0, -1.0), (1, "b", 1, -1.0), (2, "a", 0, -3.0), (2, "b", 1, -2.0), (3, "a", 0, -1.0), (3, "b", 1, -2.0), (3, "c", 2, -9.0)]
    frame = spark.createDataFrame(rows, "voxel long, model string, ord int, log_post double")
    assert {r.model: r.n_voxels for r in E.winner_counts(frame, "ord").collect()} == {"a": 2, "b": 1}


def test_region_and_scatter(spark):
    trials = trial_frame(spark, [(1, "a", 0, 300.0), (2, "a", 1, 600.0)])
    region = spark.createDataFrame([(2,)], "voxel long")
    assert [(r.voxel, r.v) for r in R.in_region(trials, region, 300).collect()] == [(2, 2.0)]
    places = spark.createDataFrame([(1, 0, 0), (5, 1, 1)], "voxel long, x int, y int")
    found = R.scatter(places, spark.createDataFrame([(1, 0.25)], "voxel long, post double"), ["post"])
    assert {r.voxel: r.post for r in found.collect()} == {1: 0.25, 5: 0.0}


def skewed(spark):
    rng = np.random.default_rng(4)
    values = {"g": np.concatenate([np.full(300, 2.5), rng.normal(0, 1, 500), [1e6], np.full(100, -3.0)]), "h": np.full(9, 1.0), "k": np.array([4.0])}
    rows = [(g, i, float(x)) for g, xs in values.items() for i, x in enumerate(xs)]
    return values, spark.createDataFrame(rows, "grp string, id int, x double").repartition(6)


@pytest.mark.parametrize("bins, groups", [(4, 3), (4096, 3), (16, None)])
def test_ranks_of_skewed_groups(spark, bins, groups):
    values, frame = skewed(spark)
    got = average_ranks(frame, ["grp"], "x", bins=bins, groups=groups).toPandas()
    assert len(got) == sum(map(len, values.values()))
    for g, xs in values.items():
        mine = got[got.grp == g].sort_values("id")["rank"].to_numpy()
        assert np.array_equal(mine, pd.Series(xs).rank().to_numpy())


@pytest.mark.parametrize("bins", [4, 4096])
def test_quantiles_of_skewed_groups(spark, bins):
    values, frame = skewed(spark)
    probs = {"lo": 0.0, "a": 0.1, "b": 0.25, "c": 0.5, "d": 0.77, "hi": 1.0}
    for r in quantiles(frame, ["grp"], "x", probs, bins).collect():
        assert r.n == len(values[r.grp])
        assert np.allclose([r[q] for q in probs], np.quantile(values[r.grp], list(probs.values()))), r.grp


def test_boxplot_summary(spark):
    frame = spark.createDataFrame([("m", float(x)) for x in (1, 2, 10)], "model string, log_post double")
    r = E.boxplot(frame).first()
    assert (r.n, r.whisker_lo, r.q1, r.median, r.q3, r.whisker_hi) == (3, 1.0, 1.5, 2.0, 6.0, 10.0)


def test_models_are_trace_normalised_first(spark):
    k = random_cov(4, 2, 7.0)
    facts = trace_norm(gram_frame(spark, {"a": k})).where("i = j").agg(F.sum("v")).first()[0]
    assert facts == pytest.approx(4.0)



def test_a_channel_without_responses_has_no_evidence(spark):
    _, gram, channels, *_ = scoring_inputs(spark)
    empty = F.when(F.col("voxel") == 1, F.transform("y", lambda x: F.lit(None).cast("double"))).otherwise(F.col("y"))
    found = E.log_posterior(E.loglik(channels.withColumn("y", empty), gram, noise_var=0.8))
    rows = found.collect()
    assert {(r.ll is None, r.log_post is None) for r in rows if r.voxel == 1} == {(True, True)}
    assert all(r.ll is not None and r.log_post is not None for r in rows if r.voxel != 1)
    assert sum(r.n_voxels for r in E.winner_counts(found).collect()) == 4
    assert {r.n for r in E.boxplot(found).collect()} == {4}
