import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.plans.registry import MEASURES, per_measure, resolve


@pytest.mark.parametrize(
    "name, want",
    [("TVD", "tvd"), ("RSA-rank", "rsarank"), ("rsa_corr", "rsacorr"), ("Jensen Shannon - Distance", "jensenshannondistance"), ("", "")],
)
def test_names_are_simplified_alike_in_python_and_spark(spark, name, want):
    assert S.simplify_name(name) == want
    assert spark.createDataFrame([(name,)], "s string").select(S.simplified(F.col("s"))).first()[0] == want


def _apply(spark, values, rule):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in frame.orderBy("i").select(rule(F.col("x"))).collect()]


def test_small_negatives_are_zeroed_strictly_inside_the_bounds(spark):
    values = [-1e-7, -0.5e-7, 0.0, 1e-9, -1.0, math.inf, -math.inf]
    assert _apply(spark, values, S.zero_small_negative) == [-1e-7, 0.0, 0.0, 1e-9, -1.0, math.inf, -math.inf]
    assert math.isnan(_apply(spark, [math.nan], S.zero_small_negative)[0])


def test_cosines_are_clamped_only_close_to_one(spark):
    values = [1 + 1e-8, -1 - 1e-8, 1.0, 0.5, 1 + 1e-3, -1 - 1e-3]
    assert _apply(spark, values, S.clamp_cosine) == [1.0, -1.0, 1.0, 0.5, 1 + 1e-3, -1 - 1e-3]


def test_eigenvalues_are_clipped_or_refused(spark):
    frame = spark.createDataFrame([([2.0, -1e-3, 0.0],)], "w array<double>")
    assert frame.select(S.clip_eigenvalues(F.col("w"))).first()[0] == [2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="below tolerance"):
        spark.createDataFrame([([-2e-3],)], "w array<double>").select(S.clip_eigenvalues(F.col("w"))).collect()


def test_log_add_exp_does_not_overflow(spark):
    frame = spark.createDataFrame([(1000.0, 999.0)], "a double, b double")
    assert frame.select(S.log_add_exp(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1000 + math.log1p(math.exp(-1)))


def test_every_alias_resolves_and_unknown_names_fail():
    assert {resolve(n).name for n in ("Total Variation", "TVD", "total-variation_distance")} == {"tvd"}
    assert resolve("Normalized Bures Similarity").name == resolve("normburessim").name == "nbs"
    assert resolve("kernel_gulp").name == "gulp" and resolve("KL-div").name == "kldiv"
    assert len(MEASURES) == 17
    with pytest.raises(NotImplementedError):
        resolve("euclid")


def test_conditioning_parameters_spread_over_measures():
    both = per_measure(("cka", "TVD"), b=[0.01, 0], noise_var=None, normalize=False)
    assert [(m.name, p["b"], p["normalize"]) for m, p in both] == [("cka", 0.01, False), ("tvd", 0.0, False)]
    for bad in ({"b": "x"}, {"noise_var": "x"}, {"normalize": 1}, {"b": True}):
        with pytest.raises(TypeError):
            per_measure("cka", **bad)
    with pytest.raises(ValueError):
        per_measure(["cka", "tvd"], b=[0.1])
