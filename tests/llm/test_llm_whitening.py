import math

import numpy as np
import pytest
from llm_cases import CLASHES

from kindred.llm import whitening as W
from kindred.llm.spectral import leading_eigenvectors


@pytest.mark.parametrize("values", [
    np.linspace(5, 1, 30), 10.0 ** -np.linspace(0, 12, 40), np.repeat([4.0, 2.0, 2.0, 1.0], 8), np.zeros(6), np.ones(7),
    1 + 1e-9 * np.arange(20), np.r_[np.ones(3), np.zeros(20)], np.array([3.0]),
])
def test_eigenvectors_against_a_dense_solver(values):
    m = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(m).standard_normal((m, m)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    top = max(values.max(), 1e-300)
    found, vectors = leading_eigenvectors(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert len(found) == min(16, m) and np.abs(found - want).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * top


def vectors(seed=1, n=300, d=6):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d))
    return [[float(v) for v in row] for row in x.astype(np.float32)]


def frame(spark, rows):
    extra = "".join(f", `{c}` string" for c in (*CLASHES, "_whitened"))
    return spark.createDataFrame([(i, v, *[f"own{i}"] * (len(CLASHES) + 1)) for i, v in rows], f"vec_id long, embedding array<float>{extra}").repartition(3)


def brute(rows, k):
    """Results by definition, over the rows with whole vectors."""
    kept = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(64 * float(np.float32(e))) + 1000000 for e in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ u / np.sqrt(e), e / np.trace(cov)


def test_against_brute_force_with_repeats_and_broken_rows(spark):
    good = vectors()
    bad = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [0.0] * 5]
    rows = list(enumerate(good + good[:40] + [good[0]] * 60 + bad))
    df = frame(spark, rows)
    model = W.fit(df, components=4)
    got = {r.vec_id: r for r in W.whiten(df, model).collect()}
    ids, n, deviation, whitened, explained = brute(rows, 4)
    assert sorted(got) == sorted(ids) and model.n == n and model.identity_error < 1e-10
    assert np.allclose(model.eigenvalues / model.trace, explained, rtol=1e-10)
    signs = np.sign((np.array([got[i]["_whitened"] for i in ids]) * whitened).sum(axis=0))
    assert np.abs(np.array([got[i]["_whitened"] for i in ids]) * signs - whitened).max() < 1e-9
    assert [got[i]["_deviation"] for i in ids] == deviation.tolist()
    assert all(r["part"] == f"own{i}" for i, r in got.items())


def test_fewer_directions_than_asked_for(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 0.0]) for i in range(40)]
    df = frame(spark, flat)
    model = W.fit(df)
    assert len(model.eigenvalues) == 1 and model.n == 7
    assert all(len(r["_whitened"]) == 1 for r in W.whiten(df, model).collect())
    one = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    alone = W.fit(one)
    assert alone.n == 1 and [(r["_deviation"], r["_whitened"]) for r in W.whiten(one, alone).collect()] == [(0, [])] * 3


def test_empty_tables_other_lengths_and_huge_entries(spark):
    empty = frame(spark, [(1, None)])
    model = W.fit(empty)
    assert model.n == 0 and W.whiten(empty, model).count() == 0
    mixed = [(i, v) for i, v in enumerate(vectors(2, 30, 3))] + [(100, [1.0, 2.0]), (101, [3e38, 0.0, -3e38])]
    df = frame(spark, mixed)
    model = W.fit(df, components=2)
    got = {r.vec_id: r["_deviation"] for r in W.whiten(df, model).collect()}
    assert 100 not in got and 101 in got and model.n == 31
    x = np.array([[math.floor(max(min(64 * float(np.float32(e)), W.LARGEST), -W.LARGEST)) + 1000000 for e in v] for i, v in mixed if i != 100], dtype=object)
    exact = {i: int(v) for i, v in zip([i for i, _ in mixed if i != 100], ((31 * x - x.sum(axis=0)) ** 2).sum(axis=1))}
    assert got == {i: v if v < 1 << 63 else None for i, v in exact.items()}
