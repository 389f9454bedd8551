"""Textbook forms of every measure on two full matrices, for small inputs only."""

import numpy as np


def condition(k, noise_var=None, b=0.01, normalize=True):
    n = len(k)
    if normalize:
        k = k * n / np.trace(k)
    if b or noise_var is not None:
        nu = noise_var if noise_var is not None else n * b / (1 + n * b)
        k = (1 - nu) * k + nu * np.eye(n)
    return k


def _root(m):
    w, v = np.linalg.eigh(m)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def _fidelity(x, y):
    r = _root(x)
    return np.trace(_root(r @ y @ r))


def _centre(k):
    h = np.eye(len(k)) - 1 / len(k)
    return h @ k @ h


def _upper(k):
    d = np.diag(k)
    return (d[:, None] + d - 2 * k)[np.triu_indices(len(k), 1)]


def _mean_ranks(x):
    x = np.round(x, 9)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def _neighbours(k, count):
    c = np.round(k / np.sqrt(np.outer(np.diag(k), np.diag(k))), 12)
    return [set(sorted((j for j in range(len(k)) if j != i), key=lambda j: (-c[i, j], j))[:count]) for i in range(len(k))]


def measure(name, x, y, lmbd=0.1, k=3):
    n = len(x)
    if name == "wasserstein":
        return np.sqrt(max(np.trace(x) + np.trace(y) - 2 * _fidelity(x, y), 0))
    if name in ("bhattacharyya", "hellinger"):
        d = 0.5 * (np.linalg.slogdet((x + y) / 2)[1] - 0.5 * (np.linalg.slogdet(x)[1] + np.linalg.slogdet(y)[1]))
        return d if name == "bhattacharyya" else np.sqrt(1 - np.exp(-d))
    if name == "kldiv":
        return 0.25 * (np.trace(np.linalg.inv(y) @ x) + np.trace(np.linalg.inv(x) @ y)) - n / 2
    if name == "mahalanobis":
        return 0.0
    if name in ("cka", "distcorr"):
        p, q = _centre(x), _centre(y)
        c = (p * q).sum() / np.sqrt((p * p).sum() * (q * q).sum())
        return c if name == "cka" else np.sqrt(c)
    if name == "gulp":
        p, q = (np.linalg.inv(m * n / np.trace(m) + lmbd * np.eye(n)) @ (m * n / np.trace(m)) for m in (x, y))
        return np.sqrt(np.trace(p @ p) + np.trace(q @ q) - 2 * np.trace(p @ q))
    if name == "procrustes":
        p, q = _centre(x), _centre(y)
        return np.sqrt(max(np.trace(p) + np.trace(q) - 2 * _fidelity(p, q), 0))
    if name == "nbs":
        p, q = (c * n / np.trace(c) for c in (_centre(x), _centre(y)))
        return _fidelity(p, q)
    d1, d2 = _upper(x), _upper(y)
    if name == "rsacorr":
        return np.corrcoef(d1, d2)[0, 1]
    if name in ("rsacos", "rsaarccos"):
        c = d1 @ d2 / np.sqrt((d1 @ d1) * (d2 @ d2))
        return c if name == "rsacos" else np.arccos(c)
    if name == "rsarank":
        r1, r2, m = _mean_ranks(d1), _mean_ranks(d2), len(d1)
        return 12 * ((r1 - r1.mean()) * (r2 - r2.mean())).sum() / (m**3 - m)
    if name == "jaccard":
        return np.mean([len(a & b) / len(a | b) for a, b in zip(_neighbours(x, k), _neighbours(y, k))])
    raise KeyError(name)
