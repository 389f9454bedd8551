"""Numeric value of each matrix measure for one pair in core coordinates.

Called from inside tasks.  ``Conditioned`` carries the two noise-conditioned
core matrices; see :mod:`kindred.functions.linalg` for ``extra``/``floor``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from kindred.functions import linalg as la


@dataclass
class Conditioned:
    s1: np.ndarray
    s2: np.ndarray
    n: int
    extra: int = 0
    floor: float = 0.0
    delta: np.ndarray | None = None
    #: the matrices with decompositions that other pairs may share
    one: la.Factors | None = None
    two: la.Factors | None = None
    _shared: dict = field(default_factory=dict)

    def __post_init__(self):
        self.one = self.one or la.Factors(self.s1)
        self.two = self.two or la.Factors(self.s2)

    @property
    def traces(self) -> tuple[float, float]:
        rest = self.extra * self.floor
        return float(np.trace(self.s1)) + rest, float(np.trace(self.s2)) + rest

    @property
    def spectrum(self):
        """One Cholesky and one eigenvalue problem serve KL, Bhattacharyya,
        Hellinger, total variation and Jensen-Shannon alike."""
        if "spectrum" not in self._shared:
            self._shared["spectrum"] = la.relative_spectrum(self.s1, self.two, self.delta)
        return self._shared["spectrum"]

    def root_trace(self) -> float:
        if "root" not in self._shared:
            self._shared["root"] = la.trace_root_product(self.one, self.two)
        return self._shared["root"] + self.extra * self.floor


def _non_negative(d: float, epsilon: float = 1e-7) -> float:
    return 0.0 if -epsilon < d < 0 else d


def _quadratic(matrix: np.ndarray, delta: np.ndarray | None) -> float:
    return 0.0 if delta is None else float(delta @ np.linalg.solve(matrix, delta))


def wasserstein(c: Conditioned) -> float:
    shift = 0.0 if c.delta is None else float(c.delta @ c.delta)
    gap = sum(c.traces) - 2 * c.root_trace()
    # rounding leaves gaps of a few ulp of the traces for equal matrices
    return float(np.sqrt(shift + max(gap, 0.0)))


def mahalanobis(c: Conditioned) -> float:
    if c.delta is None:
        return 0.0
    return float(np.sqrt(_quadratic((c.s1 + c.s2) / 2, c.delta)))


def bhattacharyya(c: Conditioned, root_mean_term: bool = False) -> float:
    lam, _ = c.spectrum
    logs = 0.5 * float(np.sum(np.log((1 + lam) / 2) - 0.5 * np.log(lam)))
    term = _quadratic((c.s1 + c.s2) / 2, c.delta)
    return _non_negative((np.sqrt(term) if root_mean_term else term) / 8 + logs)


def hellinger(c: Conditioned, root_mean_term: bool = False) -> float:
    return float(np.sqrt(max(0.0, -np.expm1(-bhattacharyya(c, root_mean_term)))))


def kl_divergence(c: Conditioned) -> float:
    """Mean of the two directed Kullback-Leibler divergences."""
    lam, _ = c.spectrum
    means = _quadratic(c.s1, c.delta) + _quadratic(c.s2, c.delta)
    return _non_negative(0.25 * float(np.sum(lam + 1 / lam - 2)) + 0.25 * means)


def total_variation(c: Conditioned, samples: int | None = None, rng=None) -> float:
    """By numerical integration, or estimated from so many draws of each distribution."""
    if samples is None:
        return la.exact_total_variation(*c.spectrum)
    at_p, at_q = la.log_ratios(*c.spectrum, samples, rng)
    excess = np.maximum(-np.expm1(-at_p), 0).mean() + np.maximum(-np.expm1(at_q), 0).mean()
    return max(0.0, float(excess) / 2)


def jensen_shannon(c: Conditioned, samples: int | None = None, rng=None) -> float:
    """Divergence in bits (not its square root), by numerical integration or estimated from draws."""
    if samples is None:
        return la.exact_jensen_shannon(*c.spectrum)
    at_p, at_q = la.log_ratios(*c.spectrum, samples, rng)
    mixed = np.logaddexp(0, -at_p).mean() + np.logaddexp(0, at_q).mean()
    return max(0.0, float(1 - mixed / (2 * np.log(2))))


def gulp(c: Conditioned, lmbd: float) -> float:
    parts, tails = [], []
    for s, trace in zip((c.one, c.two), c.traces):
        scale = c.n / trace
        parts.append(s.shrunk(scale, lmbd))
        tails.append(scale * c.floor / (scale * c.floor + lmbd) if c.floor else 0.0)
    gap = np.linalg.norm(parts[0] - parts[1]) ** 2 + c.extra * (tails[0] - tails[1]) ** 2
    return float(np.sqrt(gap))


def centred_alignment(c: Conditioned) -> float:
    """CKA; the pair has to be centred already."""
    rest = c.extra * c.floor**2
    dot = [float(np.sum(x * y)) + rest for x, y in ((c.s1, c.s2), (c.s1, c.s1), (c.s2, c.s2))]
    return dot[0] / np.sqrt(dot[1]) / np.sqrt(dot[2])


def _distances(s: np.ndarray) -> np.ndarray:
    """Squared distances of the stimuli i < j, of a whole matrix."""
    d = np.diag(s)
    return (d[:, None] + d - 2 * s)[np.triu_indices(len(s), 1)]


def distance_similarity(c: Conditioned, kind: str) -> float:
    """Pearson correlation ("rsacorr"), cosine ("rsacos") or its angle ("rsaarccos") of the distances; whole matrices only."""
    one, two = _distances(c.s1), _distances(c.s2)
    if kind == "rsacorr":
        one, two = one - one.mean(), two - two.mean()
    cosine = float(one @ two / np.sqrt(one @ one) / np.sqrt(two @ two))
    if 0 < abs(cosine) - 1 <= 1e-7:
        cosine = float(np.sign(cosine))
    return float(np.arccos(cosine)) if kind == "rsaarccos" else cosine


def rank_similarity(c: Conditioned) -> float:
    """Spearman correlation of the distances from mean ranks, without tie correction; whole matrices only."""

    def ranks(s: np.ndarray) -> np.ndarray:
        _, which, count = np.unique(np.round(_distances(s), 12), return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[which]

    one, two = ranks(c.s1), ranks(c.s2)
    n = float(len(one))
    return float(12 * (one @ two - n * (n + 1) * (n + 1) / 4) / (n * n * n - n))


def neighbour_overlap(c: Conditioned, k: int) -> float:
    """Mean Jaccard overlap of the k nearest other stimuli by cosine, ties to the smaller index; whole matrices only."""

    def nearest(s: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.diag(s))
        cosine = np.round(s / np.outer(root, root), 12)
        np.fill_diagonal(cosine, -np.inf)
        # the stimulus itself comes last
        return np.argsort(-cosine, axis=1, kind="stable")[:, : min(k, len(s) - 1)]

    return float(np.mean([len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(nearest(c.s1).tolist(), nearest(c.s2).tolist())]))


def procrustes(c: Conditioned) -> float:
    """On a centred pair."""
    return float(np.sqrt(max(sum(c.traces) - 2 * c.root_trace(), 0.0)))


def bures_similarity(c: Conditioned) -> float:
    """On a centred pair; not divided by n, so equal matrices give n."""
    t1, t2 = c.traces
    return c.n * c.root_trace() / np.sqrt(t1 * t2)
