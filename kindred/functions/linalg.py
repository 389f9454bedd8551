"""Dense kernels that run inside tasks, one small matrix pair at a time.

Every matrix pair is given in *core* coordinates: two r x r matrices over a
common orthonormal basis, plus ``extra`` further dimensions in which both
matrices equal ``floor`` times the identity.  A plain N x N pair has extra=0.
"""

from __future__ import annotations

import hashlib

import numpy as np


def pair_rng(seed: int, a: str, b: str, portable: bool = False):
    """A generator that depends on the seed and the pair only, not on task order."""
    if portable:
        return PortableNormal(seed, a, b)
    digest = hashlib.blake2b(f"{seed}\x1f{a}\x1f{b}".encode(), digest_size=16).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


class PortableNormal:
    """Normal numbers that any engine with MD5 can repeat.

    Number (row, axis) of call k comes from the digest of "seed:a:b:k:row:axis": its first two groups of eight
    hexadecimal digits are two uniform numbers, which the Box-Muller transform turns into one normal number.
    """

    def __init__(self, seed: int, a: str, b: str):
        self.key, self.call = f"{seed}:{a}:{b}", 0

    def standard_normal(self, shape: tuple[int, int]) -> np.ndarray:
        rows, axes = shape
        texts = (f"{self.key}:{self.call}:{row}:{axis}".encode() for row in range(rows) for axis in range(axes))
        digits = b"".join(hashlib.md5(t, usedforsecurity=False).digest()[:8] for t in texts)
        u = (np.frombuffer(digits, ">u4").reshape(rows, axes, 2) + 0.5) / 2.0**32
        self.call += 1
        return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


def _range_basis(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nonzero eigenvalues of X'X and V with X V orthonormal; nonzero is relative to the largest one."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    keep = w > max(w[-1], 0.0) * 1e-13 if len(w) else np.zeros(0, bool)
    return w[keep], v[:, keep] / np.sqrt(w[keep])


def common_core(aa: np.ndarray, bb: np.ndarray, ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Core form of XX' and YY' out of X'X, Y'Y and X'Y.

    The basis is that of the range of X and of what the range of Y has beside it. Both ranges are found from
    their own matrix alone, so a common or separate scale of X and Y cancels.
    """
    (wa, va), (wb, vb) = _range_basis(aa), _range_basis(bb)
    cosines = va.T @ ab @ vb
    # Y's basis is X's basis times the cosines, plus what is left over: its Gram matrix is 1 - C'C
    u, sigma, vt = np.linalg.svd(cosines, full_matrices=True)
    rest = np.ones(len(wb))
    rest[: len(sigma)] = 1 - np.minimum(sigma, 1) ** 2
    beside = rest > 1e-13
    left = np.sqrt(rest[beside])[:, None] * vt[beside]
    full = np.vstack([cosines, left])
    core = np.zeros((len(full), len(full)))
    core[: len(wa), : len(wa)] = np.diag(wa)
    return core, (full * wb) @ full.T


def center(k: np.ndarray) -> np.ndarray:
    """Subtract row and column means, add the grand mean."""
    rows = k.mean(axis=1, keepdims=True)
    return k - rows - rows.T + k.mean()


def _psd_root(k: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((k + k.T) / 2)
    return (v * np.sqrt(np.clip(w, 0, None))) @ v.T


class Factors:
    """A matrix with its decompositions, each made once and only if it is asked for."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self._made = matrix, {}

    def _once(self, key, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    @property
    def root(self) -> np.ndarray:
        return self._once("root", lambda: _psd_root(self.matrix))

    @property
    def low(self) -> np.ndarray:
        def make():
            try:
                return np.linalg.cholesky(self.matrix)
            except np.linalg.LinAlgError as error:
                return error

        low = self._once("low", make)
        if isinstance(low, Exception):
            raise low
        return low

    @property
    def centred(self) -> "Factors":
        return self._once("centred", lambda: Factors(center(self.matrix)))

    def shrunk(self, scale: float, lmbd: float) -> np.ndarray:
        """(scale S + lmbd I)^-1 scale S."""

        def make() -> np.ndarray:
            s = scale * self.matrix
            return np.linalg.solve(s + lmbd * np.eye(len(s)), s)

        return self._once((scale, lmbd), make)


def trace_root_product(s1: Factors, s2: Factors) -> float:
    """Sum of the singular values of S1^1/2 S2^1/2."""
    return float(np.linalg.svd(s1.root @ s2.root, compute_uv=False).sum())


def relative_spectrum(s1: np.ndarray, s2: Factors, delta=None):
    """Eigenvalues of S1 relative to S2 and, whitened by S2, the mean difference."""
    low = s2.low
    half = np.linalg.solve(low, s1)
    lam, vec = np.linalg.eigh(np.linalg.solve(low, half.T))
    if lam[0] <= 0:
        raise np.linalg.LinAlgError("matrix is not positive definite")
    shift = np.zeros(len(lam)) if delta is None else vec.T @ np.linalg.solve(low, delta)
    return lam, shift


def log_ratios(lam, shift, samples, rng):
    """ln p/q at draws from p = N(shift, diag lam) and at draws from q = N(0, I)."""
    at_p, at_q = np.empty(samples), np.empty(samples)
    step = max(1, 4_000_000 // max(len(lam), 1))
    const = -0.5 * np.log(lam).sum()
    for lo in range(0, samples, step):
        hi = min(samples, lo + step)
        z = rng.standard_normal((hi - lo, len(lam)))
        at_p[lo:hi] = const + 0.5 * (((shift + np.sqrt(lam) * z) ** 2) - z**2).sum(axis=1)
        z = rng.standard_normal((hi - lo, len(lam)))
        at_q[lo:hi] = const + 0.5 * (z**2 - (z - shift) ** 2 / lam).sum(axis=1)
    return at_p, at_q


def affinity_log(lam: np.ndarray, shift: np.ndarray, t: np.ndarray) -> np.ndarray:
    """ln of the integral of p^u q^(1-u) with u = 1/2 + it, for p = N(shift, diag lam) and q = N(0, I).

    As a function of t this is the characteristic function of ln p/q, a weighted sum of non-central chi-squares, under the
    unnormalised density sqrt(p q). All factors have positive real parts, so principal logarithms are continuous.
    """
    away = (lam != 1) | (shift != 0)
    lam, shift = lam[away], shift[away]
    out = np.zeros(len(t), complex)
    step = max(1, 1_000_000 // max(len(lam), 1))
    for lo in range(0, len(t), step):
        u = (0.5 + 1j * t[lo : lo + step])[:, None]
        parts = u * np.log(lam) + np.log(u / lam + 1 - u) + u * (1 - u) * shift**2 / (u + (1 - u) * lam)
        out[lo : lo + step] = -0.5 * parts.sum(axis=1)
    return out


def _one_minus_real(z: np.ndarray) -> np.ndarray:
    """1 - Re exp(z) without cancellation near z = 0."""
    return -np.expm1(z.real) * np.cos(z.imag) + 2 * np.sin(z.imag / 2) ** 2


def _integrated(value, upper: float, tolerance: float = 1e-12) -> float:
    """Trapezoidal rule from 0 for an even analytic function, whose error falls exponentially with the number of nodes."""
    step = upper / 64
    nodes = value(np.arange(65) * step)
    total = (nodes.sum() - nodes[0] / 2) * step
    for _ in range(16):
        between = value((np.arange(round(upper / step)) + 0.5) * step)
        finer = total / 2 + between.sum() * step / 2
        done = abs(finer - total) <= tolerance
        total, step = finer, step / 2
        if done:
            break
    return float(total)


def exact_total_variation(lam: np.ndarray, shift: np.ndarray) -> float:
    """Half the integral of abs(p - q).

    The smaller one of p and q is sqrt(p q) exp(-abs(ln p/q) / 2). Parseval turns its integral into that of the characteristic
    function times 1 / (pi (t^2 + 1/4)), an even weight that integrates to 1; t = sinh(x) / 2 makes it decay exponentially.
    """

    def value(x: np.ndarray) -> np.ndarray:
        return _one_minus_real(affinity_log(lam, shift, np.sinh(x) / 2)) / np.cosh(x)

    return min(1.0, max(0.0, 2 / np.pi * _integrated(value, 40.0)))


def exact_jensen_shannon(lam: np.ndarray, shift: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits; its kernel's transform is pi / (cosh(pi t) (t^2 + 1/4))."""

    def value(t: np.ndarray) -> np.ndarray:
        return _one_minus_real(affinity_log(lam, shift, t)) / (np.cosh(np.pi * t) * (t * t + 0.25))

    return min(1.0, max(0.0, _integrated(value, 14.0) / (2 * np.log(2))))


def inverse_beta(q: float, a: float, b: float) -> float:
    """Quantile of the Beta(a, b) distribution by bisection on its CDF."""
    if b == 1.0:
        return q ** (1.0 / a)
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _beta_cdf(mid, a, b) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function through its continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    # modified Lentz evaluation of the standard fraction (DLMF 8.17.22)
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for step in range(400):
        m = step // 2
        if step == 0:
            num = 1.0
        elif step % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if step and abs(c * d - 1) < 1e-15:
            break
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * (f - 1) / a
