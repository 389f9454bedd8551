"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar decompositions.

The polar factor of A - s I is the matrix sign of A - s I, so (sign + I) / 2 projects on the eigenvectors with
eigenvalues above the shift s. It is found by the QR-based dynamically weighted Halley iteration (QDWH, Nakatsukasa and Higham),
which needs matrix products and QR only. Both invariant subspaces are split again until they have one dimension or
one eigenvalue; subspaces that cannot hold one of the wanted eigenvectors are left whole.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar_sign(a: np.ndarray, least: float) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix whose singular values are at least ``least`` (> 0)."""
    alpha = np.linalg.norm(a)
    x, low = a / alpha, min(max(least / alpha, _EPS), 1.0)
    eye = np.eye(len(a))
    for _ in range(40):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[: len(a)] @ q[len(a) :].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if abs(1 - low) < 10 * _EPS and moved < _EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal.

    The mean of the eigenvalues lies strictly between the least and the largest. A shift too near an eigenvalue leaves the
    subspaces coupled; then others around it are tried, and the pair with the least coupling is taken.
    """
    m, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    scale = np.linalg.norm(a)
    if spread <= m * _EPS * scale:
        return None
    rng = np.random.default_rng(m)
    best, least_coupling = None, np.inf
    for step in (0.0, 0.07, -0.07, 0.19, -0.19, 0.41, -0.41, 0.83, -0.83):
        shifted = a - (mean + step * spread) * np.eye(m)
        try:
            least = 1 / np.linalg.norm(np.linalg.inv(shifted))
        except np.linalg.LinAlgError:
            continue
        if not np.isfinite(least) or least < 1e-12 * np.linalg.norm(shifted):
            continue
        projector = (polar_sign(shifted, least) + np.eye(m)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < m:
            continue
        # the projector's range, from its action on random vectors; twice, since these may be badly conditioned
        basis = np.linalg.qr(projector @ rng.standard_normal((m, rank)))[0]
        whole = np.linalg.qr(projector @ basis, mode="complete")[0]
        upper, lower = whole[:, :rank], whole[:, rank:]
        coupling = np.linalg.norm(lower.T @ a @ upper)
        if coupling < least_coupling:
            best, least_coupling = (upper, lower), coupling
        if coupling <= 10 * m * _EPS * scale:
            break
    return best


def leading_eigenvectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns; all of them if k exceeds the size."""
    a = (a + a.T) / 2
    m = len(a)
    # every subspace on the stack holds smaller eigenvalues than those above it
    todo, vectors = [np.eye(m)], []
    while todo and sum(v.shape[1] for v in vectors) < k:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        parts = _split(inner) if len(inner) > 1 else None
        if parts is None:
            vectors.append(basis)
        else:
            todo += [basis @ parts[1], basis @ parts[0]]
    found = np.hstack(vectors) if vectors else np.zeros((m, 0))
    # bases are products of many factors: one more orthogonalisation, which moves them by rounding only
    q, r = np.linalg.qr(found)
    found = q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))
    values = np.einsum("ij,ij->j", found, a @ found)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], found[:, order]
