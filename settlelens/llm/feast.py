"""Largest eigenpairs of a symmetric matrix by contour integration, with a proof that none is missed.

``largest_pairs`` first brackets the wanted eigenvalues: the inertia of ``V - s I``, read off an LDL^T
factorization with 1x1 and 2x2 pivots, tells how many eigenvalues lie above ``s``, and bisection puts the
lower end of the interval into the middle of the gap below the last wanted one. The spectral projector of
the interval is the integral of the resolvent along a circle through its ends; the trapezoid rule turns it
into a few complex shifted solves with a block of vectors. The block is orthonormalised and Rayleigh-Ritz
extracts eigenpairs, and this repeats until their residuals are at rounding level. At the end the number of
Ritz values in the interval must equal the inertia count, or the block is enlarged and the run repeated.

Eigenvalues too close to be told apart are taken together, so the interval may hold more than are wanted;
the first of them in falling order are returned. The block can grow to the whole space, where Rayleigh-Ritz
is the full problem.
"""

from __future__ import annotations

import numpy as np

POINTS = 16  # solves on the upper half of the circle; the lower half is conjugate
SWEEPS = 60
ALPHA = (1 + 17**0.5) / 8  # the usual pivot threshold of symmetric indefinite factorization


def count_above(v: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of ``v`` above ``shift``: the positive ones of D in P (V - sI) P' = L D L'."""
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        # Complete pivoting: the largest diagonal entry, or the 2x2 block around the largest entry off it.
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[i], off[p, q]) == 0:
            break  # what is left is zero
        if diagonal[i] >= ALPHA * off[p, q]:
            above += a[i, i] > 0
            keep = np.delete(np.arange(len(a)), i)
            col = a[keep, i]
            a = a[np.ix_(keep, keep)] - np.outer(col, col) / a[i, i]
        else:
            above += 1  # a 2x2 pivot has one eigenvalue of each sign
            keep = np.delete(np.arange(len(a)), [p, q])
            block, cols = a[np.ix_([p, q], [p, q])], a[np.ix_(keep, [p, q])]
            a = a[np.ix_(keep, keep)] - cols @ np.linalg.solve(block, cols.T)
        a = (a + a.T) / 2
    return int(above)


def bracket(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): an interval with the ``wanted`` largest eigenvalues and those not apart from the last."""
    radius = np.abs(v).sum(axis=1).max()
    high = float(radius * 1.01)
    if wanted >= len(v):
        return -high, high, len(v)
    # The last wanted eigenvalue lies in (a, b], the next in (c, d].
    def locate(rank: int) -> tuple[float, float]:
        lo, hi = -high, high
        while hi - lo > 1e-13 * radius:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count_above(v, mid) >= rank else (lo, mid)
        return lo, hi

    rank = wanted
    floor = locate(rank)[0]
    while rank < len(v):
        ceiling = locate(rank + 1)[1]
        if floor - ceiling > 1e-10 * radius:
            return (floor + ceiling) / 2, high, rank
        # All that cannot be told apart from this one, at once.
        rank = max(rank + 1, count_above(v, floor - 1e-10 * radius))
        floor = locate(rank)[0]
    return -high, high, len(v)


def contour_pairs(v: np.ndarray, low: float, high: float, block: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values in [low, high] in falling order and their vectors, from a block of so many vectors."""
    n = len(v)
    middle, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * np.pi * (np.arange(POINTS) + 0.5) / POINTS)
    shifted = [(middle + t) * np.eye(n) - v for t in turns]
    scale = max(np.abs(v).max(), np.finfo(float).tiny)
    y = rng.standard_normal((n, block))
    last = np.inf
    for _ in range(SWEEPS):
        if block < n:
            projected = sum((t * np.linalg.solve(m, y)).real for t, m in zip(turns, shifted, strict=True)) / POINTS
        else:
            projected = y
        q = np.linalg.qr(projected)[0]
        values, turn = np.linalg.eigh(q.T @ v @ q)
        y = q @ turn
        inside = np.flatnonzero((values >= low) & (values <= high))
        error = np.abs(v @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
        # At rounding level, or no better than in the sweep before.
        if len(inside) and (error <= 4e-16 * scale or (error <= 1e-13 * scale * n and error >= last / 2)):
            break
        last = error
    order = inside[::-1]
    return values[order], y[:, order]


def largest_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of the symmetric ``v``, falling, and unit eigenvectors as columns.

    A vector's entry of largest size is positive, so equal matrices give equal vectors.
    """
    n = len(v)
    if not n or not wanted or not np.abs(v).max():
        k = min(n, wanted)
        return np.zeros(k), np.eye(n)[:, :k]
    low, high, count = bracket(v, wanted)
    rng = np.random.default_rng(0)
    block = min(n, max(2 * count, count + 8))
    while True:
        values, vectors = contour_pairs(v, low, high, block, rng)
        if len(values) == count or block == n:
            break
        block = min(n, 2 * block)  # the inertia says that some are missing
    values, vectors = values[:wanted], vectors[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs
