"""Eigenpairs of a symmetric matrix inside chosen intervals, by FEAST contour integration.

Polizzi, "Density-matrix-based algorithm for solving eigenvalue problems" (2009): the projector
on the eigenvectors whose eigenvalues lie in an interval is a contour integral of the
resolvent. Quadrature turns it into a few solves with complex shifts; Rayleigh-Ritz on the
projected block gives the pairs, and the block is projected again until they are exact. How many
eigenvalues an interval holds is known beforehand from the inertia of two shifted matrices
(the signs of the pivots of an LDL factorisation of the tridiagonal form), so that none is
missed and intervals can be cut where no eigenvalue is near.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the upper half of a contour; doubled while pairs do not converge.
POINTS = 8
#: Eigenvalues of an interval, at most, where the spectrum can be cut.
HOLDS = 8
#: Residual, relative to the largest eigenvalue, at which a pair is exact.
EXACT = 2e-14
ROUNDS = 40
#: Eigenvalues closer than this part of the largest are kept in one interval.
UNCUT = 1e-11


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues (Householder)."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k:]
        block -= 2 * np.outer(x, x @ block)
        block = a[k:, k + 1 :]
        block -= 2 * np.outer(block @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Counts of eigenvalues above a shift."""

    def __init__(self, a: np.ndarray):
        self._d, e = tridiagonal(a)
        self._e2 = np.concatenate(([0.0], e * e))
        self._tiny = np.finfo(float).eps * max(float(np.abs(self._d).max(initial=0)), float(np.sqrt(self._e2.max())), 1e-300)

    def above(self, shift: float) -> int:
        pivot, positive = 1.0, 0
        for d, e2 in zip(self._d.tolist(), self._e2.tolist(), strict=True):
            pivot = d - shift - e2 / pivot
            if abs(pivot) < self._tiny:
                pivot = -self._tiny
            positive += pivot > 0
        return positive

    def nth(self, n: int, low: float, high: float) -> float:
        """About the ``n``-th largest eigenvalue (from 1), which lies between ``low`` and ``high``."""
        while (at := (low + high) / 2) not in (low, high) and high - low > self._tiny:
            if self.above(at) >= n:
                low = at
            else:
                high = at
        return low


def intervals(inertia: Inertia, k: int, low: float, high: float, scale: float) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the ``k`` largest eigenvalues, and those that cannot be cut off.

    ``low`` and ``high`` are no eigenvalues; an interval ends half way to the next eigenvalue, as far on both sides.
    """
    total, known = inertia.above(low), [high + 2 * scale]  # beyond the largest there is room
    out, done, last = [], 0, 0
    while done < k:
        best, j = None, done
        while j < total and (j - done < HOLDS or best is None):
            j += 1
            while len(known) <= min(j + 1, total):
                known.append(inertia.nth(len(known), low, min(known[-1], high)))
            gap = min(known[done] - known[done + 1], known[j] - (known[j + 1] if j < total else 2 * low - known[j]))
            if gap > UNCUT * scale:
                quality = gap / (known[done + 1] - known[j] + gap)
                if best is None or quality >= best[0]:
                    best = quality, j, gap / 2
            if j >= k and best:
                break
        quality, last, half = best if best else (0, j, UNCUT * scale / 2)
        out.append((known[last] - half, known[done + 1] + half, last - done))
        done = last
    return out


def project(a: np.ndarray, y: np.ndarray, low: float, high: float, points: int) -> np.ndarray:
    """Quadrature of the resolvent around ``[low, high]``, applied to the block ``y``."""
    centre, radius, out = (low + high) / 2, (high - low) / 2, np.zeros_like(y)
    for angle in (np.arange(points) + 0.5) * np.pi / points:
        turn = radius * np.exp(1j * angle)
        out += (turn * np.linalg.solve((centre + turn) * np.eye(len(a)) - a, y)).real / points
    return out


def pairs_between(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` inside ``(low, high)``; an error if not all are found."""
    y = np.random.default_rng(11).standard_normal((len(a), min(len(a), count + max(4, count // 2))))
    points, scale = POINTS, float(np.abs(a).sum(axis=1).max())
    best = np.inf
    for turn in range(ROUNDS):
        q, _ = np.linalg.qr(project(a, y, low, high, points))
        values, inner = np.linalg.eigh(q.T @ a @ q)  # Rayleigh-Ritz, as small as the block
        y = q @ inner
        inside = np.flatnonzero((values > low) & (values < high))
        residuals = np.linalg.norm(a @ y[:, inside] - y[:, inside] * values[inside], axis=0)
        found = inside[residuals <= EXACT * scale]
        if len(found) == count:
            return values[found], y[:, found]
        worst = float(np.sort(residuals)[: count].max(initial=0)) if len(inside) >= count else np.inf
        # what rounding allows has been reached
        if len(inside) == count and turn > 2 and worst <= 50 * EXACT * scale and worst >= best / 2:
            return values[inside], y[:, inside]
        if worst > best / 10 and points < 64:
            points *= 2
        best = min(best, worst)
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, not all converged")


def largest(a: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above ``least`` (fewer, if there are) and their unit eigenvectors."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    scale = float(np.abs(a).sum(axis=1).max())  # no eigenvalue is larger
    inertia, high = Inertia(a), 1.01 * scale
    k = min(k, inertia.above(least))
    if k == 0:
        return np.empty(0), np.empty((len(a), 0))
    cut = intervals(inertia, k, least, high, scale)
    for low, top, count in cut:
        if inertia.above(low) - inertia.above(top) != count:
            raise ArithmeticError("an interval is not cut between eigenvalues")
    found = [pairs_between(a, *each) for each in cut]
    # one more Rayleigh-Ritz over all, so that pairs of different intervals are orthogonal too
    q, _ = np.linalg.qr(np.concatenate([v for _, v in found], axis=1))
    values, inner = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(values)[::-1][:k]
    if len(values) != inertia.above(cut[-1][0]):
        raise ArithmeticError("eigenpairs are missing")
    vectors = (q @ inner)[:, order]
    largest_entry = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
    return values[order], vectors * np.sign(largest_entry)
