"""Largest eigenvalues of a symmetric matrix by FEAST: contour integration per interval.

The matrix is that of one embedding width (d x d); it doesn't grow with the rows. The spectrum is
sliced by inertia counts (signs of the pivots of a symmetric factorisation of A - s I). Per slice,
a quadrature over a circle of complex shifts s_j, each a solve with A - s_j I, projects a random
block onto the slice's eigenvectors; Rayleigh-Ritz on the projected block gives eigenpairs, and the
step is repeated until their residuals are at rounding level. Their number must equal the inertia
count of the slice, else the block grows and the slice is done again.
"""

from __future__ import annotations

import numpy as np

#: Gauss-Legendre nodes on the upper half circle.
NODES = 8
#: A slice holds at most this many eigenvalues, unless they are equal up to rounding.
SLICE = 8
STEPS = 40


def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, by Sylvester's law of inertia: the signs of the
    1x1 and 2x2 pivots of a symmetric factorisation with complete diagonal pivoting."""
    a = a.copy()
    count = 0
    while len(a):
        off = np.abs(a)
        diagonal = off.diagonal().copy()
        np.fill_diagonal(off, 0.0)
        p = int(diagonal.argmax())
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[p], off[i, j]) == 0.0:
            return count
        if diagonal[p] >= 0.64 * off[i, j]:  # the growth bound of complete pivoting: (1 + sqrt 17) / 8
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            count += a[p, p] < 0
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:  # a 2x2 pivot with a large off-diagonal entry: one eigenvalue of each sign
            rest = np.delete(np.arange(len(a)), [i, j])
            pair = a[np.ix_([i, j], [i, j])]
            columns = a[np.ix_(rest, [i, j])]
            count += 1
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(pair, columns.T)
        a = (a + a.T) / 2
    return count


def count_below(a: np.ndarray, s: float) -> int:
    return negative_pivots(a - s * np.eye(len(a)))


def zero_level(d: int, scale: float) -> float:
    """Eigenvalues up to here can't be told from zero."""
    return 4 * d * np.finfo(float).eps * scale


def slices(a: np.ndarray, most: int, scale: float) -> list[tuple[float, float, int]]:
    """Intervals (lo, hi, eigenvalues inside) from above that hold the ``most`` largest eigenvalues."""
    d = len(a)
    # The Gershgorin bound, and one split after the other by inertia.
    top = float((a.diagonal() + np.abs(a - np.diag(a.diagonal())).sum(axis=1)).max()) + 1e-3 * scale
    low = zero_level(d, scale)
    open_, found, have = [(low, count_below(a, low), top, d)], [], 0
    while open_ and have < most:
        lo, below_lo, hi, below_hi = open_.pop()
        n = below_hi - below_lo
        if n == 0:
            continue
        if n <= SLICE and have + n <= most + SLICE or hi - lo <= 1e-13 * scale:
            found.append((lo, hi, n))
            have += n
            continue
        # Of some places near the middle, the one whose neighbourhood holds the fewest eigenvalues.
        at = [lo + (hi - lo) * f for f in (0.46, 0.48, 0.5, 0.52, 0.54)]
        below = [count_below(a, s) for s in at]
        gap = min(range(4), key=lambda i: (below[i + 1] - below[i], abs(i - 1.5)))
        mid = (at[gap] + at[gap + 1]) / 2
        here = count_below(a, mid)
        open_ += [(lo, below_lo, mid, here), (mid, here, hi, below_hi)]
    return found


def project(a: np.ndarray, lo: float, hi: float, y: np.ndarray) -> np.ndarray:
    """The contour integral of (z I - A)^-1 Y around [lo, hi], by quadrature on the upper half
    circle (the lower half is its conjugate)."""
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    total = np.zeros_like(y)
    for t, w in zip(nodes, weights):
        turn = np.exp(1j * np.pi * (t + 1) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, y.astype(complex))
        total += w / 2 * (radius * turn * solved).real
    return total


def rayleigh_ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(block)
    small = q.T @ a @ q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values, q @ vectors


def eigenpairs_in(a: np.ndarray, lo: float, hi: float, n: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenpairs of ``a`` in (lo, hi); ``n`` is the interval's inertia count."""
    d = len(a)
    size = min(d, n + max(4, n // 2))
    tiny = zero_level(d, scale)
    while True:
        y = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(STEPS):
            values, vectors = rayleigh_ritz(a, project(a, lo, hi, y))
            off = np.linalg.norm(a @ vectors - vectors * values, axis=0)
            fine = off <= 1e-6 * (hi - lo) + tiny
            inside = fine & (values > lo - tiny / 4) & (values < hi + tiny / 4)
            sure = fine & (values > lo + tiny) & (values < hi - tiny)
            complete = sure.sum() <= n <= inside.sum() or inside.sum() == n
            # A value at a bound, up to rounding, belongs to the side that the inertia count says.
            mine = np.argsort(-np.where(inside, np.minimum(values - lo, hi - values), -np.inf), kind="stable")[:n]
            if complete and off[mine].max() <= 1e-15 * d * scale:
                return values[mine], vectors[:, mine]
            y = vectors
        if complete:  # as near as the rounding of this matrix allows
            return values[mine], vectors[:, mine]
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} of {n} eigenpairs found in [{lo}, {hi}]")
        size = min(d, 2 * size)


def largest(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of a positive semidefinite ``a``, falling, and their unit
    eigenvectors as columns. Eigenvalues that are zero up to rounding are left out.

    A closing Rayleigh-Ritz step over all slices makes vectors of neighbouring slices orthogonal.
    Each vector's largest entry (the first, of equal ones) is positive.
    """
    a = (a + a.T) / 2
    scale = float(np.abs(a).sum(axis=1).max()) if a.size else 0.0
    if scale == 0.0 or most < 1:
        return np.zeros(0), np.zeros((len(a), 0))
    blocks = [eigenpairs_in(a, lo, hi, n, scale)[1] for lo, hi, n in slices(a, min(most, len(a)), scale)]
    values, vectors = rayleigh_ritz(a, np.concatenate(blocks, axis=1))
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > zero_level(len(a), scale)]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * sign
