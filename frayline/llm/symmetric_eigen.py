"""Leading eigenpairs of a symmetric matrix: tridiagonalise, count, bisect, iterate.

Householder reflections bring the matrix to tridiagonal form, Sturm counts bracket the leading eigenvalues, inverse
iteration finds their vectors, which are made orthogonal inside clusters of close eigenvalues, and the reflections are
applied backwards.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are one cluster
STEPS = 5  # of inverse iteration; two converge, the others make clusters clean


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections with the row each begins at."""
    a = np.array(matrix, dtype=np.float64)
    d, mirrors = len(a), []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x[1:]).max()
        if size == 0:
            continue
        x /= max(size, abs(x[0]))
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        v = x / np.sqrt(x @ x)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        mirrors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the shifted factorisation."""
    least = max(float((off**2).max(initial=0.0)), 1.0) * np.finfo(np.float64).tiny
    pivot = diagonal[0] - at
    below = np.zeros(len(at), dtype=np.int64)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket no longer shrinks."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = 2 * EPS * d * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    low, high = np.full(k, low - slack), np.full(k, high + slack)
    rank = d - np.arange(k)  # so many eigenvalues lie at or below the wanted one
    close = EPS / 64 * max(abs(float(low[0])), abs(float(high[0])))
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > close)).any():
            return middle
        under = count_below(diagonal, off, middle) < rank
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _factored(diagonal: np.ndarray, off: np.ndarray, at: float, least: float) -> list[tuple]:
    """Rows of the pivoted upper factor of T - at, with the swaps and multipliers that led there."""
    n, rows = len(diagonal), []
    a, b, c = diagonal[0] - at, (off[0] if n > 1 else 0.0), 0.0  # the row being reduced
    for i in range(n - 1):
        below, mid, after = off[i], diagonal[i + 1] - at, (off[i + 1] if i + 2 < n else 0.0)
        swap = abs(below) > abs(a)
        if swap:
            (a, b, c), (below, mid, after) = (below, mid, after), (a, b, c)
        a = a if abs(a) > least else least
        m = below / a
        rows.append((a, b, c, m, swap))
        a, b, c = mid - m * b, after - m * c, 0.0
    rows.append((a if abs(a) > least else least, 0.0, 0.0, 0.0, False))
    return rows


def _solved(rows: list[tuple], right: np.ndarray) -> np.ndarray:
    y = right.tolist()
    n = len(y)
    for i in range(n - 1):
        _, _, _, m, swap = rows[i]
        if swap:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= m * y[i]
    for i in range(n - 1, -1, -1):
        a, b, c, _, _ = rows[i]
        y[i] = (y[i] - (b * y[i + 1] if i + 1 < n else 0.0) - (c * y[i + 2] if i + 2 < n else 0.0)) / a
    return np.array(y)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one row for each of the falling ``values``."""
    d = len(diagonal)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))).max()) or 1.0
    rng = np.random.default_rng(0)
    found, begin, used = np.empty((len(values), d)), 0, 0.0
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            begin = j
        # equal values are set apart by a few units of rounding, or their solutions would agree
        at = min(value, used - 10 * EPS * norm) if j > begin else value
        used = at
        rows = _factored(diagonal, off, at, EPS * norm)
        y = rng.uniform(-1, 1, d)
        for _ in range(STEPS):
            y = _solved(rows, y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):
                y -= found[begin:j].T @ (found[begin:j] @ y)
            y /= np.sqrt(y @ y)
        found[j] = y
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as rows; the largest entry of a vector is positive."""
    k = min(k, len(matrix))
    if not k:
        return np.empty(0), np.empty((0, len(matrix)))
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    found = vectors_of(diagonal, off, values)
    for at, v in reversed(mirrors):
        found[:, at:] -= 2 * np.outer(found[:, at:] @ v, v)
    found /= np.sqrt((found**2).sum(axis=1, keepdims=True))
    signs = np.sign(found[np.arange(k), np.abs(found).argmax(axis=1)])
    return values, found * signs[:, None]
