"""Least-squares spline pieces: small numpy helpers used inside tasks, and their evaluation as a
Column expression.

A fitted spline is stored as polynomial pieces, so executors evaluate it in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxfold.functions.robust import inliers


class BadKnotsError(ValueError):
    """The knots do not determine a spline over the given points."""


def interior_knots(low: float, high: float, spacing: float) -> np.ndarray:
    return np.arange(low + spacing, high, spacing)


def basis(x: np.ndarray, t: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """The ``k + 1`` basis functions that are non-zero on knot cell ``cell`` of each ``x``."""
    out = np.zeros((k + 1, x.size))
    out[0] = 1.0
    for degree in range(1, k + 1):
        carry = np.zeros(x.size)
        for r in range(degree):
            right = t[cell + r + 1]
            left = t[cell + r + 1 - degree]
            share = out[r] / (right - left)
            out[r] = carry + (right - x) * share
            carry = (x - left) * share
        out[degree] = carry
    return out


@lru_cache
def bernstein_powers(k: int) -> np.ndarray:
    """Row ``a``: Bernstein polynomial ``a`` of degree ``k`` in powers of its argument."""
    out = np.zeros((k + 1, k + 1))
    for a in range(k + 1):
        for j in range(k - a + 1):
            out[a, a + j] = comb(k, a) * comb(k - a, j) * (-1) ** j
    return out


def bernstein(u: np.ndarray, k: int) -> np.ndarray:
    """The basis of a spline without interior knots, for ``u`` in units of its span."""
    rest, ups, downs = 1.0 - u, [np.ones(u.size)], [np.ones(u.size)]
    for _ in range(k):
        ups.append(ups[-1] * u)
        downs.append(downs[-1] * rest)
    return np.array([comb(k, a) * ups[a] * downs[k - a] for a in range(k + 1)])


def determines(x: np.ndarray, t: np.ndarray, k: int) -> bool:
    """Schoenberg-Whitney: every basis function gets a data point of its own."""
    n = t.size - k - 1
    if x.size < n:
        return False
    if n == k + 1 and x[0] < x[1] and x[-2] < x[-1]:
        return True  # One cell: every point supports every basis function.
    inner = np.arange(1, n - 1)
    after_left = np.searchsorted(x, t[inner], side="right")
    # Greedy choice of the first unused point, in closed form.
    pick = inner + np.maximum.accumulate(np.maximum(after_left - inner, 0))
    if pick.size and pick[-1] > x.size - 2:
        return False
    return bool(np.all(x[pick] < t[inner + k + 1]))


def solve_normal(full: np.ndarray, vector: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(full, vector)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(full, vector, rcond=None)[0]


#: A pivot below this share of its diagonal element is rounding noise.
PIVOT = 1e-13


def solve_banded(band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of symmetric positive systems from their upper bands.

    ``band[..., d, i]`` is element (i, i + d) and ``rhs`` has shape (..., n); leading axes are
    independent systems, eliminated side by side. A root-free Cholesky elimination touches each
    band element once, so time and memory are linear in n. A direction the points do not fix (a
    pivot of rounding noise) gets the coefficient 0.
    """
    band, x = band.astype(float), rhs.astype(float)
    width, n = band.shape[-2:]
    diagonal = band[..., 0, :].copy()
    for i in range(n):
        pivot = band[..., 0, i]
        free = pivot <= PIVOT * diagonal[..., i]
        pivot = np.where(free, np.inf, pivot)
        # Row i of the factor, kept in place of the band.
        row = band[..., 1:, i] / pivot[..., None]
        for d in range(1, min(width, n - i)):
            band[..., : width - d, i + d] -= row[..., d - 1, None] * band[..., d:, i]
            x[..., i + d] -= row[..., d - 1] * x[..., i]
        band[..., 1:, i] = row
        x[..., i] /= pivot
    for i in range(n - 2, -1, -1):
        reach = min(width - 1, n - 1 - i)
        x[..., i] -= (band[..., 1 : reach + 1, i] * x[..., i + 1 : i + 1 + reach]).sum(axis=-1)
    return x


def solve_cells(gram: np.ndarray, rhs: np.ndarray, k: int) -> np.ndarray:
    """Spline coefficients from per-cell sums of basis products.

    ``gram`` has shape (cells, k+1, k+1) and ``rhs`` (cells, k+1). A basis function meets its k
    neighbours only, so the normal equations are k+1 bands.
    """
    cells = rhs.shape[0]
    band = np.zeros((k + 1, cells + k))
    vector = np.zeros(cells + k)
    for a in range(k + 1):
        vector[a : a + cells] += rhs[:, a]
        for b in range(a, k + 1):
            band[b - a, a : a + cells] += gram[:, a, b]
    return solve_banded(band, vector)


def to_pieces(coef: np.ndarray, knots: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
    """Power-basis coefficients, ``k + 1`` per cell, in the distance from the cell's left end."""
    if not knots.size:
        return (coef @ bernstein_powers(k) / (high - low) ** np.arange(k + 1))[None, :]
    t = np.concatenate([[low] * (k + 1), knots, [high] * (k + 1)])
    left = np.concatenate([[low], knots])
    span = np.concatenate([knots, [high]]) - left
    nodes = np.linspace(0.0, 1.0, k + 1)
    cell = np.repeat(np.arange(left.size) + k, k + 1)
    x = (left[:, None] + span[:, None] * nodes).ravel()
    weights = basis(x, t, cell, k)
    values = sum(weights[a] * coef[cell - k + a] for a in range(k + 1)).reshape(-1, k + 1)
    powers = np.linalg.solve(np.vander(nodes, increasing=True), values.T).T
    return powers / span[:, None] ** np.arange(k + 1)


class Frame:
    """Basis values of all points of a segment for one knot vector."""

    # Below this size one dense matrix beats the sums per cell.
    dense_size = 20_000

    def __init__(self, x: np.ndarray, knots: np.ndarray, low: float, high: float, k: int) -> None:
        if low >= high or (knots.size and not (low < knots[0] and knots[-1] < high)):
            raise BadKnotsError("knots outside the data")
        self.x, self.knots, self.low, self.high, self.k = x, knots, low, high, k
        self.t = np.concatenate([[low] * (k + 1), knots, [high] * (k + 1)])
        self.cells = knots.size + 1
        self.weights = None
        self.matrix = None

    def _build(self) -> None:
        # Only once the knots have proved usable.
        x, k = self.x, self.k
        if self.knots.size:
            self.cell = self.knots.searchsorted(x, side="right")
            self.weights = basis(x, self.t, self.cell + k, k)
        else:
            self.cell = np.zeros(x.size, int)
            self.weights = bernstein((x - self.low) / (self.high - self.low), k)
        if self.cells == 1:
            self.matrix = self.weights.T
        elif x.size * (self.cells + k) <= self.dense_size:
            self.matrix = np.zeros((x.size, self.cells + k))
            at = np.arange(x.size)
            for a in range(k + 1):
                self.matrix[at, self.cell + a] = self.weights[a]

    def coefficients(self, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if self.weights is None:
            self._build()
        if self.matrix is not None:
            rows = self.matrix[mask]
            return solve_normal(rows.T @ rows, rows.T @ y[mask])
        k, cell, weights, values = self.k, self.cell[mask], self.weights[:, mask], y[mask]
        gram = np.empty((self.cells, k + 1, k + 1))
        rhs = np.empty((self.cells, k + 1))
        for a in range(k + 1):
            rhs[:, a] = np.bincount(cell, weights[a] * values, self.cells)
            for b in range(a, k + 1):
                products = np.bincount(cell, weights[a] * weights[b], self.cells)
                gram[:, a, b] = gram[:, b, a] = products
        return solve_cells(gram, rhs, k)

    def values(self, coef: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix @ coef
        return sum(w * coef[self.cell + a] for a, w in enumerate(self.weights))


@dataclass
class SegmentFit:
    status: str
    n_knots: int = 0
    low: float = float("nan")
    n_points: int = 0
    ssr: float = 0.0
    pieces: np.ndarray | None = None
    rejected: np.ndarray | None = None


def fit_segment(
    x: np.ndarray, y: np.ndarray, spacing: float, k: int, max_iter: int, cut: float
) -> SegmentFit:
    """Fit one segment, re-fitting without outliers until the mask settles."""
    finite = np.isfinite(y)
    if x.size <= k or np.count_nonzero(finite) <= k:
        return SegmentFit("insufficient")
    knots = interior_knots(x[0], x[-1], spacing)
    mask, frame, coef = finite, None, None
    for _ in range(max_iter):
        if coef is not None:
            new = inliers(y - frame.values(coef), cut)
            if np.array_equal(new, mask):
                break
            mask = new
        used = x[mask]
        if used.size <= k:
            return SegmentFit("insufficient")
        try:
            if frame is None or (used[0], used[-1]) != (frame.low, frame.high):
                frame = Frame(x, knots, used[0], used[-1], k)
            if not determines(used, frame.t, k):
                raise BadKnotsError("too few points between knots")
        except BadKnotsError:
            return SegmentFit("bad_knots", knots.size)
        coef = frame.coefficients(y, mask)
    residual = (y - frame.values(coef))[mask]
    return SegmentFit(
        "ok", knots.size, frame.low, residual.size, float(residual @ residual),
        to_pieces(coef, knots, frame.low, frame.high, k), np.flatnonzero(~mask),
    )


def piecewise_value(
    x: Column, pieces: Column, low: Column, first_knot: Column, spacing: Column, n_knots: Column,
    k: int,
) -> Column:
    """Value at ``x`` of a stored spline (cells of equal ``spacing`` from ``first_knot`` on)."""
    cell = piece_cell(x, first_knot, spacing, n_knots)
    return cell_value(cell, cell_distance(x, cell, low, first_knot, spacing), pieces, k)


def piece_cell(x: Column, first_knot: Column, spacing: Column, n_knots: Column) -> Column:
    slot = F.floor((x - first_knot) / spacing) + 1
    return F.greatest(F.lit(0).cast("long"), F.least(n_knots.cast("long"), slot))


def cell_distance(
    x: Column, cell: Column, low: Column, first_knot: Column, spacing: Column
) -> Column:
    return x - F.when(cell == 0, low).otherwise(first_knot + (cell - 1) * spacing)


def cell_value(cell: Column, distance: Column, pieces: Column, k: int) -> Column:
    start = (cell * (k + 1)).cast("int")
    out = F.get(pieces, start + k)
    for power in range(k - 1, -1, -1):
        out = out * distance + F.get(pieces, start + power)
    return out
