"""Fits of many short segments at once against the fit of each."""

import numpy as np
import pytest

from fluxfold.functions.batched import fit_segments, row_inliers, row_medians
from fluxfold.functions.robust import inliers
from fluxfold.functions.spline import fit_segment


def curves(seed, count):
    """Short noisy segments with gaps, missing values, outliers and repeated times."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count):
        n = int(rng.integers(1, 60))
        x = np.sort(rng.uniform(0, rng.choice([0.3, 3.0, 12.0]), n))
        if i % 7 == 0:
            x[: n // 2] = x[0]
        y = 40 + 3 * np.sin(x) + rng.normal(0, 0.3, n)
        if i % 3 == 0:
            y[rng.random(n) < 0.1] += 25
        if i % 5 == 0:
            y[rng.random(n) < 0.3] = np.nan
        out.append((x, y))
    return out


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("spacing", [0.2, 1.1, 4.0, 20.0])
def test_together_equals_one_by_one(k, spacing):
    data = curves(k, 300)
    together = fit_segments(data, spacing, k, 5, 3.0)
    statuses = set()
    for (x, y), got in zip(data, together, strict=True):
        want = fit_segment(x, y, spacing, k, 5, 3.0)
        statuses.add(want.status)
        # With no freedom left the residuals are rounding noise, and so is what they reject.
        if np.count_nonzero(np.isfinite(y)) <= 2 * (want.n_knots + k + 1):
            continue
        assert (got.status, got.n_knots) == (want.status, want.n_knots)
        if want.status == "ok":
            assert got.rejected.tolist() == want.rejected.tolist()
            assert (got.n_points, got.low) == (want.n_points, want.low)
            assert np.isclose(got.ssr, want.ssr, rtol=1e-6)
            assert got.pieces.shape == want.pieces.shape
            at = np.delete(x, want.rejected)
            # Close points give large coefficients, and these the rounding of the values.
            atol = 1e-6 + np.finfo(float).eps * np.abs(want.pieces).max()
            assert np.allclose(value(at, got, x, spacing), value(at, want, x, spacing), atol=atol)
    assert "ok" in statuses and len(statuses) >= 2


def value(at, fit, x, spacing):
    first = x[0] + spacing
    cell = np.clip(np.floor((at - first) / spacing).astype(int) + 1, 0, fit.n_knots)
    left = np.where(cell == 0, fit.low, first + (cell - 1) * spacing)
    return sum(fit.pieces[cell, p] * (at - left) ** p for p in range(fit.pieces.shape[1]))


def test_status_without_freedom():
    x = np.arange(6.0)
    data = [(x[:1], x[:1]), (x, x * np.nan), (x, x), (x[[0, 0, 0, 0, 0, 0]], x), (x, x**2)]
    for spacing in (0.1, 2.0, 9.0):
        got = [f.status for f in fit_segments(data, spacing, 3, 1, 3.0)]
        assert got == [fit_segment(a, b, spacing, 3, 1, 3.0).status for a, b in data]
    assert fit_segments([], 1.0, 3, 5, 3.0) == []


def test_rows_of_robust_statistics():
    rng = np.random.default_rng(4)
    values = rng.standard_t(2, (200, 31))
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:3] = np.nan
    values[3:6] = 1.5
    known = np.isfinite(values)
    with np.errstate(all="ignore"):
        want = [np.median(v[m]) if m.any() else np.nan for v, m in zip(values, known, strict=True)]
    assert np.allclose(row_medians(values, known), want, equal_nan=True)
    masks = row_inliers(values, 3.0)
    for v, mask in zip(values, masks, strict=True):
        assert mask.tolist() == inliers(v, 3.0).tolist()
