"""Constants of the robust estimators, and the outlier rule for values held in one task."""

from __future__ import annotations

import numpy as np

# MAD to standard deviation of a normal distribution (exact and rounded forms),
# mean absolute deviation to standard deviation, and the trimming compensation polynomial.
MAD_SCALE = 0.6744897501960817
MAD_SCALE_ROUNDED = 0.67449
MEAN_DEVIATION_SCALE = 1.253
TRIM_POLYNOMIAL = (-0.15405, 0.90723, -0.23584, 0.020142)
TRIM_LIMIT = 4.5


def trim_compensation(cut: float) -> float:
    """Factor by which trimming at ``cut`` deviations shrinks the measured deviation."""
    limit = max(float(cut), 1.0)
    if limit > TRIM_LIMIT:
        return 1.0
    return sum(c * limit**i for i, c in enumerate(TRIM_POLYNOMIAL))


def _median(values: np.ndarray) -> float:
    ordered = np.sort(values)
    middle = ordered.size // 2
    return ordered[middle] if ordered.size % 2 else (ordered[middle - 1] + ordered[middle]) / 2


def inliers(residual: np.ndarray, cut: float) -> np.ndarray:
    """Mask of the residuals within ``cut`` robust deviations; missing values are outliers."""
    finite = np.isfinite(residual)
    known = residual if finite.all() else residual[finite]
    if not known.size:
        return finite
    centre = _median(known)
    deviation = np.abs(residual - centre)
    spreads = deviation if known is residual else deviation[finite]
    sigma = _median(spreads) / MAD_SCALE_ROUNDED
    if abs(sigma) <= 1e-8:
        sigma = MEAN_DEVIATION_SCALE * spreads.sum() / spreads.size
    for _ in range(2):
        mask = deviation <= cut * sigma
        kept = residual[mask]
        if not kept.size:
            break
        spread = kept - kept.sum() / kept.size
        sigma = (spread @ spread / kept.size) ** 0.5 / trim_compensation(cut)
    return mask
