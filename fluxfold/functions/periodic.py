"""Column expressions of periodic events: folding, widths, view bounds and bin widths.

All functions map Columns to Columns, so Catalyst inlines them into whole-stage codegen.
A user-supplied width, bounds or bin-width rule is any callable with the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrNumber = Column | float | int
Bounds = Callable[[Column, Column], tuple[Column, Column]]
BinWidth = Callable[[Column, Column], Column]
EventWidth = Callable[[Column, Column, Column], Column]


def _col(value: ColumnOrNumber) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def phase_fold(time: Column, epoch: ColumnOrNumber, period: ColumnOrNumber) -> Column:
    """Time relative to the nearest event, in ``[-period/2, period/2]``.

    A literal period must be positive; a row whose period is not positive folds to NULL.
    """
    if not isinstance(period, Column) and period <= 0:
        raise ValueError(f"period must be > 0, got {period}")
    epoch, period = _col(epoch), _col(period)
    half = period / F.lit(2.0)
    return F.when(period > 0, F.pmod(time + (half - epoch), period) - half)


def centroid_distance(x: Column, y: Column) -> Column:
    """Euclidean length of the centroid vector."""
    return F.sqrt(x * x + y * y)


def width_fixed_durations(factor: float = 3.0) -> EventWidth:
    """Event width of a fixed number of durations."""
    return lambda period, duration, secondary: duration * F.lit(float(factor))


def width_adjusted(period: Column, duration: Column, secondary: Column) -> Column:
    """Event width that touches neither the secondary event nor the next period.

    ``least`` skips NULL, so an event without a secondary phase is limited by the others.
    """
    return F.least(duration * F.lit(3.0), F.abs(secondary), period)


def width_secondary(period: Column, duration: Column, secondary: Column) -> Column:
    """Event width that leaves the secondary event visible."""
    distance = F.abs(secondary)
    return F.when(duration < distance, duration * F.lit(3.0)).otherwise(distance + duration)


def local_bounds(num_durations: float = 2.5) -> Bounds:
    """A window of ``num_durations`` durations around the event, inside one period."""
    if num_durations <= 0:
        raise ValueError(f"num_durations must be > 0, got {num_durations}")

    def bounds(period: Column, duration: Column) -> tuple[Column, Column]:
        half, reach = period / F.lit(2.0), duration * F.lit(float(num_durations))
        return F.greatest(-half, -reach), F.least(half, reach)

    return bounds


def global_bounds(period: Column, duration: Column) -> tuple[Column, Column]:
    """The whole folded period."""
    half = period / F.lit(2.0)
    return -half, half


def local_bin_width(factor: float = 0.16) -> BinWidth:
    """A fixed share of the duration."""
    if factor <= 0:
        raise ValueError(f"factor must be > 0, got {factor}")
    return lambda period, duration: duration * F.lit(float(factor))


def global_bin_width(num_bins: int = 301, factor: float = 0.16) -> BinWidth:
    """The uniform share of the period, but never less than a share of the duration."""
    if num_bins < 2:
        raise ValueError(f"num_bins must be >= 2, got {num_bins}")
    if factor <= 0:
        raise ValueError(f"factor must be > 0, got {factor}")
    return lambda period, duration: F.greatest(
        period / F.lit(float(num_bins)), duration * F.lit(float(factor))
    )


def is_even_period(time: Column, epoch: Column, period: Column) -> Column:
    """Whether ``time`` lies in an even orbital period (the one around ``epoch`` is odd)."""
    index = F.floor((time - (epoch + period / F.lit(2.0))) / period) + F.lit(1)
    return F.greatest(F.lit(0).cast("long"), index) % F.lit(2) == F.lit(1)


def bic(
    params: ColumnOrNumber,
    points: ColumnOrNumber,
    sigma: ColumnOrNumber,
    ssr: ColumnOrNumber,
    penalty: float = 1.0,
) -> Column:
    """Bayesian information criterion of a fit with Gaussian errors.

    Literal arguments out of range are an error; rows out of range give NULL.
    """
    lower = {"params": (params, 0), "sigma": (sigma, 0), "ssr": (ssr, 0), "points": (points, 1)}
    for name, (value, limit) in lower.items():
        if not isinstance(value, Column) and value < limit:
            raise ValueError(f"{name} must be >= {limit}, got {value}")
    k, n, sd, squares = map(_col, (params, points, sigma, ssr))
    variance = (sd + F.lit(1e-6)) * (sd + F.lit(1e-6))
    score = (
        n * F.log(F.lit(6.283185307179586) * variance)
        + squares / variance
        + F.lit(float(penalty)) * (k * F.log(n))
    )
    return F.when((n > 0) & (k >= 0) & (sd >= 0) & (squares >= 0), score)
