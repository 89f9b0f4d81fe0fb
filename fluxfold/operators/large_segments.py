"""Spline fits of segments too long for one task.

A least-squares spline needs, per knot cell, only the power sums of the points in it. Executors
add them up with map-side combining; per fit, the cells stream sorted into a banded solution whose
memory is linear in the knots. Outlier rounds use the exact grouped medians.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.functions.robust import (
    MAD_SCALE_ROUNDED,
    MEAN_DEVIATION_SCALE,
    trim_compensation,
)
from fluxfold.functions.spline import basis, piecewise_value, solve_cells, to_pieces
from fluxfold.operators.quantiles import group_medians
from fluxfold.operators.segments import SEGMENT
from fluxfold.operators.skew import maybe_broadcast
from fluxfold.session import materialize

FIT = [*SEGMENT, "spacing_id"]
_FRAME = ["spacing", "first_knot", "n_knots"]


def enough_points(counts: np.ndarray, k: int) -> bool:
    """Schoenberg-Whitney from point counts per cell: basis ``j`` lives on cells ``j-k..j``."""
    # Points that no cell before j-k holds must be there for the first j+1 functions, and none may
    # need a point beyond its last cell: greedy choice, one pass over the cells.
    cell, used = 0, 0
    counts = counts.tolist()
    for j in range(len(counts) + k):
        if cell < j - k:
            cell, used = j - k, 0
        while cell < len(counts) and used >= counts[cell]:
            cell, used = cell + 1, 0
        if cell >= len(counts) or cell > j:
            return False
        used += 1
    return True


def solve_moments(
    counts: np.ndarray, sums: np.ndarray, products: np.ndarray, knots: np.ndarray,
    low: float, high: float, spacing: float, k: int,
) -> np.ndarray | None:
    """Spline pieces from power sums in ``(x - left) / spacing``; None for unusable knots."""
    if low >= high or (knots.size and not (low < knots[0] and knots[-1] < high)):
        return None
    if not enough_points(counts, k):
        return None
    t = np.concatenate([[low] * (k + 1), knots, [high] * (k + 1)])
    left = np.concatenate([[low], knots])
    span = np.concatenate([knots, [high]]) - left
    nodes = np.linspace(0.0, 1.0, k + 1)
    cell = np.repeat(np.arange(left.size) + k, k + 1)
    values = basis((left[:, None] + span[:, None] * nodes).ravel(), t, cell, k)
    # powers[cell, a, p]: basis function a of a cell as a polynomial in the scaled distance.
    powers = np.linalg.solve(
        np.vander(nodes, increasing=True), values.reshape(k + 1, -1, k + 1).transpose(1, 2, 0)
    ).transpose(0, 2, 1)
    powers = powers * ((spacing / span)[:, None, None] ** np.arange(k + 1))
    moments = np.stack([sums[:, p : p + k + 1] for p in range(k + 1)], axis=1)
    gram = np.einsum("cap,cpq,cbq->cab", powers, moments, powers)
    rhs = np.einsum("cap,cp->ca", powers, products)
    return to_pieces(solve_cells(gram, rhs, k), knots, low, high, k)


def _solver(k: int):
    """Solve the fits of a task from their cells, which come sorted by fit and cell."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, row, parts = None, None, []

        def solved() -> pd.DataFrame:
            # A knot cell costs 2k+2 numbers; the solution is as long.
            size = int(row.n_knots) + 1
            counts, sums, products = np.zeros(size), np.zeros((size, 2 * k + 1)), np.zeros((size, k + 1))
            for cell, found, by_value in parts:
                counts[cell], sums[cell], products[cell] = found[:, 0], found, by_value
            knots = row.first_knot + row.spacing * np.arange(int(row.n_knots))
            pieces = solve_moments(counts, sums, products, knots, row.low, row.high, row.spacing, k)
            return pd.DataFrame(
                {**{c: [getattr(row, c)] for c in FIT}, "pieces": [None if pieces is None else pieces.ravel()]}
            )

        for batch in batches:
            if batch.empty:
                continue
            keys = batch[FIT].to_numpy()
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = [0, *starts.tolist(), len(keys)]
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                here = tuple(keys[begin].tolist())
                if now is not None and here != now:
                    yield solved()
                    parts = []
                own = batch.iloc[begin:end]
                now, row = here, next(own.itertuples())
                parts.append((own["cell"].to_numpy(), np.stack(own["sums"]), np.stack(own["products"])))
        if now is not None:
            yield solved()

    return solve


def _value(pieces: str, low: str, k: int) -> Column:
    return piecewise_value(
        F.col("time"), F.col(pieces), F.col(low), F.col("first_knot"), F.col("spacing"),
        F.col("n_knots"), k,
    )


def _kept(prefix: str, k: int) -> Column:
    """Whether a row is in the mask given by the pieces, centre and limit named by ``prefix``."""
    residual = F.col("_y") - _value(f"{prefix}_pieces", f"{prefix}_low", k)
    near = F.abs(residual - F.col(f"{prefix}_centre")) <= F.col(f"{prefix}_limit")
    return F.col("_y").isNotNull() & F.coalesce(
        F.when(F.col(f"{prefix}_set"), near).otherwise(F.lit(True)), F.lit(False)
    )


def _with_fits(base: DataFrame, fits: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the long segments, one copy per fit. There are few long segments, and the join must
    not gather one: rows carry ``_salt`` and a fit has a copy for each of the ``_salts`` of its
    segment. Spark broadcasts the fits instead if their measured size allows it."""
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt")
    side = fits.select(*FIT, *_FRAME, *columns, salt)
    return base.join(side, [*SEGMENT, "_salt"]).drop("_salt")


def _with_numbers(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (FIT, ...) with one row of ``numbers`` per fit: three numbers a fit, counted."""
    return rows.join(maybe_broadcast(numbers, numbers.count()), FIT)


def _no_mask(fits: DataFrame, prefix: str) -> DataFrame:
    return (
        fits.withColumn(f"{prefix}_pieces", F.lit(None).cast("array<double>"))
        .withColumn(f"{prefix}_low", F.lit(None).cast("double"))
        .withColumn(f"{prefix}_centre", F.lit(None).cast("double"))
        .withColumn(f"{prefix}_limit", F.lit(None).cast("double"))
        .withColumn(f"{prefix}_set", F.lit(False))
    )


_MASK = ["pieces", "low", "centre", "limit", "set"]


def _outlier_limits(
    base: DataFrame, fits: DataFrame, k: int, cut: float, hot_rows: int
) -> DataFrame:
    """Per fit: centre and limit of the next mask from the residuals of ``pieces``."""
    rows = _with_fits(base, fits, ["pieces", "low"]).select(
        *FIT, (F.col("_y") - _value("pieces", "low", k)).alias("_res")
    )
    rows = rows.where(F.col("_res").isNotNull())
    centre = materialize(group_medians(rows, FIT, {"_centre": "_res"}, hot_rows=hot_rows), "centre")
    rows = _with_numbers(rows, centre).withColumn("_dev", F.abs(F.col("_res") - F.col("_centre")))
    mad = group_medians(
        rows, FIT, {"_mad": "_dev"}, extra={"_mean": F.avg("_dev")}, hot_rows=hot_rows
    )
    sigma = F.col("_mad") / F.lit(MAD_SCALE_ROUNDED)
    sigma = F.when(F.abs(sigma) <= 1e-8, F.col("_mean") * MEAN_DEVIATION_SCALE).otherwise(sigma)
    first = materialize(mad.select(*FIT, sigma.alias("_sigma")), "sigma")
    inside = F.when(F.col("_dev") <= F.col("_sigma") * F.lit(cut), F.col("_res"))
    # With nothing inside, the first deviation stays: the mask keeps no row.
    trimmed = F.stddev_pop(inside) / F.lit(trim_compensation(cut))
    second = _with_numbers(rows, first).groupBy(*FIT, "_centre", "_sigma").agg(
        (F.coalesce(trimmed, F.col("_sigma")) * F.lit(cut)).alias("_limit")
    ).drop("_sigma")
    return materialize(second, "limits")


def _refit(base: DataFrame, fits: DataFrame, k: int) -> DataFrame:
    """New ``pieces`` and ``low`` of every fit from the rows its mask keeps."""
    mask = [f"mask_{c}" for c in _MASK]
    kept = _with_fits(base, fits, mask).where(_kept("mask", k))
    ends = materialize(
        kept.groupBy(*FIT).agg(
            F.min("time").alias("low"), F.max("time").alias("high"), F.count("*").alias("_n")
        ),
        "ends",
    )
    fits = fits.drop("low", "high", "_n", "pieces").join(ends, FIT, "left")
    rows = _with_fits(base, fits, [*mask, "low"]).where(_kept("mask", k))
    slot = F.floor((F.col("time") - F.col("first_knot")) / F.col("spacing")) + 1
    cell = F.greatest(F.lit(0).cast("long"), F.least(F.col("n_knots").cast("long"), slot))
    left = F.when(F.col("cell") == 0, F.col("low")).otherwise(
        F.col("first_knot") + (F.col("cell") - 1) * F.col("spacing")
    )
    rows = rows.withColumn("cell", cell).withColumn("_u", (F.col("time") - left) / F.col("spacing"))
    power = [F.lit(1.0)]
    for _ in range(2 * k):
        power.append(power[-1] * F.col("_u"))
    cells = rows.groupBy(*FIT, "cell").agg(
        F.array(*[F.sum(p) for p in power]).alias("sums"),
        F.array(*[F.sum(F.col("_y") * p) for p in power[: k + 1]]).alias("products"),
    )
    frames = fits.select(*FIT, *_FRAME, "low", "high")
    schema = "target_id long, quarter int, segment_id long, spacing_id int, pieces array<double>"
    by_fit = cells.join(frames, FIT).repartition(*FIT).sortWithinPartitions(*FIT, "cell")
    solved = by_fit.mapInPandas(_solver(k), schema)
    return materialize(fits.join(solved, FIT, "left"), "refit")


def fit_large_segments(
    rows: DataFrame, large: DataFrame, spec, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Fits of the segments in ``large`` and the rows they reject, like the in-task fit; ``rows``
    has SEGMENT, seq, time and ``_y``, ``large`` has SEGMENT and the row count ``_n``."""
    k, cut = spec.k, float(spec.sigma_cut)
    counted = large.select(*SEGMENT, F.ceil(F.col("_n") / F.lit(hot_rows)).alias("_salts"))
    # At most (all rows / hot_rows) segments, counted.
    side = maybe_broadcast(counted, counted.count())
    salted = rows.join(side, SEGMENT).withColumn("_salt", F.pmod(F.xxhash64("seq", "time"), F.col("_salts")))
    base = materialize(salted.drop("_salts"), "long_segments")
    spacing = F.posexplode(F.array(*[F.lit(float(s)) for s in spec.spacings])).alias(
        "spacing_id", "spacing"
    )
    span = base.groupBy(*SEGMENT).agg(F.min("time").alias("_min"), F.max("time").alias("_max"))
    first = F.col("_min") + F.col("spacing")
    knots = F.greatest(F.lit(0), F.ceil((F.col("_max") - first) / F.col("spacing")).cast("int"))
    fits = span.join(counted, SEGMENT).select(*SEGMENT, "_salts", "_min", "_max", spacing).select(
        *FIT, "_salts", "spacing", first.alias("first_knot"), knots.alias("n_knots")
    )
    fits = materialize(_refit(base, _no_mask(fits, "mask"), k), "fits")
    done: list[DataFrame] = []

    def finish(part: DataFrame) -> None:
        done.append(part.select(*FIT, *_FRAME, "_salts", "low", "pieces", "_n",
                                *[f"mask_{c}" for c in _MASK]))

    for _ in range(spec.max_iter - 1):
        broken = F.col("pieces").isNull()
        finish(fits.where(broken))
        fits = fits.where(~broken)
        if fits.isEmpty():
            break
        limits = _outlier_limits(base, fits, k, cut, hot_rows)
        trial = (
            fits.join(limits, FIT)
            .withColumn("new_pieces", F.col("pieces"))
            .withColumn("new_low", F.col("low"))
            .withColumn("new_set", F.lit(True))
            .withColumnsRenamed({"_centre": "new_centre", "_limit": "new_limit"})
        )
        both = [f"{p}_{c}" for p in ("mask", "new") for c in _MASK]
        changed = materialize(
            _with_fits(base, trial, both)
            .groupBy(*FIT)
            .agg(F.count_if(_kept("mask", k) != _kept("new", k)).alias("_changed")),
            "changed",
        )
        trial = trial.join(changed, FIT)
        finish(trial.where(F.col("_changed") == 0))
        moved = trial.where(F.col("_changed") > 0)
        if moved.isEmpty():
            fits = None
            break
        moved = moved.drop(*[f"mask_{c}" for c in _MASK], "_changed").withColumnsRenamed(
            {f"new_{c}": f"mask_{c}" for c in _MASK}
        )
        fits = _refit(base, moved, k)
    if fits is not None:
        finish(fits)
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    final = materialize(final, "final_fits")
    mask = [f"mask_{c}" for c in _MASK]
    error = F.col("_y") - _value("pieces", "low", k)
    squares = (
        _with_fits(base, final, [*mask, "pieces", "low"])
        .where(_kept("mask", k))
        .groupBy(*FIT)
        .agg(F.sum(error * error).alias("ssr"))
    )
    few = F.coalesce("_n", F.lit(0)) <= k
    status = F.when(few, "insufficient").when(F.col("pieces").isNull(), "bad_knots").otherwise("ok")
    ok = F.col("status") == "ok"
    judged = materialize(final.withColumn("status", status), "judged_fits")
    rejected = _with_fits(base, judged.where(ok), mask).where(~_kept("mask", k)).select(*FIT, "seq")
    fits = judged.join(squares, FIT, "left").select(
        *FIT, "spacing", "status",
        F.when(F.col("status") != "insufficient", F.col("n_knots")).otherwise(0).alias("n_knots"),
        F.when(ok, F.col("low")).alias("low"), "first_knot",
        F.when(ok, F.col("_n")).otherwise(0).alias("n_points"),
        F.when(ok, F.col("ssr")).otherwise(0.0).alias("ssr"),
        F.when(ok, F.col("pieces")).alias("pieces"),
    )
    return fits, rejected
