"""Normalisation of series, views and scalar columns, and robust statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.functions.robust import (
    MAD_SCALE,
    MAD_SCALE_ROUNDED,
    MEAN_DEVIATION_SCALE,
    trim_compensation,
)
from fluxfold.operators.quantiles import group_medians
from fluxfold.operators.skew import HotKeys, join_per_key

EVENT_KEY = ["target_id", "tce_id"]

def normalize_by_median(
    df: DataFrame, keys: list[str], value: str, out: str = "normalized",
    hot: HotKeys | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """``value`` divided by the median of its group."""
    medians = group_medians(
        df, keys, {"_median": value}, hot_rows=hot_rows, may_be_hot=hot is not None
    )
    joined = join_per_key(df, medians, keys, hot)
    return joined.withColumn(out, F.try_divide(F.col(value), F.col("_median"))).drop("_median")


def view_stats(views: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Median of each view and the absolute minimum around it. A view is a few hundred rows."""
    keys = keys or EVENT_KEY
    stats = group_medians(
        views, keys, {"median": value}, extra={"_min": F.min(value)}, may_be_hot=False
    )
    return stats.select(*keys, "median", F.abs(F.col("_min") - F.col("median")).alias("abs_min"))


def normalize_view(views: DataFrame, value: str, stats: DataFrame, out: str) -> DataFrame:
    """Shift by the view's own median and scale its minimum to -1."""
    shifted = F.col(value) - F.col("median")
    return (
        views.join(stats, EVENT_KEY)
        .withColumn(out, F.try_divide(shifted, F.col("abs_min")))
        .drop("median", "abs_min")
    )


def normalize_view_by_reference(
    views: DataFrame, value: str, stats: DataFrame, keys: list[str], out: str
) -> DataFrame:
    """Shift by another view's median; scale by its absolute minimum or, if larger, by the
    minimum of the shifted view."""
    lows = views.groupBy(*keys).agg(F.min(value).alias("_min"))
    shifted = F.col(value) - F.col("median")
    scale = F.greatest(F.col("abs_min"), F.col("_min") - F.col("median"))
    return (
        views.join(lows.join(stats, EVENT_KEY), keys)
        .withColumn(out, F.try_divide(shifted, scale))
        .drop("median", "abs_min", "_min")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of the known values of an array; NaN counts as the largest number."""

    def middle(known: Column) -> Column:
        spot = F.lit(0.5) * (F.size(known) - 1)
        low, high = (F.get(known, f(spot).cast("int")) for f in (F.floor, F.ceil))
        return F.when(spot == F.floor(spot), low).otherwise(low * F.lit(0.5) + high * F.lit(0.5))

    return bound(F.sort_array(F.filter(values, lambda x: x.isNotNull())), middle)


def array_stats(values: Column) -> Column:
    """``view_stats`` of a view that is an array: a struct of median and abs_min."""

    def both(median: Column) -> Column:
        return F.struct(median.alias("median"), F.abs(F.array_min(values) - median).alias("abs_min"))

    return bound(array_median(values), both)


def scale_array(values: Column, median: Column, scale: Column) -> Column:
    """Every value of an array less the median, divided by the scale."""
    given = F.struct(median.alias("median"), scale.alias("scale"))
    return bound(
        given, lambda g: F.transform(values, lambda x: F.try_divide(x - g["median"], g["scale"]))
    )


def normalize_array(values: Column, stats: Column) -> Column:
    """``normalize_view`` of a view that is an array, with its own ``array_stats``."""
    return scale_array(values, stats["median"], stats["abs_min"])


def normalize_array_by_reference(values: Column, stats: Column) -> Column:
    """``normalize_view_by_reference`` of an array, with the ``array_stats`` of another view."""
    low = F.array_min(values) - stats["median"]
    return scale_array(values, stats["median"], F.greatest(stats["abs_min"], low))


def views_std(views: DataFrame, values: Iterable[str], train: DataFrame) -> DataFrame:
    """One row: population deviation over all points of the training views."""
    kept = views.join(train.select("target_id"), "target_id", "left_semi")
    return kept.agg(*[F.stddev_pop(c).alias(c) for c in values])


def normalize_view_by_std(views: DataFrame, values: list[str], std: DataFrame) -> DataFrame:
    """Shift every view by its own median and divide by one deviation for all views."""
    medians = group_medians(views, EVENT_KEY, {f"_m_{c}": c for c in values}, may_be_hot=False)
    out = views.join(medians, EVENT_KEY).withColumn("_std", std.select(F.struct(*values)).scalar())
    for c in values:
        shifted = F.col(c) - F.col(f"_m_{c}")
        out = out.withColumn(c, F.try_divide(shifted, F.col("_std").getField(c)))
    return out.drop("_std", *[f"_m_{c}" for c in values])


def normalize_scalars(
    df: DataFrame,
    train: DataFrame,
    id_column: str,
    excluded: Iterable[str],
    sigma_cut: float | tuple[float, float] | None = None,
) -> DataFrame:
    """``(x - median) / std`` of the training rows for every numeric column, then clipped.

    ``train`` holds the training identifiers in ``target_id``. The clip limits are multiples of
    the deviation of the normalised column over all rows; excluded columns pass through.
    """
    skip = set(excluded)
    fields = [
        f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)
    ]
    ids = train.select(F.col("target_id").alias(id_column))
    long = (
        df.join(ids, id_column, "left_semi")
        .select(*[F.col(c).cast("double").alias(c) for c in fields])
        .unpivot([], fields, "_field", "_value")
    )
    # Columns are spread over tasks, not gathered in one; a long column is rank-selected.
    stats = group_medians(
        long, ["_field"], {"_median": "_value"}, extra={"_std": F.stddev_samp("_value")}
    )
    entry = F.struct("_field", F.struct("_median", "_std"))
    # One subquery in one column: a reference per field would plan the statistics per field.
    packed = stats.agg(F.map_from_entries(F.collect_list(entry)).alias("s")).scalar()

    def scaled(c: str) -> Column:
        at = F.col("_stats")[F.lit(c)]
        return F.try_divide(F.col(c) - at["_median"], at["_std"]).alias(c)

    passed = [F.col(c) for c in df.columns if c not in fields]
    normal = df.withColumn("_stats", packed).select(*passed, *[scaled(c) for c in fields])
    if not sigma_cut:
        return normal.select(*df.columns)
    low, high = sigma_cut if isinstance(sigma_cut, tuple) else (-sigma_cut, sigma_cut)
    spread = normal.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in fields]).alias("s")).scalar()

    def clipped(c: str) -> Column:
        limit = F.col("_spread").getField(c)
        bounded = F.least(F.greatest(F.col(c), limit * F.lit(float(low))),
                          limit * F.lit(float(high)))
        return F.when(F.col(c).isNotNull(), bounded).alias(c)

    return normal.withColumn("_spread", spread).select(
        *[clipped(c) if c in fields else F.col(c) for c in df.columns]
    )


def robust_rows(
    df: DataFrame, keys: list[str], value: str, cut: float,
    hot: HotKeys | None = None, hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``kept`` (False for outliers), and per group the robust ``mean`` and
    ``mean_std``. Two trimming rounds start from the median absolute deviation."""
    options = {"hot_rows": hot_rows, "may_be_hot": hot is not None}
    valid = df.where(F.col(value).isNotNull())
    centre = group_medians(valid, keys, {"_centre": value}, extra={"_n": F.count(value)}, **options)
    rows = join_per_key(valid, centre, keys, hot).withColumn(
        "_dev", F.abs(F.col(value) - F.col("_centre"))
    )
    mad = group_medians(rows, keys, {"_mad": "_dev"}, extra={"_mean_dev": F.avg("_dev")}, **options)
    sigma = F.col("_mad") / F.lit(MAD_SCALE_ROUNDED)
    sigma = F.when(F.abs(sigma) <= 1e-8, F.col("_mean_dev") * MEAN_DEVIATION_SCALE).otherwise(sigma)
    rows = join_per_key(rows, mad.select(*keys, sigma.alias("_sigma0")), keys, hot)
    for i in (0, 1):
        inside = F.col("_dev") <= F.col(f"_sigma{i}") * F.lit(float(cut))
        kept = F.when(inside, F.col(value))
        spread = F.stddev_pop(kept) / F.lit(trim_compensation(cut))
        trimmed = rows.groupBy(*keys).agg(
            spread.alias(f"_sigma{i + 1}"),
            F.avg(kept).alias("mean"),
            F.count(kept).alias("n_kept"),
            F.count(value).alias("_n_all"),
        )
        if i == 0:
            trimmed = trimmed.select(*keys, "_sigma1")
            rows = join_per_key(rows, trimmed, keys, hot)
    stats = trimmed.select(
        *keys,
        "mean",
        F.try_divide(F.col("_sigma2"), F.sqrt(F.col("_n_all") - F.lit(1.0))).alias("mean_std"),
        "n_kept",
    )
    marked = rows.withColumn("kept", inside).drop(
        "_centre", "_n", "_dev", "_sigma0", "_sigma1"
    )
    return marked, stats


def mad_sigma(
    diffs: DataFrame, keys: list[str], value: str = "diff", out: str = "sigma",
    hot: HotKeys | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Normal-scaled median absolute deviation of ``value`` per group."""
    options = {"hot_rows": hot_rows, "may_be_hot": hot is not None}
    centre = group_medians(diffs, keys, {"_centre": value}, **options)
    rows = join_per_key(diffs, centre, keys, hot).withColumn(
        "_dev", F.abs(F.col(value) - F.col("_centre"))
    )
    mad = group_medians(rows, keys, {"_mad": "_dev"}, **options)
    return mad.select(*keys, (F.col("_mad") / F.lit(MAD_SCALE)).alias(out))
