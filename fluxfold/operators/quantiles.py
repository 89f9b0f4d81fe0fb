"""Exact grouped quantiles.

Small groups are ranked inside one shuffle. Groups above ``hot_rows`` are never gathered: rank
selection narrows a value range with map-side combined bucket counts until the few values around
the wanted rank are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxfold.operators.skew import HOT_ROWS, maybe_broadcast
from fluxfold.session import materialize

LARGEST = 1.7976931348623157e308
BUCKETS = 4096
_ALL = "_all"


# A probability, or a rule that gives the zero-based rank from the number of values.
Rank = float | Callable[[Column], Column]


def _position(p: Rank, n: Column) -> Column:
    return p(n) if callable(p) else F.lit(float(p)) * (n - 1)


def _between(p: Rank, low: Column, high: Column, position: Column) -> Column:
    if callable(p):
        return low
    part = position - F.floor(position)
    return F.when(part == 0, low).otherwise(low * (F.lit(1.0) - part) + high * part)


def _ranked(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, Rank]], extra: dict[str, Column]
) -> DataFrame:
    """One exchange on the keys, one sort per distinct value column."""
    values = list(dict.fromkeys(v for v, _ in wanted.values()))
    out = df
    for i, value in enumerate(values):
        group = W.partitionBy(*keys)
        out = out.withColumn(
            f"_r{i}", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1
        ).withColumn(f"_n{i}", F.count(value).over(group))
    aggs = []
    for name, (value, p) in wanted.items():
        i = values.index(value)
        rank, spot = F.col(f"_r{i}"), _position(p, F.col(f"_n{i}"))
        low = F.max(F.when(rank == F.floor(spot), F.col(value)))
        high = F.max(F.when(rank == F.ceil(spot), F.col(value)))
        aggs.append(_between(p, low, high, _position(p, F.max(f"_n{i}"))).alias(name))
    aggs += [agg.alias(name) for name, agg in extra.items()]
    return out.groupBy(*keys).agg(*aggs)


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Bucket of a value in low..high; it rises with the value, and ``high`` has its own.

    So every round parts the largest value from the smallest, whatever the values are: an
    infinite or NaN bound is cut to the largest finite number for the division, and halves keep
    the width of the range finite.
    """
    bottom, top = F.greatest(low, F.lit(-LARGEST)) / 2, F.least(high, F.lit(LARGEST)) / 2
    share = F.coalesce(F.try_divide(value / 2 - bottom, top - bottom), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    inner = F.least(F.floor(share * (BUCKETS - 1)), F.lit(BUCKETS - 2))
    return F.when(value == high, F.lit(BUCKETS - 1)).otherwise(inner)


def _select_ranks(rows: DataFrame, wanted: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Values at given ranks: ``wanted`` holds keys, _rank, _low, _high, _below, _size.

    ``_low.._high`` is a value range known to hold the rank, ``_below`` the number of values
    under it. Buckets rise with the value, so ranks inside a bucket are exact whatever the
    rounding of the bucket number.
    """
    on = [*keys, "_rank"]
    while True:
        count = wanted.count()
        open_ranks = wanted.where((F.col("_size") > limit) & (F.col("_low") < F.col("_high")))
        near = rows.join(maybe_broadcast(wanted, count), keys).where(
            F.col("_v").between(F.col("_low"), F.col("_high"))
        )
        if open_ranks.isEmpty():
            break
        bucket = _bucket(F.col("_v"), F.col("_low"), F.col("_high"))
        buckets = (
            near.withColumn("_bucket", bucket)
            .groupBy(*on, "_below", "_bucket")
            .agg(F.count("*").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        before = W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        under = F.col("_below") + F.coalesce(F.sum("_size").over(before), F.lit(0))
        inside = (F.col("_rank") >= F.col("_under")) & (
            F.col("_rank") < F.col("_under") + F.col("_size")
        )
        wanted = materialize(
            buckets.withColumn("_under", under)
            .where(inside)
            .select(*on, "_low", "_high", F.col("_under").alias("_below"), "_size"),
            "rank_ranges",
        )
    # A range that is one value needs no rows; every other range now fits in one task.
    flat = wanted.where(F.col("_low") == F.col("_high")).select(*on, F.col("_low").alias("_v"))
    spot = F.row_number().over(W.partitionBy(*on).orderBy("_v")) - 1 + F.col("_below")
    rest = (
        near.where(F.col("_low") < F.col("_high"))
        .withColumn("_spot", spot)
        .where(F.col("_spot") == F.col("_rank"))
        .select(*on, "_v")
    )
    return flat.unionByName(rest)


def _selected(
    rows: DataFrame, stats: DataFrame, keys: list[str], probs: dict[str, Rank], limit: int
) -> DataFrame:
    """Quantiles of the groups in ``stats`` (keys, _n, _low, _high) over ``rows`` (keys, _v)."""
    spots = [f(_position(p, F.col("_n"))) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = materialize(
        stats.where(F.col("_n") > 0).select(
            *keys,
            F.explode(F.array_distinct(F.array(*spots))).alias("_rank"),
            "_low",
            "_high",
            F.lit(0).cast("long").alias("_below"),
            F.col("_n").alias("_size"),
        ),
        "rank_ranges",
    )
    found = _select_ranks(rows, wanted, keys, limit)
    by_rank = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )
    out = stats.join(by_rank, keys, "left")
    columns = []
    for name, p in probs.items():
        spot = _position(p, F.col("_n"))
        low, high = F.col("_at")[F.floor(spot)], F.col("_at")[F.ceil(spot)]
        columns.append(_between(p, low, high, spot).alias(name))
    return out.select(*keys, *columns)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, Rank]],
    *,
    extra: dict[str, Column] | None = None,
    hot_rows: int | None = None,
    may_be_hot: bool = True,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group.

    ``wanted`` maps an output name to (value column, probability or rank rule). NULL values do
    not count. ``extra`` adds plain aggregates to the same pass.
    ``may_be_hot=False`` states that no group can exceed ``hot_rows`` and skips the check.
    """
    extra = extra or {}
    for name, (_, p) in wanted.items():
        if not callable(p) and not 0 <= p <= 1:
            raise ValueError(f"probability of {name} must be in [0, 1], got {p}")
    if not keys:
        single = df.withColumn(_ALL, F.lit(1))
        return group_quantiles(
            single, [_ALL], wanted, extra=extra, hot_rows=hot_rows, may_be_hot=may_be_hot
        ).drop(_ALL)
    if not may_be_hot:
        return _ranked(df, keys, wanted, extra)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    # No group is larger than the table, and the row count of a scan is in its footers.
    if df.count() <= limit:
        return _ranked(df, keys, wanted, extra)

    values = list(dict.fromkeys(v for v, _ in wanted.values()))
    spans = [f(F.col(v)).alias(f"{n}{i}") for i, v in enumerate(values)
             for n, f in (("_n", F.count), ("_low", F.min), ("_high", F.max))]
    more = [agg.alias(name) for name, agg in extra.items()]
    hot = materialize(
        df.groupBy(*keys).agg(F.count("*").alias("_rows"), *spans, *more).where(F.col("_rows") > limit),
        "hot_groups",
    )
    hot_count = hot.count()
    if not hot_count:
        return _ranked(df, keys, wanted, extra)
    side = maybe_broadcast(hot.select(*keys), hot_count)
    cold = _ranked(df.join(side, keys, "left_anti"), keys, wanted, extra)
    large = df.join(side, keys, "left_semi")
    out = hot.select(*keys, *extra)
    for i, value in enumerate(values):
        stats = hot.select(
            *keys, F.col(f"_n{i}").alias("_n"),
            F.col(f"_low{i}").alias("_low"), F.col(f"_high{i}").alias("_high"),
        )
        rows = large.select(*keys, F.col(value).alias("_v")).where(
            F.col("_v").isNotNull()
        )
        probs = {name: p for name, (v, p) in wanted.items() if v == value}
        out = out.join(_selected(rows, stats, keys, probs, limit), keys)
    return cold.unionByName(out)


def group_medians(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str],
    *,
    extra: dict[str, Column] | None = None,
    hot_rows: int | None = None,
    may_be_hot: bool = True,
) -> DataFrame:
    """Exact medians; ``values`` maps an output name to a value column."""
    wanted = {name: (value, 0.5) for name, value in values.items()}
    return group_quantiles(
        df, keys, wanted, extra=extra, hot_rows=hot_rows, may_be_hot=may_be_hot
    )
