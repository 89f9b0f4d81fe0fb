"""Fixed-length views of a folded series.

Rows of a view are (target_id, tce_id, bin, value). Bins have a uniform spacing and one width, so
they may overlap or leave gaps; the bins of a row follow from arithmetic, not from a range join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxfold.functions.periodic import (
    BinWidth,
    Bounds,
    EventWidth,
    global_bin_width,
    global_bounds,
    is_even_period,
    local_bin_width,
    local_bounds,
    phase_fold,
    width_secondary,
)
from fluxfold.operators.mapping import secondary_events
from fluxfold.operators.quantiles import group_medians
from fluxfold.operators.skew import BROADCAST_ROWS, HotKeys, join_per_key
from fluxfold.session import materialize

EVENT_KEY = ["target_id", "tce_id"]
Aggregate = Callable[[Column], Column]
# Quotients of the bin arithmetic are far below 1e6, so their error is far below this.
_EDGE = 1e-9
#: Rows of views, copies in overlapping bins and empty bins included, that one task sorts, about.
TASK_ROWS = 1_500_000


def bin_range(
    x: Column, num_bins: int, low: Column, high: Column, width: Column, spacing: Column
) -> tuple[Column, Column]:
    """First and last bin with ``low + i*spacing <= x < low + width + i*spacing``.

    The bins of a point are contiguous. The quotients are right to within one bin, so one exact
    comparison with an edge settles each end. NULL outside the bounds; first > last in a gap.
    """
    first = F.floor((x - low - width) / spacing - F.lit(_EDGE)) + 1
    first = F.when(x < low + width + first * spacing, first).otherwise(first + 1)
    last = F.floor((x - low) / spacing + F.lit(_EDGE))
    last = F.when(x >= low + last * spacing, last).otherwise(last - 1)
    inside = (x >= low) & (x < high)
    return (
        F.when(inside, F.greatest(F.lit(0), first.cast("int"))),
        F.when(inside, F.least(F.lit(num_bins - 1), last.cast("int"))),
    )


def _explode_bins(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def bin_rows(
    df: DataFrame, x: str, num_bins: int, low: str, high: str, width: str, spacing: str
) -> DataFrame:
    """Add ``_first`` and ``_last``, the bins of each row; rows in no bin are dropped.

    They are dropped by a generator: a filter would be pushed below the projections, where it
    folds every row again for each comparison.
    """
    first, last = bin_range(F.col(x), num_bins, *map(F.col, (low, high, width, spacing)))
    ranged = df.withColumn("_from", first).withColumn("_to", last)
    found = F.when(F.col("_from") <= F.col("_to"), F.array(F.struct("_from", "_to")))
    return ranged.select(*df.columns, F.inline(found).alias("_first", "_last"))


def assign_bins(
    df: DataFrame, keys: list[str], x: str, num_bins: int, *,
    bin_width: float | None = None, x_min: float | None = None, x_max: float | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Bins of a plain x axis. Missing bounds default to the data range of each group."""
    if num_bins < 2:
        raise ValueError(f"num_bins must be >= 2, got {num_bins}")
    if x_min is not None and x_max is not None:
        if x_min >= x_max:
            raise ValueError(f"x_min must be < x_max, got {x_min}, {x_max}")
        if bin_width is not None and not 0 < bin_width < x_max - x_min:
            raise ValueError(f"bin_width must be in (0, {x_max - x_min}), got {bin_width}")
    if bin_width is not None and bin_width <= 0:
        raise ValueError(f"bin_width must be > 0, got {bin_width}")
    if x_min is None or x_max is None:
        span = df.groupBy(*keys).agg(F.min(x).alias("_min"), F.max(x).alias("_max"))
        if keys:
            rows = join_per_key(df, span, keys, hot)
        else:
            ends = span.select(F.struct("_min", "_max")).scalar()
            rows = df.withColumn("_span", ends).select(*df.columns, "_span.*")
    else:
        rows = df.withColumn("_min", F.lit(None)).withColumn("_max", F.lit(None))
    low = F.col("_min") if x_min is None else F.lit(float(x_min))
    high = F.col("_max") if x_max is None else F.lit(float(x_max))
    rows = rows.withColumn("_lo", low).withColumn("_hi", high)
    width = (
        (F.col("_hi") - F.col("_lo")) / F.lit(float(num_bins))
        if bin_width is None
        else F.lit(float(bin_width))
    )
    rows = rows.withColumn("_w", width).withColumn(
        "_s", (F.col("_hi") - F.col("_lo") - F.col("_w")) / F.lit(float(num_bins - 1))
    )
    rows = rows.where((F.col("_w") > 0) & (F.col("_s") > 0))
    binned = bin_rows(rows, x, num_bins, "_lo", "_hi", "_w", "_s")
    return _explode_bins(binned).drop("_min", "_max", "_lo", "_hi", "_w", "_s")


@dataclass(frozen=True)
class ViewSpec:
    """Parameters of a view. ``aggregate`` None is the exact median.

    ``default`` fills empty bins: a number, or None for the median of the whole folded series.
    """

    num_bins: int
    bounds: Bounds
    bin_width: BinWidth
    aggregate: Aggregate | None = None
    default: float | None = None

    def __post_init__(self) -> None:
        if self.num_bins < 2:
            raise ValueError(f"num_bins must be >= 2, got {self.num_bins}")


LOCAL_VIEW = ViewSpec(31, local_bounds(2.5), local_bin_width(0.16))
GLOBAL_VIEW = ViewSpec(301, global_bounds, global_bin_width(301, 0.16))


def event_frames(events: DataFrame, spec: ViewSpec) -> DataFrame:
    """Per event: view bounds, bin width and bin spacing. Events that fit no view are left out."""
    period, duration = F.col("period"), F.col("duration")
    low, high = spec.bounds(period, duration)
    spacing = (F.col("_hi") - F.col("_lo") - F.col("_w")) / F.lit(float(spec.num_bins - 1))
    framed = (
        events.withColumn("_lo", low)
        .withColumn("_hi", high)
        .withColumn("_w", spec.bin_width(period, duration))
        .withColumn("_s", spacing)
    )
    return framed.where((period > 0) & (F.col("_w") > 0) & (F.col("_s") > 0))


@dataclass(frozen=True)
class Placing:
    """How the rows of a series meet the frames of their events and where they are binned.

    Few events are broadcast, and the folded rows are then dealt to ``tasks`` tasks by view.
    Beyond the limit both sides are dealt to them by target, and the views need no further
    shuffle. With hot keys (``tasks`` None) the salted join and the medians place the rows.
    """

    tasks: int | None
    small: bool

    def series(self, rows: DataFrame) -> DataFrame:
        dealt = self.tasks is not None and not self.small
        return rows.repartition(self.tasks, "target_id") if dealt else rows

    def frames(self, frames: DataFrame) -> DataFrame:
        return F.broadcast(frames) if self.small else self.series(frames)

    def folded(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Shuffle the rows, not their copies in overlapping bins."""
        return rows.repartition(self.tasks, *keys) if self.small else rows


def _placed(
    series: DataFrame, events: DataFrame, frames: DataFrame, num_bins: int, hot: HotKeys | None,
    views: int = 1,
) -> Placing:
    """The placing of ``frames``, with as many tasks as the counted rows of the views need.

    A shuffle's bytes say little about them: an event's frame is one row and fills every bin.
    """
    if hot is not None:
        return Placing(None, False)
    number = events.count()
    # Bins of a row, on average over the events, if no row misses the bounds.
    overlap = F.least(F.lit(float(num_bins)), F.lit(2.0) + F.col("_w") / F.col("_s"))
    per_target = frames.groupBy("target_id").agg(F.sum(overlap).alias("_copies"))
    sizes = series.groupBy("target_id").agg(F.count("*").alias("_size"))
    copies = sizes.join(per_target, "target_id").agg(F.sum(F.col("_size") * F.col("_copies")))
    rows = (copies.first()[0] or 0.0) + views * number * num_bins
    tasks = max(series.sparkSession.sparkContext.defaultParallelism, int(rows // TASK_ROWS) + 1)
    return Placing(tasks, number <= BROADCAST_ROWS)


def fold_rows(series: DataFrame, frames: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Series rows joined with the events of their target, with the folded time ``folded``."""
    return join_per_key(series, frames, ["target_id"], hot).withColumn(
        "folded", phase_fold(F.col("time"), F.col("epoch"), F.col("period"))
    )


def view_of_folded(
    folded: DataFrame,
    frames: DataFrame,
    keys: list[str],
    spec: ViewSpec,
    values: dict[str, str],
    defaults: DataFrame,
    placing: Placing,
    hot_rows: int | None = None,
) -> DataFrame:
    """Bin folded rows: one row per view (``keys``) and bin.

    ``defaults`` holds the fill value of every series as ``_d<i>`` for the i-th value column; its
    keys are a subset of ``keys``. A view exists where the series has a default.
    """
    sources = list(dict.fromkeys(values.values()))
    key = [*keys, "bin"]
    fills = [f"_d{i}" for i in range(len(sources))]
    none = F.lit(None).cast("double")
    ranged = bin_rows(folded, "folded", spec.num_bins, "_lo", "_hi", "_w", "_s").select(
        *keys, *sources, *[none.alias(d) for d in fills], "_first", "_last", F.lit(1).alias("_real")
    )
    # One empty row per view covers all bins and brings their fill value: every bin is there and
    # filled without another join.
    on = [c for c in keys if c in defaults.columns]
    scaffold = placing.series(frames.join(defaults, on)).select(
        *keys,
        *[none.alias(c) for c in sources],
        *fills,
        F.lit(0).alias("_first"),
        F.lit(spec.num_bins - 1).alias("_last"),
        F.lit(0).alias("_real"),
    )
    stacked = _explode_bins(placing.folded(ranged.unionByName(scaffold), keys))
    extra = {"_real": F.max("_real"), "_view": F.min("_real"), **{d: F.max(d) for d in fills}}
    if spec.aggregate is None:
        names = {f"_v{i}": c for i, c in enumerate(sources)}
        stats = group_medians(
            stacked, key, names, extra=extra, hot_rows=hot_rows, may_be_hot=placing.tasks is None
        )
    else:
        # NULL in the empty rows; aggregates skip it.
        results = {f"_v{i}": spec.aggregate(F.col(c)) for i, c in enumerate(sources)}
        stats = stacked.groupBy(*key).agg(*[a.alias(n) for n, a in {**results, **extra}.items()])
    position = {c: i for i, c in enumerate(sources)}
    return stats.where(F.col("_view") == 0).select(
        *key,
        *[
            F.when(F.col("_real") == 1, F.col(f"_v{position[c]}"))
            .otherwise(F.col(f"_d{position[c]}"))
            .alias(name)
            for name, c in values.items()
        ],
    )


def series_defaults(
    series: DataFrame, keys: list[str], spec: ViewSpec, values: dict[str, str],
    hot: HotKeys | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Fill values of the empty bins of each series."""
    sources = list(dict.fromkeys(values.values()))
    if spec.default is not None:
        fixed = [F.lit(float(spec.default)).alias(f"_d{i}") for i in range(len(sources))]
        return series.select(*keys).distinct().select(*keys, *fixed)
    names = {f"_d{i}": c for i, c in enumerate(sources)}
    return group_medians(series, keys, names, hot_rows=hot_rows, may_be_hot=hot is not None)


def folded_view(
    series: DataFrame,
    events: DataFrame,
    spec: ViewSpec,
    values: dict[str, str],
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Views of every event: one row per event and bin.

    ``values`` maps an output column to a series column; all share one pass over the folded
    rows. Empty bins get the default (which depends on the series alone, so it is computed once
    per target); a bin with only missing values stays missing. Events whose target has no
    series have no view.
    """
    frames = event_frames(events.select(*EVENT_KEY, "epoch", "period", "duration"), spec)
    rows = series.select("target_id", "time", *dict.fromkeys(values.values()))
    placing = _placed(rows, events, frames, spec.num_bins, hot)
    folded = fold_rows(placing.series(rows), placing.frames(frames), hot)
    defaults = series_defaults(series, ["target_id"], spec, values, hot, hot_rows)
    return view_of_folded(folded, frames, EVENT_KEY, spec, values, defaults, placing, hot_rows)


def odd_even_views(
    series: DataFrame,
    events: DataFrame,
    spec: ViewSpec,
    value: str,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Views of the odd and of the even orbital periods, in one pass.

    One row per event, parity (``even``) and bin. A parity without observations has no view.
    """
    frames = event_frames(events.select(*EVENT_KEY, "epoch", "period", "duration"), spec)
    rows = series.select("target_id", "time", value)
    placing = _placed(rows, events, frames, spec.num_bins, hot, views=2)
    folded = fold_rows(placing.series(rows), placing.frames(frames), hot).withColumn(
        "even", is_even_period(F.col("time"), F.col("epoch"), F.col("period"))
    )
    keys = [*EVENT_KEY, "even"]
    both = frames.withColumn("even", F.explode(F.array(F.lit(False), F.lit(True))))
    defaults = series_defaults(folded, keys, spec, {value: value}, hot, hot_rows)
    return view_of_folded(folded, both, keys, spec, {"value": value}, defaults, placing, hot_rows)


def secondary_rows(
    series: DataFrame, events: DataFrame, value: str, width: EventWidth = width_secondary,
    hot: HotKeys | None = None, placing: Placing | None = None,
) -> DataFrame:
    """Per event, the series rows outside that event's primary transits."""
    if placing is None:
        placing = Placing(None, hot is None and events.count() <= BROADCAST_ROWS)
    reach = width(F.col("period"), F.col("duration"), F.col("secondary_phase")) * F.lit(0.5)
    primary = events.where(F.col("secondary_phase").isNotNull() & (F.col("period") > 0)).select(
        *EVENT_KEY, "epoch", "period", "duration", "secondary_phase", reach.alias("_reach")
    )
    rows = placing.series(series.select("target_id", "time", value))
    return (
        fold_rows(rows, placing.frames(primary), hot)
        .where(F.abs("folded") > F.col("_reach"))
        .drop("_reach", "folded")
    )


def secondary_views(
    series: DataFrame,
    events: DataFrame,
    spec: ViewSpec,
    value: str,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Views around the secondary event over the series without the primary transits.

    Events without a secondary phase have no view.
    """
    moved = secondary_events(events.select(*EVENT_KEY, "epoch", "period", "duration",
                                           "secondary_phase"))
    frames = event_frames(moved, spec)
    placing = _placed(series, events, frames, spec.num_bins, hot)
    rows = secondary_rows(series, events, value, hot=hot, placing=placing).withColumn(
        "folded",
        phase_fold(F.col("time"), F.col("epoch") + F.col("secondary_phase"), F.col("period")),
    )
    # The frame follows from the event columns the rows already carry: no second join.
    folded = event_frames(rows, spec)
    defaults = series_defaults(rows, EVENT_KEY, spec, {value: value}, hot, hot_rows)
    return view_of_folded(
        folded, frames, EVENT_KEY, spec, {"value": value}, defaults, placing, hot_rows
    )


def known_or_nan(values: Column) -> Column:
    """An array with NaN for its missing values."""
    return F.transform(values, lambda x: F.coalesce(x, F.lit(float("nan"))))


def view_arrays(
    rows: DataFrame, keys: list[str], values: list[str], missing: bool = False
) -> DataFrame:
    """Views as arrays ordered by bin; missing values become NaN, or stay NULL with ``missing``."""
    points = [F.col(c) if missing else F.coalesce(c, F.lit(float("nan"))).alias(c) for c in values]
    point = F.struct("bin", *points)
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_points"))
    return grouped.select(*keys, *[F.col(f"_points.{c}").alias(c) for c in values])


def rank_folded(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``rank``: the position of each row of its group in folded order, from 1 on.

    Rows are range-partitioned by group and order, so a large group spreads over tasks; the rank
    is the position inside a task plus the rows of the group in the tasks before.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(
        rows.repartitionByRange(tasks, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_task", F.spark_partition_id()),
        "folded_order",
    )
    sizes = sliced.groupBy(*keys, "_task").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_task").orderBy(*order))
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets, [*keys, "_task"])
        .withColumn("rank", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_task")
    )
