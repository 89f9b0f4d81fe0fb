"""Event masks and marks: series rows against the events of their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.functions.periodic import EventWidth, is_even_period, phase_fold, width_adjusted
from fluxfold.operators.skew import HotKeys, join_per_key

NO_EVENT = "no detected"
# Targets have a handful of events; beyond this many they are not gathered in one row.
EVENTS_PER_TARGET = 1000


def join_series_events(
    obs: DataFrame, events: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """One row per observation and event of its target."""
    return join_per_key(obs, events, ["target_id"], hot)


def _intervals(events: DataFrame, width: EventWidth) -> DataFrame:
    reach = width(F.col("period"), F.col("duration"), F.col("secondary_phase")) * F.lit(0.5)
    return events.select(
        "target_id", "epoch", "period", reach.alias("reach")
    ).where(F.col("period") > 0)


def _inside() -> Column:
    return F.abs(phase_fold(F.col("l.time"), F.col("r.epoch"), F.col("r.period"))) <= F.col(
        "r.reach"
    )


def mask_events(
    obs: DataFrame,
    events: DataFrame,
    width: EventWidth = width_adjusted,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Drop the observations within half the event width of any event of their target."""
    return join_per_key(
        obs, _intervals(events, width), ["target_id"], hot, "left_anti", _inside()
    )


def event_arrays(events: DataFrame, *columns: str) -> DataFrame | None:
    """``events_of``: the events of each target as one array in event order.

    None if any target has more than ``EVENTS_PER_TARGET`` (counted first).
    """
    most = events.groupBy("target_id").count().agg(F.max("count")).first()[0]
    if (most or 0) > EVENTS_PER_TARGET:
        return None
    return events.groupBy("target_id").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("events_of")
    )


def _covers(time: Column, event: Column) -> Column:
    return F.abs(phase_fold(time, event["epoch"], event["period"])) <= event["reach"]


def flag_events(
    obs: DataFrame,
    events: DataFrame,
    width: EventWidth = width_adjusted,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Keep all observations and add ``masked``: whether an event of the target covers the row.

    One pass with the events of a target at hand; two anti/semi joins where they are too many.
    """
    intervals = _intervals(events, width)
    arrays = event_arrays(intervals, "epoch", "period", "reach")
    if arrays is None:
        covered = join_per_key(obs, intervals, ["target_id"], hot, "left_semi", _inside())
        clear = mask_events(obs, events, width, hot)
        return covered.withColumn("masked", F.lit(True)).unionByName(
            clear.withColumn("masked", F.lit(False))
        )
    hit = F.exists("events_of", lambda e: _covers(F.col("time"), e))
    return (
        join_per_key(obs, arrays, ["target_id"], hot, "left")
        .withColumn("masked", F.coalesce(hit, F.lit(False)))
        .drop("events_of")
    )


def mask_segments(
    obs: DataFrame, masked: DataFrame, include_empty: bool = True
) -> DataFrame:
    """Number of rows left in each segment; a segment that lost all rows counts 0 or is left out."""
    keys = ["target_id", "quarter", "segment_id"]
    left = masked.groupBy(*keys).agg(F.count("*").alias("n_left"))
    if not include_empty:
        return left
    return (
        obs.select(*keys)
        .distinct()
        .join(left, keys, "left")
        .withColumn("n_left", F.coalesce("n_left", F.lit(0).cast("long")))
    )


def mark_transits(
    obs: DataFrame, tces: DataFrame, default: str = NO_EVENT, hot: HotKeys | None = None
) -> DataFrame:
    """Add ``transit``: the name (or id) of the last event whose duration covers the row."""
    name = F.when(F.length("name") > 0, F.col("name")).otherwise(F.col("tce_id").cast("string"))
    events = tces.select(
        "target_id", "tce_id", "epoch", "period", F.col("duration").alias("reach"),
        name.alias("label_text"),
    )
    arrays = event_arrays(events, "tce_id", "epoch", "period", "reach", "label_text")
    if arrays is not None:
        # No shuffle of the observations beyond what the join needs.
        hits = F.filter("events_of", lambda e: _covers(F.col("time"), e))
        last = F.get(hits, F.size(hits) - 1)["label_text"]
        return (
            join_per_key(obs, arrays, ["target_id"], hot, "left")
            .withColumn("transit", F.coalesce(last, F.lit(default)))
            .drop("events_of")
        )
    # Equal observations get equal marks: they are joined once and repeated afterwards. The
    # combiner keeps one mark per observation before anything is shuffled.
    distinct = obs.groupBy(*obs.columns).agg(F.count("*").alias("_copies"))
    joined = join_per_key(distinct, events, ["target_id"], hot, "left", _inside())
    last = F.max(
        F.when(
            F.col("epoch").isNotNull(),
            F.struct("tce_id", "epoch", "period", "reach", "label_text"),
        )
    )
    marked = joined.groupBy(*obs.columns, "_copies").agg(
        F.coalesce(last["label_text"], F.lit(default)).alias("transit")
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))
    return marked.select(*obs.columns, "transit", repeated.alias("_copy")).drop("_copy")


def split_odd_even(
    obs: DataFrame, events: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """One row per observation and event with ``even``: the parity of its orbital period."""
    joined = join_series_events(obs, events, hot)
    return joined.withColumn(
        "even", is_even_period(F.col("time"), F.col("epoch"), F.col("period"))
    )
