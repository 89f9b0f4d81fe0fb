"""Series operators: gaps, differences, interpolation, period edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxfold.operators.ordered import with_neighbours, with_previous, with_running_sum
from fluxfold.operators.skew import HotKeys

SERIES = ["target_id", "quarter"]
SEGMENT = ["target_id", "quarter", "segment_id"]
ORDER = ["time", "seq"]


def split_at_gaps(obs: DataFrame, gap: float = 0.75, hot: HotKeys | None = None) -> DataFrame:
    """Add ``segment_id``: it rises where two neighbours of a quarter are more than ``gap`` apart."""
    if gap <= 0:
        raise ValueError(f"gap must be > 0, got {gap}")
    stepped = with_previous(obs, SERIES, ORDER, ["time"], hot)
    jump = F.coalesce(F.col("time") - F.col("prev_time") > F.lit(float(gap)), F.lit(False))
    marked = stepped.withColumn("_jump", jump.cast("long")).drop("prev_time")
    return with_running_sum(marked, SERIES, ORDER, "_jump", "segment_id", hot).drop("_jump")


def scaled_diffs(
    obs: DataFrame, value: str = "flux", scale: float = 1.0, hot: HotKeys | None = None
) -> DataFrame:
    """First differences of ``value`` within each segment, divided by ``scale``."""
    if scale == 0:
        raise ValueError("scale must not be 0")
    stepped = with_previous(obs, SEGMENT, ORDER, [value, "seq"], hot)
    return (
        stepped.where(F.col("prev_seq").isNotNull())
        .withColumn("diff", (F.col(value) - F.col(f"prev_{value}")) / F.lit(float(scale)))
        .drop(f"prev_{value}", "prev_seq")
    )


def interpolate_masked(
    obs: DataFrame, values: dict[str, str], masked: str = "masked", hot: HotKeys | None = None
) -> DataFrame:
    """Linear interpolation over the rows flagged ``masked``, per segment.

    ``values`` maps an output column to a series column. Outside the unmasked points the nearest
    one is used; a segment without any stays NULL.
    """
    known = {}
    for i, value in enumerate(values.values()):
        usable = ~F.col(masked) & F.col(value).isNotNull()
        known[f"_k{i}"] = F.when(usable, F.struct(F.col("time").alias("t"),
                                                  F.col(value).alias("v")))
    sides = {k: (f"{k}_left", f"{k}_right") for k in known}
    rows = with_neighbours(obs.withColumns(known), SEGMENT, ORDER, sides, hot)
    filled = {}
    for (name, value), (left_name, right_name) in zip(values.items(), sides.values(), strict=True):
        left, right = F.col(left_name), F.col(right_name)
        slope = F.try_divide(right.v - left.v, right.t - left.t)
        between = left.v + F.coalesce(slope, F.lit(0.0)) * (F.col("time") - left.t)
        filled[name] = (
            F.when(~F.col(masked), F.col(value))
            .when(left.isNull(), right.v)
            .when(right.isNull(), left.v)
            .otherwise(between)
        )
    return rows.withColumns(filled).drop(*known, *[c for pair in sides.values() for c in pair])


def period_edges(obs: DataFrame) -> DataFrame:
    """Time of the last observation of each quarter that another quarter follows.

    Aggregates before it orders: the window sees one row per target and quarter.
    """
    last = obs.groupBy(*SERIES).agg(F.max("time").alias("edge_time"))
    following = F.lead("quarter").over(W.partitionBy("target_id").orderBy("quarter"))
    return last.withColumn("next_quarter", following).where(F.col("next_quarter").isNotNull())
