"""Ordered operators over series: windows whose hot groups are cut into slices of equal counts.

Each primitive is a plain window inside a slice plus a carry from the slices before or after it.
The carry is a window over one row per slice, so no task ever holds a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxfold.operators.skew import HotKeys


def _slices(
    df: DataFrame, keys: list[str], order: list[str], hot: HotKeys | None
) -> tuple[DataFrame, list[str]]:
    if hot is None:
        return df, list(keys)
    return hot.attach(df, keys, order), [*keys, "_piece"]


def _carried(df, part, carry):
    """Join one row per group and slice back to the rows.

    No key of this join has more rows than a slice, so it needs no hint: Spark broadcasts the carry
    if its measured size allows it.
    """
    return df.join(carry, part, "left")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], hot: HotKeys | None = None
) -> DataFrame:
    """Add ``prev_<column>``: the value on the row before, NULL on the first row of a group."""
    rows, part = _slices(df, keys, order, hot)
    window = W.partitionBy(*part).orderBy(*order)
    out = rows
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(window))
    if hot is None:
        return out
    last = hot.only(rows).groupBy(*part).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    )
    carry = last.withColumn(
        "_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_piece"))
    ).drop("_last")
    out = out.withColumn("_first", F.row_number().over(window) == 1)
    out = _carried(out, part, carry)
    for c in columns:
        out = out.withColumn(
            f"prev_{c}", F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"prev_{c}"))
        )
    return out.drop("_first", "_carry", "_piece")


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the sum of ``column`` over all rows up to this one."""
    rows, part = _slices(df, keys, order, hot)
    up_to = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn(name, F.sum(column).over(up_to))
    if hot is None:
        return out
    totals = hot.only(rows).groupBy(*part).agg(F.sum(column).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.sum("_total").over(before)).drop("_total")
    out = _carried(out, part, carry)
    return out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop(
        "_carry", "_piece"
    )


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, str]],
    hot: HotKeys | None = None,
) -> DataFrame:
    """For each column add (before, after): its last non-NULL value up to this row and its first
    one from this row on."""
    rows, part = _slices(df, keys, order, hot)
    up_to = W.partitionBy(*part).orderBy(*order)
    # The same running fill in descending order: linear, where a frame that ends at the last row
    # would be rescanned for every row.
    down_to = W.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    out = rows
    for window, side in ((up_to, 0), (down_to, 1)):
        running = window.rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumns(
            {names[side]: F.last(c, ignorenulls=True).over(running)
             for c, names in columns.items()}
        )
    if hot is None:
        return out
    ends = []
    for i, c in enumerate(columns):
        known = F.when(F.col(c).isNotNull(), F.struct(*order))
        ends += [F.max_by(c, known).alias(f"_last{i}"), F.min_by(c, known).alias(f"_head{i}")]
    slices = W.partitionBy(*keys).orderBy("_piece")
    earlier = slices.rowsBetween(W.unboundedPreceding, -1)
    later = slices.rowsBetween(1, W.unboundedFollowing)
    carried = []
    for i in range(len(columns)):
        carried += [
            F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_in{i}"),
            F.first(f"_head{i}", ignorenulls=True).over(later).alias(f"_out{i}"),
        ]
    carry = hot.only(rows).groupBy(*part).agg(*ends).select(*part, *carried)
    out = _carried(out, part, carry)
    for i, (before, after) in enumerate(columns.values()):
        out = out.withColumn(before, F.coalesce(before, f"_in{i}")).withColumn(
            after, F.coalesce(after, f"_out{i}")
        )
    return out.drop("_piece", *[f"{n}{i}" for i in range(len(columns)) for n in ("_in", "_out")])
