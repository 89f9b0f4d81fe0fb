"""Hot keys: find the groups too large for one task and split them exactly.

A group is *hot* when it has more than ``hot_rows`` rows, so ``N`` rows hold at most
``N / hot_rows`` hot groups: the table of hot keys is small by construction, and its size is
counted before it is ever broadcast. Data without hot groups takes the plain plans, at the price
of one map-side combined count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.session import materialize

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 1_000_000
# Range boundaries come from a sample; aim below the limit.
SLACK = 4


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted size allows it, else leave the choice to Catalyst."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class HotKeys:
    """The hot groups of a table: one row per key with its row count and number of slices."""

    keys: tuple[str, ...]
    order: str
    table: DataFrame
    rows: int
    pieces: int

    def side(self, *extra: str) -> DataFrame:
        return maybe_broadcast(self.table.select(*self.keys, *extra), self.rows)

    def attach(self, df: DataFrame, groups: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
        """Add ``_piece``: the slice of a hot row; 0 for all other rows.

        The hot rows are range-partitioned by ``groups`` (the keys or finer groups) and ``order``,
        so slices hold about the same number of rows however these crowd on the order column, and
        the slices of a group rise with it. They are written once: whoever reads them again sees
        the same slices.
        """
        by = [*(groups or self.keys), *(order or [self.order])]
        ranges = self.only(df).repartitionByRange(self.pieces, *by)
        cut = materialize(ranges.withColumn("_piece", F.spark_partition_id().cast("long")), "slices")
        return cut.unionByName(self.rest(df).withColumn("_piece", F.lit(0).cast("long")))

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(self.side(), list(self.keys), "left_semi")

    def rest(self, df: DataFrame) -> DataFrame:
        return df.join(self.side(), list(self.keys), "left_anti")


def find_hot_keys(
    df: DataFrame, keys: list[str], order: str, hot_rows: int | None = None
) -> HotKeys | None:
    """Hot groups of ``df``, or None (the usual case). Runs counts only; collects no rows."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if df.count() <= limit:
        return None
    pieces = F.ceil(F.count("*") / F.lit(limit)) * SLACK
    hot = materialize(
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), pieces.alias("_pieces"))
        .where(F.col("_n") > limit),
        "hot_keys",
    )
    # Two numbers, not rows.
    rows, total = hot.agg(F.count("*"), F.sum("_pieces")).first()
    return HotKeys(tuple(keys), order, hot, rows, total) if rows else None


def join_per_key(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    hot: HotKeys | None,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Equi join on ``keys`` (plus ``condition``) that no hot key can send to one task.

    Columns other than the keys must differ in name. For hot keys the left rows get a salt and
    the right rows one copy per salt value; all other keys join as they are.
    """
    if hot is None:
        on = keys
    else:
        on = [*keys, "_salt"]
        many = F.coalesce(F.col("_pieces"), F.lit(1).cast("long"))
        names = rows.columns
        rows = rows.join(hot.side("_pieces"), list(hot.keys), "left")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), many)).drop("_pieces")
        other = other.join(hot.side("_pieces"), list(hot.keys), "left")
        other = other.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
        ).drop("_pieces")
    if condition is None:
        return rows.join(other, on, how).drop("_salt")
    left, right = rows.alias("l"), other.alias("r")
    equal = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    joined = left.join(right, [*equal, condition], how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_salt")
    kept = [F.col(f"l.{c}") for c in rows.columns if c != "_salt"]
    return joined.select(*kept, *[F.col(f"r.{c}") for c in other.columns if c not in on])
