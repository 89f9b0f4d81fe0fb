"""Lookups over series, event and star tables. All are filters that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.operators.masking import mark_transits
from fluxfold.operators.skew import HotKeys, join_per_key
from fluxfold.schemas import EVENT


def series_for_target(
    obs: DataFrame, target_id: int, quarters: Sequence[int] | None = None
) -> DataFrame:
    """Series of one target, ordered by quarter; no (or an empty) quarter list means all."""
    rows = obs.where(F.col("target_id") == target_id)
    if quarters:
        rows = rows.where(F.col("quarter").isin(*quarters))
    return order_by_period(rows)


def order_by_period(obs: DataFrame) -> DataFrame:
    return obs.orderBy("target_id", "quarter", "time", "seq")


def missing_periods(obs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested (target_id, quarter) pairs without any observation."""
    keys = ["target_id", "quarter"]
    # Distinct first: the pairs there are few per target, the rows there are not.
    return requested.join(obs.select(*keys).distinct(), keys, "left_anti")


def by_id(df: DataFrame, column: str, value: int) -> DataFrame:
    return df.where(F.col(column) == value)


def stellar_for_target(stellar: DataFrame, target_id: int) -> DataFrame:
    return by_id(stellar, "id", target_id)


def tce_by_id(tces: DataFrame, target_id: int, tce_id: int) -> DataFrame:
    return tces.where((F.col("target_id") == target_id) & (F.col("tce_id") == tce_id))


def tce_by_name(tces: DataFrame, name: str) -> DataFrame:
    if not name or not name.strip():
        raise ValueError("name must not be empty")
    return tces.where(F.col("name") == name.strip())


def tces_for_target(tces: DataFrame, target_id: int) -> DataFrame:
    return by_id(tces, "target_id", target_id)


def all_events(tces: DataFrame) -> DataFrame:
    """(target_id, tce_id, event) of every event."""
    return tces.select("target_id", "tce_id", F.struct(*EVENT.names).alias("event"))


def tce_count(tces: DataFrame) -> DataFrame:
    return tces.agg(F.count("*").alias("n"))


def unique_target_ids(df: DataFrame, column: str = "target_id") -> DataFrame:
    return df.select(F.col(column).alias("target_id")).distinct().orderBy("target_id")


def search_targets(texts: DataFrame, tces: DataFrame) -> DataFrame:
    """Target of each search ``text``: a number is a target id, anything else an event name.

    Texts that name nothing give no row.
    """
    text = F.trim("text")
    number = text.rlike("^[0-9]+$")
    queries = texts.where(F.length(text) > 0).withColumn("_text", text)
    by_number = queries.where(number).select("text", F.expr("try_cast(_text AS BIGINT)")
                                             .alias("target_id"))
    names = tces.where(F.col("name").isNotNull()).select(F.col("name").alias("_text"), "target_id")
    by_name = queries.where(~number).join(names, "_text").select("text", "target_id")
    return by_number.where(F.col("target_id").isNotNull()).unionByName(by_name)


def target_bundle(
    obs: DataFrame, tces: DataFrame, stellar: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Everything shown about targets: marked series rows with event count and star parameters.

    Restrict the inputs to one target for a single bundle; the filter reaches every scan.
    """
    counts = tces.groupBy("target_id").agg(F.count("*").alias("n_tces"))
    star = stellar.withColumnRenamed("id", "target_id")
    about = counts.join(star, "target_id", "full")
    rows = join_per_key(mark_transits(obs, tces, hot=hot), about, ["target_id"], hot, "left")
    return rows.withColumn("n_tces", F.coalesce("n_tces", F.lit(0).cast("long")))


def table_request(
    table: DataFrame, columns: Sequence[str] = (), query: str = "", order: Sequence[str] = ()
) -> DataFrame:
    """Select, filter and order request on a named table; empty parts are left out."""
    out = table.where(query.strip()) if query.strip() else table
    out = out.select(*[c.strip() for c in columns]) if columns else out
    return out.orderBy(*[c.strip() for c in order]) if order else out
