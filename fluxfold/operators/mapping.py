"""Raw layouts to the data model and back to flat records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.functions.labels import map_label
from fluxfold.schemas import EVENT_COLUMNS, SERIES_COLUMNS, STELLAR_COLUMNS, TCE_COLUMNS

HOURS_PER_DAY = 24.0


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Physical column names to parameter names; a missing column fails at analysis."""
    return df.select(*[F.col(raw).alias(name) for raw, name in mapping.items()])


def map_stellar(raw: DataFrame) -> DataFrame:
    return rename(raw, STELLAR_COLUMNS)


def map_tces_nested(raw: DataFrame) -> DataFrame:
    """Model events: label codes and a nested ``event`` with the duration in days."""
    event = [
        (F.col(c) / F.lit(HOURS_PER_DAY) if name == "duration" else F.col(c)).alias(name)
        for c, name in EVENT_COLUMNS.items()
    ]
    return raw.select(
        *[F.col(c).alias(name) for c, name in TCE_COLUMNS.items()],
        map_label(F.col("label")).alias("label"),
        F.struct(*event).alias("event"),
    )


def map_tces(raw: DataFrame) -> DataFrame:
    return flatten_struct(map_tces_nested(raw))


def map_series(raw: DataFrame) -> DataFrame:
    """Array-valued series rows (one per target and quarter) with model names."""
    return rename(raw, SERIES_COLUMNS)


def explode_series(series: DataFrame) -> DataFrame:
    """One row per observation; NaN readings become NULL and rows without a time are dropped."""
    arrays = ("time", "flux", "centroid_x", "centroid_y")
    point = F.posexplode(F.arrays_zip(*[F.col(c) for c in arrays])).alias("pos", "point")
    rows = series.select("target_id", "quarter", point)
    return rows.select(
        "target_id",
        "quarter",
        F.col("pos").cast("long").alias("seq"),
        *[F.nanvl(F.col(f"point.{c}"), F.lit(None).cast("double")).alias(c) for c in arrays],
    ).where(F.col("time").isNotNull())


def flatten_struct(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Lift the fields of struct columns to the top level, then drop ``exclude``."""
    columns: list[Column] = []
    for field in df.schema:
        if isinstance(field.dataType, T.StructType):
            columns += [F.col(f"{field.name}.{n}").alias(n) for n in field.dataType.names]
        else:
            columns.append(F.col(field.name))
    return df.select(*columns).drop(*exclude)


def key_by(df: DataFrame, keys: list[str], name: str = "key") -> DataFrame:
    """Add the join key: the column itself for one name, a struct for several."""
    if not keys:
        raise ValueError("at least one key column is needed")
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return df.withColumn(name, key)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns})


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Left-to-right composition of DataFrame transforms."""
    return lambda df: reduce(lambda acc, step: acc.transform(step), steps, df)


def parameter_card(df: DataFrame, key: str, units: Mapping[str, str]) -> DataFrame:
    """One row per entity and numeric field: value rounded to 4 digits, and its unit if known."""
    fields = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.DoubleType)]
    unit = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return df.unpivot(key, fields, "field", "value").select(
        key, "field", F.round("value", 4).alias("value"), unit[F.col("field")].alias("unit")
    )


def secondary_events(tces: DataFrame) -> DataFrame:
    """The same events moved to their secondary phase; those without one are left out."""
    return (
        tces.where(F.col("secondary_phase").isNotNull())
        .withColumn("epoch", F.col("epoch") + F.col("secondary_phase"))
        .withColumn("secondary_phase", F.lit(None).cast("double"))
    )
