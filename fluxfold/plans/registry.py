"""The query catalogue: Spark queries over the test tables and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.plans.adapters import with_tables
from fluxfold.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the derived tables named in ``tables``."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql) if tables else sql.strip()
        return function

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded to 6 digits, integers as BIGINT."""
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def cols(text: str) -> str:
    """SQL select list; a leading ``~`` rounds the column, ``#`` casts it to BIGINT."""
    out = []
    for name in text.split():
        if name[0] == "~":
            out.append(f'round("{name[1:]}", 6) AS "{name[1:]}"')
        elif name[0] == "#":
            out.append(f'CAST("{name[1:]}" AS BIGINT) AS "{name[1:]}"')
        else:
            out.append(f'"{name}"')
    return ", ".join(out)


def fold(time: str, epoch: str, period: str) -> str:
    """SQL of the folded time, with the sign rule spelled out."""
    x = f"({time} + ({period} / 2.0::DOUBLE - {epoch}))"
    rest = f"({x} % {period})"
    return (
        f"((CASE WHEN {rest} < 0 THEN ({rest} + {period}) % {period} ELSE {rest} END)"
        f" - {period} / 2.0::DOUBLE)"
    )
