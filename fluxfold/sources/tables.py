"""Table scans, conversions, the download manifest and the file inventory."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.schemas import ARCHIVE_URL, CADENCE_PREFIXES

BUCKETS = 256
CONVERT_FORMATS = {".parquet": "parquet", ".json": "json"}


def scan_objects(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    mapper: Callable[[DataFrame], DataFrame] = lambda df: df,
    format: str = "parquet",
) -> DataFrame:
    """Read with a fixed schema and map to the model columns."""
    if format not in ("parquet", "json"):
        raise ValueError(f"format must be parquet or json, got {format}")
    return mapper(spark.read.format(format).schema(schema).load(paths))


def scan_parquet_table(
    spark: SparkSession, path: str, columns: Sequence[str] = (), where: str | Column | None = None
) -> DataFrame:
    """Table scan whose filter and columns reach the file reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def id_bucket(column: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


def write_by_id(
    df: DataFrame, path: str, column: str, buckets: int = BUCKETS, spread: int = 4
) -> None:
    """Write a table laid out for point reads: one directory per hash bucket of the id.

    A bucket has up to ``spread`` files, each sorted by id: a hot id is split over as many tasks,
    and a point read skips the row groups of other ids.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(spread))
    rows = df.withColumn("_bucket", id_bucket(column, buckets)).withColumn("_part", part)
    gathered = rows.repartition("_bucket", "_part").drop("_part")
    ordered = gathered.sortWithinPartitions("_bucket", column)
    ordered.write.mode("overwrite").partitionBy("_bucket").parquet(path)


def scan_by_id(
    spark: SparkSession, path: str, column: str, value: int, columns: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Point read of one id: the literal's bucket prunes the directories before any file opens."""
    bucket = F.pmod(F.xxhash64(F.lit(value).cast("long")), F.lit(buckets)).cast("int")
    rows = spark.read.parquet(path).where((F.col("_bucket") == bucket) & (F.col(column) == value))
    return rows.select(*columns) if columns else rows.drop("_bucket")


def check_output(output: str) -> str:
    for suffix, name in CONVERT_FORMATS.items():
        if output.endswith(suffix):
            return name
    raise ValueError(f"unsupported output format: {output}")


def csv_convert(
    spark: SparkSession, inputs: str | Sequence[str], output: str, schema: T.StructType,
    columns: Sequence[str] = (),
) -> DataFrame:
    """CSV files to parquet (zstd) or json with the wanted columns; returns the converted table.

    Suffix and columns are checked before a job starts; inputs that match no file fail the scan.
    """
    name = check_output(output)
    unknown = [c for c in columns if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    rows = spark.read.schema(schema).option("header", True).csv(inputs)
    rows = rows.select(*columns) if columns else rows
    writer = rows.write.mode("overwrite")
    if name == "parquet":
        writer = writer.option("compression", "zstd")
    writer.format(name).save(output)
    return spark.read.format(name).schema(rows.schema).load(output)


def target_of_path(path: Column, pattern: str = r"(?<=kplr)\d{9}") -> Column:
    """Target id in a file path without leading zeros; NULL where the pattern finds none."""
    if re.compile(pattern).groups:
        raise ValueError("the pattern must have no groups")
    found = F.regexp_replace(F.regexp_extract(path, pattern, 0), "^0+", "")
    return F.when(found != "", found)


def file_target_ids(files: DataFrame, pattern: str = r"(?<=kplr)\d{9}") -> DataFrame:
    """Files with their target; files of no target are dropped."""
    return files.withColumn("target", target_of_path(F.col("path"), pattern)).where(
        F.col("target").isNotNull()
    )


def files_per_target(files: DataFrame) -> DataFrame:
    return files.groupBy("target").agg(F.count("*").alias("n_files"))


def not_processed(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Items whose key no earlier run has recorded."""
    return items.join(processed.select(key), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not have."""
    return left.subtract(right)


def download_manifest(
    ids: DataFrame, done: DataFrame, cadence: str = "llc", base: str = ARCHIVE_URL
) -> DataFrame:
    """URLs of all files of the targets in ``ids`` minus those in ``done`` (column ``url``)."""
    if cadence not in CADENCE_PREFIXES:
        raise ValueError(f"cadence must be one of {sorted(CADENCE_PREFIXES)}, got {cadence}")
    text = F.col("target_id").cast("string")
    # lpad would cut longer ids.
    padded = F.when(F.length(text) < 9, F.lpad(text, 9, "0")).otherwise(text)
    prefixes = F.array(*[F.lit(p) for p in CADENCE_PREFIXES[cadence]])
    url = F.concat(
        F.lit(f"{base}/"), F.substring("_id", 1, 4), F.lit("/"), F.col("_id"), F.lit("//kplr"),
        F.col("_id"), F.lit("-"), F.col("prefix"), F.lit(f"_{cadence}.fits"),
    )
    every = (
        ids.select("target_id")
        .distinct()
        .select(padded.alias("_id"), F.explode(prefixes).alias("prefix"))
        .select(url.alias("url"))
    )
    return every.join(done.select("url"), "url", "left_anti")


def verify_output(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per file of a written table: its rows, read in full with the schema they should
    have, and of how many the values of all columns could be read and are not NULL.

    A file that cannot be read with that schema fails the job with its name.
    """
    rows = spark.read.schema(schema).parquet(path)
    full = F.lit(True)
    for field in schema:
        full = full & F.col(field.name).isNotNull()
    name = F.input_file_name()
    return rows.select(name.alias("file"), full.alias("full")).groupBy("file").agg(
        F.count("*").alias("n_rows"), F.count_if("full").alias("n_full")
    )
