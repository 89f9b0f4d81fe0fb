"""Incremental ingestion: each run takes the files no earlier run has taken.

The checkpoint of the stream is the record of processed files; it and the sink commit together,
so a failed run repeats nothing that was committed and loses nothing that was not. Segments without
gaps can be kept up to date in the same way, as session windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
MICROS_A_DAY = 86_400_000_000


def ingest_available(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    format: str = "binaryFile",
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_per_batch: int = 10_000,
) -> None:
    """Append everything new under ``source`` to the parquet table ``output``, then stop."""
    reader = spark.readStream.format(format).option("maxFilesPerTrigger", files_per_batch)
    reader = reader.schema(FILE_SCHEMA if schema is None else schema)
    query = (
        transform(reader.load(source))
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def gap_segments(
    observations: DataFrame, gap: float = 0.75, delay: str | None = None, keys: tuple[str, ...] = ("target_id", "quarter")
) -> DataFrame:
    """Segments without a gap, from a batch or a stream: keys, start, end, n_points.

    A session window per key: it grows while observations are at most ``gap`` days apart, in
    whatever order they come. With ``delay`` (a watermark, for a stream) a segment is final, and
    leaves the state, once observations more than ``gap`` and ``delay`` later have been seen; rows
    that come later still are dropped, as the watermark says. State is one row per open segment.
    Times are days, exact to a microsecond. A missing time belongs to no segment.
    """
    if gap <= 0:
        raise ValueError(f"gap must be > 0, got {gap}")
    moment = F.timestamp_micros(F.round(F.col("time") * MICROS_A_DAY).cast("long"))
    rows = observations.where(F.col("time").isNotNull()).withColumn("moment", moment)
    if delay is not None:
        rows = rows.withWatermark("moment", delay)
    window = F.session_window("moment", f"{round(gap * MICROS_A_DAY)} microseconds")
    grouped = rows.groupBy(*keys, window.alias("session")).agg(
        F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n_points")
    )
    return grouped.drop("session")


def stream_gap_segments(
    spark: SparkSession, source: str, output: str, checkpoint: str, schema: T.StructType,
    gap: float = 0.75, delay: str = "0 seconds", format: str = "parquet", files_per_batch: int = 10_000,
) -> None:
    """Append the segments that the new files under ``source`` complete to ``output``, then stop.

    Open segments stay in the checkpoint and go on with the files of the next run.
    """
    reader = spark.readStream.format(format).schema(schema)
    rows = reader.option("maxFilesPerTrigger", files_per_batch).load(source)
    query = (
        gap_segments(rows, gap, delay)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
