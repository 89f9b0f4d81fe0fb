"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxfold.session import fresh_path, ship_package

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
BATCH_BYTES = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Inside, Spark drops the shuffle files of a query as soon as the query has ended.

    Tables written with ``keep`` cut the lineage, so those files are not needed any more.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


#: Bytes of a batch on its way to Python or back. Arrow and Netty pool buffers of up to 4 MB and vectors
#: grow by doubling; larger ones are native memory of the JVM's threads, which keep much of it.
SMALL_BATCH = 1 << 20


@contextmanager
def small_arrow_batches(spark: SparkSession, size: int = SMALL_BATCH):
    """Inside, batches sent to Python hold about ``size`` bytes, also where single rows are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def small_batches(batches: Iterator[pa.RecordBatch], size: int = SMALL_BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, rows * size // max(batch.nbytes, 1))
        if step >= rows:
            yield batch
            continue
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``BATCH_BYTES`` of text; a longer text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 1)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
