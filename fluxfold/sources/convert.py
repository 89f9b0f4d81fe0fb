"""Conversion of raw light-curve files, resumable by target, and point reads of one id's file.

``convert_files`` joins the steps: list the files, find the target in each path, skip the targets
an earlier run has recorded, decode, gather the files of a target, write them below
``target=<id>`` and record the target. Work goes in batches of whole targets, and a batch is
written with dynamic overwrite before it is recorded, so a run that was broken off at any point
is repeated without doubled or lost rows.

The workers list and read the files by themselves (``listing``), so the driver holds no list of
them. Only patterns and stores that the workers' file library does not reach go through Spark's
reader, which keeps every file's status on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.operators.skew import find_hot_keys
from fluxfold.schemas import RAW_SERIES
from fluxfold.session import fresh_path, many_small_files, materialize
from fluxfold.sources.fits import broken_files, decode_files
from fluxfold.sources.listing import list_files, read_files, worker_uris
from fluxfold.sources.tables import file_target_ids, not_processed, target_of_path

TARGET_PATTERN = r"(?<=kplr)\d{9}"
FORMATS = ("parquet", "json")
#: Files of a batch, about; a batch holds whole targets.
BATCH_FILES = 100_000
#: Files of a target that one task writes; a target with more is spread over several.
PART_FILES = 2_000
#: Files of a batch that one task gathers and writes, about: few bytes, but much work per target.
TASK_FILES = 1_000
#: Files of the result that the driver lists at a time.
LISTED_FILES = 10_000
PROGRESS = "target string, n_files long"


class ConversionError(RuntimeError):
    """Files that could not be read; all other targets are converted and recorded."""


def _files(spark: SparkSession, inputs: str | Sequence[str], glob: str) -> DataFrame:
    """Input files by folder: one listing, where a pattern of names would be one per file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", glob).load(inputs)
    return files.withColumn("path", F.col("_metadata.file_path"))


def target_files(
    spark: SparkSession, inputs: str | Sequence[str], pattern: str = TARGET_PATTERN,
    glob: str = "*.fits",
) -> DataFrame:
    """path and target of the files below ``inputs``. Only names are read, no content; files of
    no target are dropped."""
    uris = worker_uris(spark, inputs)
    files = _files(spark, inputs, glob).select("path") if uris is None else list_files(spark, uris, glob)
    return file_target_ids(files, pattern)


def _contents(
    batch: DataFrame, inputs: str | Sequence[str], pattern: str, glob: str
) -> DataFrame:
    """path and content of the files of a batch's targets.

    Workers read the files by name. Through Spark's reader the filter is on the file name, so files
    of other targets are not opened; its list holds as many targets as a batch has files at most.
    """
    if worker_uris(batch.sparkSession, inputs) is not None:
        return read_files(batch.select("path").repartition(_tasks(batch)))
    targets = [row.target for row in batch.select("target").distinct().toLocalIterator()]
    wanted = target_of_path(F.col("_metadata.file_path"), pattern).isin(targets)
    return _files(batch.sparkSession, inputs, glob).where(wanted).select("path", "content")


def _tasks(batch: DataFrame) -> int:
    return max(batch.sparkSession.sparkContext.defaultParallelism, -(-batch.count() // TASK_FILES))


def _gathered(rows: DataFrame, batch: DataFrame, part_files: int) -> DataFrame:
    """The rows (path, target, ...) of a target in one task; those of a large one in several."""
    hot = find_hot_keys(batch, ["target"], "path", part_files)
    part = F.lit(0).cast("long")
    if hot is not None:
        rows = rows.join(hot.side("_pieces"), "target", "left")
        part = F.pmod(F.xxhash64("path"), F.coalesce("_pieces", F.lit(1)))
    parted = rows.withColumn("_part", part).repartition(_tasks(batch), "target", "_part")
    return parted.drop("_part", "_pieces")


def _write(
    batch: DataFrame, inputs: str | Sequence[str], glob: str, output: str, progress: str, pattern: str,
    schema: T.StructType, extension: str | int, format: str, part_files: int,
) -> None:
    """Decode the files of ``batch``, write them by target and record the targets."""
    if worker_uris(batch.sparkSession, inputs) is not None:
        # Only names are moved; a task reads, decodes and writes its targets.
        content = read_files(_gathered(batch.select("path", "target"), batch, part_files))
        rows = decode_files(content, extension, schema, keep=["path", "target"])
    else:
        content = _contents(batch, inputs, pattern, glob)
        rows = decode_files(content, extension, schema, keep=["path"]).withColumn(
            "target", target_of_path(F.col("path"), pattern)
        )
        rows = _gathered(rows, batch, part_files)
    (
        rows.sortWithinPartitions("target", "path")
        .select(*schema.names, "target")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("target")
        .format(format)
        .save(output)
    )
    _record(batch, progress)


def _record(batch: DataFrame, progress: str) -> None:
    done = batch.groupBy("target").agg(F.count("*").alias("n_files"))
    done.write.mode("append").parquet(progress)


def convert_files(
    spark: SparkSession,
    inputs: str | Sequence[str],
    output: str,
    progress: str,
    pattern: str = TARGET_PATTERN,
    schema: T.StructType = RAW_SERIES,
    extension: str | int = "LIGHTCURVE",
    format: str = "parquet",
    glob: str = "*.fits",
    batch_files: int = BATCH_FILES,
    part_files: int = PART_FILES,
    listed: bool = True,
) -> DataFrame | None:
    """Convert all files of targets that the table ``progress`` does not list yet; returns what
    ``output`` then holds, ``schema`` plus ``target`` (nothing without ``listed``: that table's
    folders are then not listed on the driver, and ``compacted`` reads them part by part).

    Array fields of ``schema`` are table columns of a file, the others header values. A target
    with a file that cannot be read is left out and not recorded; everything else is converted,
    then ``ConversionError`` names the first such file. The next run takes those targets again.
    ``inputs`` are folders, searched with all below them for names like ``glob``; a folder that is
    not there fails the scan, one without new targets writes nothing.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format}")
    with many_small_files(spark):
        _convert(
            spark, inputs, output, progress, pattern, schema, extension, format, glob, batch_files, part_files
        )
        return converted(spark, output, schema, format) if listed else None


def _convert(
    spark: SparkSession, inputs: str | Sequence[str], output: str, progress: str, pattern: str,
    schema: T.StructType, extension: str | int, format: str, glob: str, batch_files: int, part_files: int,
) -> None:
    # Empty appends make tables of what the first run does not find.
    spark.createDataFrame([], PROGRESS).write.mode("append").parquet(progress)
    nothing = spark.createDataFrame([], _with_target(schema)).write.mode("append")
    nothing.partitionBy("target").format(format).save(output)
    done = spark.read.schema(PROGRESS).parquet(progress).select("target").distinct()
    todo = materialize(not_processed(target_files(spark, inputs, pattern, glob), done, "target"), "files")
    batches = -(-todo.count() // batch_files)
    failed, first = 0, None
    options = (inputs, glob, output, progress, pattern, schema, extension, format, part_files)
    for number in range(batches):
        batch = todo.where(F.pmod(F.xxhash64("target"), F.lit(batches)) == number)
        if batch.isEmpty():
            continue
        try:
            _write(batch, *options)
        except (PySparkException, Py4JError):
            content = _contents(batch, inputs, pattern, glob)
            broken = materialize(broken_files(content, extension, schema), "broken")
            if broken.isEmpty():
                raise
            failed += broken.count()
            first = first or broken.orderBy("path").first()
            lost = broken.select(target_of_path(F.col("path"), pattern).alias("target")).distinct()
            rest = materialize(batch.join(lost, "target", "left_anti"), "rest")
            if not rest.isEmpty():
                _write(rest, *options)
    if failed:
        raise ConversionError(f"{failed} files could not be read, first {first.path}: {first.error}")


def converted(
    spark: SparkSession, output: str, schema: T.StructType = RAW_SERIES, format: str = "parquet"
) -> DataFrame:
    """What earlier runs have written; a filter on ``target`` opens the files of that target only."""
    return spark.read.format(format).schema(_with_target(schema)).load(output)


def compacted(
    spark: SparkSession, output: str, schema: T.StructType = RAW_SERIES, format: str = "parquet",
    part_files: int = LISTED_FILES,
) -> DataFrame:
    """The rows of ``converted``, read for about ``part_files`` files at a time and written to one
    table: the driver holds no more of the folders, however many targets there are."""
    with many_small_files(spark):
        uris = worker_uris(spark, output)
        if uris is None:
            return materialize(converted(spark, output, schema, format), "compacted")
        files = materialize(list_files(spark, uris, "*"), "files")
        table = fresh_path(spark, "compacted")
        spark.createDataFrame([], _with_target(schema)).write.parquet(table)
        reader = spark.read.format(format).schema(_with_target(schema))
        reader = reader.option("basePath", output).option("__globPaths__", False)
        parts = -(-files.count() // part_files)
        for number in range(parts):
            some = files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == number)
            # A path that is no pattern is taken as it is, without the quoting of a URI.
            paths = [unquote(row.path) for row in some.toLocalIterator()]
            if paths:
                reader.load(paths).write.mode("append").parquet(table)
        return spark.read.schema(_with_target(schema)).parquet(table)


def _with_target(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("target", T.StringType())])


# --- file-per-id layouts


def id_of_file(pattern: str | None = None) -> Column:
    """The id of the file a row comes from: what ``pattern`` finds in its path, else the stem."""
    if pattern is None:
        return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    if re.compile(pattern).groups:
        raise ValueError("the pattern must have no groups")
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 0)


def scan_file_by_id(
    spark: SparkSession, path: str, value: int | str, schema: T.StructType,
    columns: Sequence[str] = (), pattern: str | None = None, format: str = "parquet",
) -> DataFrame:
    """The rows of the one id's file (or files) in a folder with a file per id.

    The filter is on the file name, so the listing is cut before any file is opened; of the
    file, only ``columns`` are read. An unknown id gives no rows. Files without an id are never
    read: their id is the empty text, and asking for that is an error.
    """
    if str(value) == "":
        raise ValueError("the id must not be empty")
    unknown = [c for c in columns if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    rows = spark.read.format(format).schema(schema).load(path)
    return rows.where(id_of_file(pattern) == str(value)).select(*(columns or schema.names))


def scan_files_with_id(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """All rows of a file-per-id folder with their ``file_id``; filters on it choose files.

    For many ids, join this with the table of ids: one job instead of one read per id.
    """
    key = id_of_file(pattern)
    rows = spark.read.format(format).schema(schema).load(path)
    return rows.where(key != "").select(key.alias("file_id"), *schema.names)
