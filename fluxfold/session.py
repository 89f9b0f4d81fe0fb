"""Session settings the jobs are written for, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may be split even when a later step then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(cores: str = "*", partitions: int = 8, app: str = "fluxfold") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in CLUSTER_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the session was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fluxfold-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, os.path.join(root.name, file.relative_to(root)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may do without; it gets a temporary folder.
    Elsewhere executors would write to disks that the others cannot see, so this raises.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {context.master})")
    folder = tempfile.mkdtemp(prefix="fluxfold-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/fluxfold/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors. Later readers keep column pruning and
    filter pushdown, which a checkpointed row format would lose.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What opening a file of a few KB costs, in bytes read: at Spark's 4 MB a task has four files.
SMALL_FILE_COST = 64 << 10


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, tasks over folders of very many small files have many files each, such folders
    are listed by a few tasks a core, as the driver keeps something of every task, and what was listed
    goes with the table that needed it, not into the cache of file states."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    wanted = {
        "spark.sql.files.openCostInBytes": str(SMALL_FILE_COST),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks),
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
