"""Folder trees listed and files read by the workers themselves.

Spark's file reader holds the status of every file, and a plan entry for it, on the driver. Here
the names stay in tables: a level of the tree is one job, and files are read by their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit

import pandas as pd
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.session import materialize

# Names of a folder that are handed on as one frame.
FRAME_NAMES = 50_000
# Files read are handed on in chunks of about this size.
CHUNK_BYTES = 16 << 20
# Stores whose paths do not begin with the host or bucket.
ROOTED = ("file", "hdfs", "viewfs")


def _quoted(path: str) -> str:
    """The path as Hadoop writes it in a URI."""
    return re.sub(r"[^\w!.~'()*,;:$&+=/@\-\u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def _place(uri: str) -> str:
    """Where the file library finds a URI within its store."""
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ROOTED else parts.netloc + unquote(parts.path)


def _store(stores: dict[tuple[str, str], fs.FileSystem], uri: str) -> fs.FileSystem:
    parts = urlsplit(uri)
    key = (parts.scheme, parts.netloc)
    if key not in stores:
        stores[key] = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")[0]
    return stores[key]


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over as well."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def worker_uris(spark: SparkSession, inputs: str | Sequence[str]) -> list[str] | None:
    """The inputs as URIs that the workers' file library can list; None where one of them is
    a pattern, is not there or is in a store that only Spark's readers reach."""
    out = []
    for one in [inputs] if isinstance(inputs, str) else inputs:
        if re.search(r"[*?\[\]{}\\]", one):
            return None
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(one)
            full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
            uri = f"{full.getScheme()}://{full.getAuthority() or ''}{_quoted(full.getPath())}"
            store, place = fs.FileSystem.from_uri(uri)
            if place != _place(uri) or store.get_file_info([place])[0].type == fs.FileType.NotFound:
                return None
        except (Py4JError, OSError, ValueError, NotImplementedError):
            return None
        out.append(uri.rstrip("/"))
    return out


def list_files(spark: SparkSession, uris: Sequence[str], glob: str) -> DataFrame:
    """``path`` of the files below ``uris`` whose names match ``glob``; one job per level of
    folders, and a worker holds the names of one folder."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores: dict[tuple[str, str], fs.FileSystem] = {}
        wanted = re.compile(pattern, re.DOTALL)
        for batch in batches:
            for uri in batch["path"]:
                store, place, below = _store(stores, uri), _place(uri), uri
                infos = store.get_file_info([place])
                if infos[0].type == fs.FileType.File:
                    below = uri.rpartition("/")[0]
                else:
                    infos = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
                for begin in range(0, len(infos), FRAME_NAMES):
                    seen = [i for i in infos[begin : begin + FRAME_NAMES] if not _hidden(i.base_name)]
                    rows = [
                        (f"{below}/{_quoted(i.base_name)}", i.type == fs.FileType.Directory) for i in seen
                        if i.type == fs.FileType.Directory
                        or (i.type == fs.FileType.File and wanted.fullmatch(i.base_name))
                    ]
                    yield pd.DataFrame(rows, columns=["path", "is_folder"])

    tasks = spark.sparkContext.defaultParallelism
    level, files = spark.createDataFrame([(u,) for u in uris], "path string"), []
    while not level.isEmpty():
        found = level.repartition(tasks).mapInPandas(look, "path string, is_folder boolean")
        found = materialize(found, "listing")
        files.append(found.where(~F.col("is_folder")).select("path"))
        level = found.where("is_folder").select("path")
    every = reduce(DataFrame.union, files)
    return every.distinct() if len(uris) > 1 else every


def read_files(files: DataFrame) -> DataFrame:
    """The rows of ``files`` with the ``content`` of the file that ``path`` names, read where the
    row is: the driver lists nothing."""
    out = T.StructType([*files.schema, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores: dict[tuple[str, str], fs.FileSystem] = {}
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_dict("records"):
                store = _store(stores, row["path"])
                with store.open_input_stream(_place(row["path"]), compression=None) as file:
                    row["content"] = file.read()
                rows.append(row)
                size += len(row["content"])
                if size > CHUNK_BYTES:
                    yield pd.DataFrame(rows, columns=out.names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=out.names)

    return files.mapInPandas(read, out)
