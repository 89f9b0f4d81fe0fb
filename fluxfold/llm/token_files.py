"""Operator 2: token ids of all documents in key order, as wavelet-matrix shards.

The documents are range-partitioned by key and sorted; every task encodes its range and cuts it
into shards of about ``SHARD_IDS`` ids (a longer document is one shard). A shard is one file in
the format of ``wavelet``, stored as one row of a Parquet table, so any store that Spark writes to
will do and a task that is run again leaves one copy. Reading goes shard by shard.

A null text counts as empty and is its end id only; null keys come first; repeated rows are
written each; an empty table gives a table without shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import text_slices
from fluxfold.session import fresh_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_IDS = 1 << 18
_SCHEMA = "range long, shard long, keys array<long>, n_ids long, payload binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text",
) -> None:
    """Write the shards of ``docs``: range and shard give their order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fluxfold.llm.tokenizing import encoder
        from fluxfold.llm.wavelet import encode as to_file

        encode = encoder(tokenizer)
        task, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate(parts), np.concatenate(lengths)
            payload = to_file(ids, sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([payload], pa.binary()),
                ],
                ["range", "shard", "keys", "n_ids", "payload"],
            )

        for batch in text_slices(batches):
            ids, counts = encode.encode(batch.column(1).to_pylist())
            # One end id behind each document.
            ends = np.cumsum(counts) + np.arange(len(counts))
            own, ids = ids, np.full(len(ids) + len(counts), end_id, ids.dtype)
            place = np.ones(len(ids), bool)
            place[ends] = False
            ids[place] = own
            keys += batch.column(0).to_pylist()
            parts.append(ids)
            lengths.append(counts + 1)
            held += len(ids)
            if held >= SHARD_IDS:
                yield flush()
                number, held = number + 1, 0
                keys, parts, lengths = [], [], []
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key")
    )
    # The payload is compressed already.
    ordered.mapInArrow(shards, _SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """range, shard, keys, n_ids, payload and first: the ids in all shards before."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    ranges = files.groupBy("range").agg(F.sum("n_ids").alias("n"))
    # One row per range of the writer; the keys of a range follow those of all earlier ones.
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = files.select("range", "shard", "n_ids").withColumn(
        "first", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    )
    starts = numbered.join(before, "range").select("range", "shard", (F.col("first") + F.col("before")).alias("first"))
    return files.join(starts, ["range", "shard"])


def token_digests(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fluxfold.llm.wavelet import WaveletMatrix

        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(2)[row].as_py())
                ids = matrix.ids().astype("<u4")
                starts = matrix.starts
                sums = [
                    zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row].values,
                        pa.array(starts[:-1] + batch.column(1)[row].as_py()),
                        pa.array(matrix.lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    ["key", "start", "n_tokens", "ids_crc32"],
                )

    return (
        shards.select("keys", "first", "payload")
        .mapInArrow(digest, "key long, start long, n_tokens long, ids_crc32 long")
        .withColumnRenamed("key", key)
    )


def token_file_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token_files")
    write_token_files(docs, path, key=key, text=text)
    return token_digests(read_token_files(spark, path), key)
