"""Operator 6: documents packed into as few sequences of a fixed length as possible.

Every document is its ids and an end id; only documents beyond the sequence length are cut. One
pass encodes the texts and writes a row per piece. The histogram of lengths (at most one row per
length) goes to the driver, which plans the sequences (``config_lp``). A piece finds its place by
its length and its rank among the pieces of that length: ranks within a task are counted while
encoding, the tasks are added up by one window per length. No task sees more than its own rows.

A null text counts as empty and is packed as its end id; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import keep, text_slices, tidy_shuffles
from fluxfold.llm.config_lp import plan

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096


def cut_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """doc, piece, start, length, ids_crc32, task, task_rank and, if wanted, ids (uint32, binary)."""
    names = ["doc", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"]
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fluxfold.llm.tokenizing import encoder

        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_slices(batches):
            ids, counts = encode.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            rows: list[tuple] = []
            blobs = []
            for i in range(len(counts)):
                own = np.append(ids[ends[i] - counts[i] : ends[i]], end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    blob = part.tobytes()
                    n = len(part)
                    rows.append((i, piece, start, n, zlib.crc32(blob), task, seen[n]))
                    seen[n] += 1
                    blobs.append(blob if with_ids else None)
            flat = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(flat[:, 0])),
                    pa.array(flat[:, 1], pa.int32()),
                    *(pa.array(flat[:, c]) for c in range(2, 7)),
                    pa.array(blobs, pa.binary()),
                ],
                names,
            )

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(
        cut,
        f"doc {kind}, piece int, start long, length long, ids_crc32 long, task long, task_rank long, ids binary",
    )


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written table of ``cut_pieces``) with sequence_id and offset."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = keep(per_task, "length_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    groups, _ = plan(histogram, capacity)

    # One slot per group and position: which ranks of a length it takes, and where it puts them.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken = dict.fromkeys(histogram, 0)
    sequence = 0
    for group in groups:
        offset = 0
        for length in group.lengths:
            slots.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += group.count
            offset += length
        sequence += group.count
    ordered = [(length, *slot) for length in sorted(slots) for slot in slots[length]]
    table = np.array(ordered, np.int64).reshape(-1, 4)
    # Length and rank in one number; ranks stay below 2 ** 48.
    starts = (table[:, 0] << 48) + table[:, 1]
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((starts, table))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(keep(bases, "rank_bases"), ["length", "task"])
    columns = [c for c in pieces.columns if c not in ("task", "task_rank")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            slot = np.searchsorted(starts, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in columns),
                    pa.array(table[slot, 2] + rank - table[slot, 1]),
                    pa.array(table[slot, 3]),
                ],
                [*columns, "sequence_id", "offset"],
            )

    return ranked.select(*columns, (F.col("base") + F.col("task_rank")).alias("rank")).mapInArrow(
        place, f"{schema}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    with tidy_shuffles(docs.sparkSession):
        pieces = keep(cut_pieces(docs, capacity, end_id, tokenizer, key, text, with_ids), "pieces")
        placed = place_pieces(pieces, capacity).withColumnRenamed("doc", key)
    return placed if with_ids else placed.drop("ids")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (array): the sequences themselves, from pieces placed with their ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [
                np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                for parts in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(joined, pa.list_(pa.int32()))], ["sequence_id", "ids"]
            )

    return parts.mapInArrow(join, "sequence_id long, ids array<int>")
