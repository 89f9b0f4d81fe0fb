"""Sinks: feature splits and training-record shards."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from fluxfold.session import materialize

FORMATS = ("parquet", "json", "tfrecord")


def write_feature_splits(df: DataFrame, output: str, format: str = "parquet") -> None:
    """Write rows under ``output/split=<name>``; every task writes its rows of every split.

    The unique row id is no partition column: that would make one directory per row.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format}")
    if format == "tfrecord":
        df.sparkSession.dataSource.register(TrainingRecords)
        # One run of the plan; the filters below read the written rows.
        df = materialize(df, "features")
        for split in ("train", "test", "validation"):
            rows = df.where(df["split"] == split).drop("split")
            rows.write.format("tfrecord").mode("overwrite").save(f"{output}/split={split}")
        return
    df.write.format(format).mode("overwrite").partitionBy("split").save(output)


# --- record framing: length, masked checksum of it, payload, masked checksum of it


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table.astype(np.uint32)


_TABLE = _checksum_table()


def masked_checksums(payloads: list[bytes]) -> np.ndarray:
    """Checksums of many payloads at once: one numpy step per byte position, not per byte."""
    order = np.argsort([-len(p) for p in payloads], kind="stable")
    lengths = np.array([len(payloads[i]) for i in order])
    longest = int(lengths[0]) if len(lengths) else 0
    grid = np.zeros((longest, len(payloads)), np.uint8)
    for column, i in enumerate(order):
        grid[: len(payloads[i]), column] = np.frombuffer(payloads[i], np.uint8)
    state = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    for at in range(longest):
        live = int(np.searchsorted(-lengths, -at, side="left"))
        part = state[:live]
        state[:live] = _TABLE[(part ^ grid[at, :live]) & 0xFF] ^ (part >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    masked = ((state >> 15) | (state << 17)) + np.uint32(0xA282EAD8)
    out = np.empty_like(masked)
    out[order] = masked
    return out


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def encode_example(row: Row, schema: T.StructType) -> bytes:
    """A row as a serialized training example; NULL fields are left out.

    Numbers with a fraction are stored as 32-bit floats, as the format has no doubles.
    """
    entries = []
    for value, column in zip(row, schema, strict=True):
        name, dtype = column.name, column.dataType
        if value is None:
            continue
        item = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
        values = value if isinstance(dtype, T.ArrayType) else [value]
        if isinstance(item, T.FractionalType):
            kind, body = 2, _field(1, np.asarray(values, "<f4").tobytes())
        elif isinstance(item, (T.IntegralType, T.BooleanType)):
            kind, body = 3, _field(1, b"".join(_varint(int(v)) for v in values))
        elif isinstance(item, T.StringType):
            kind, body = 1, b"".join(_field(1, v.encode()) for v in values)
        else:
            raise TypeError(f"column {name} has no training record form: {dtype}")
        entries.append(_field(1, _field(1, name.encode()) + _field(2, _field(kind, body))))
    return _field(1, b"".join(entries))


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        yield key >> 3, data[at : at + size]
        at += size


def decode_example(data: bytes, schema: T.StructType) -> tuple:
    found: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            ((kind, body),) = _fields(parts[2])
            if kind == 1:
                values = [v.decode() for _, v in _fields(body)]
            else:
                packed = dict(_fields(body)).get(1, b"")
                if kind == 2:
                    values = np.frombuffer(packed, "<f4").astype(float).tolist()
                else:
                    values, at = [], 0
                    while at < len(packed):
                        value, at = _read_varint(packed, at)
                        values.append(value - (1 << 64) if value >> 63 else value)
            found[parts[1].decode()] = values
    return tuple(
        None if c.name not in found
        else found[c.name] if isinstance(c.dataType, T.ArrayType) else found[c.name][0]
        for c in schema
    )


class TrainingRecords(DataSource):
    """Spark data source "tfrecord": one shard per task, readable shard by shard."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        raise ValueError("tfrecord needs a schema: spark.read.format('tfrecord').schema(...)")

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite)

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema)


@dataclass
class Shard(WriterCommitMessage):
    temporary: str | None
    final: str | None


class RecordWriter(DataSourceWriter):
    """Tasks write temporary shards; the commit renames those of the successful attempts only."""

    batch = 500

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.target_schema, self.overwrite = path, schema, overwrite
        self.job = uuid.uuid4().hex

    def _encoded(self, rows: Iterator[Row]) -> Iterator[bytes]:
        pending: list[bytes] = []
        for row in rows:
            pending.append(encode_example(row, self.target_schema))
            if len(pending) == self.batch:
                yield self._framed(pending)
                pending = []
        if pending:
            yield self._framed(pending)

    @staticmethod
    def _framed(payloads: list[bytes]) -> bytes:
        sizes = [struct.pack("<Q", len(p)) for p in payloads]
        checks = zip(masked_checksums(sizes), masked_checksums(payloads), strict=True)
        return b"".join(
            size + struct.pack("<I", a) + body + struct.pack("<I", b)
            for size, body, (a, b) in zip(sizes, payloads, checks, strict=True)
        )

    def write(self, iterator: Iterator[Row]) -> Shard:
        chunks = self._encoded(iterator)
        first = next(chunks, None)
        if first is None:
            return Shard(None, None)
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.tfrecord"
        with system.open_output_stream(f"{root}/_{name}") as out:
            out.write(first)
            for chunk in chunks:
                out.write(chunk)
        return Shard(f"{root}/_{name}", f"{root}/{name}")

    def commit(self, messages: list[Shard | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-"):
                    system.delete_file(info.path)
        for message in messages:
            if message is not None and message.temporary is not None:
                system.move(message.temporary, message.final)

    def abort(self, messages: list[Shard | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None and message.temporary is not None:
                system.delete_file(message.temporary)


def _records(stream, count: int) -> Iterator[tuple[bytes, int]]:
    for _ in range(count):
        head = stream.read(12)
        if not head:
            return
        (size,) = struct.unpack("<Q", head[:8])
        body = stream.read(size)
        yield body, struct.unpack("<I", stream.read(4))[0]


@dataclass
class ShardFile(InputPartition):
    path: str


class RecordReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.source_schema = path, schema

    def partitions(self) -> list[ShardFile]:
        system, root = fs.FileSystem.from_uri(self.path)
        infos = system.get_file_info(fs.FileSelector(root))
        return [ShardFile(i.path) for i in infos if i.base_name.startswith("part-")]

    def read(self, partition: ShardFile | None) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as stream:
            while batch := list(_records(stream, RecordWriter.batch)):
                bodies = [body for body, _ in batch]
                if not np.array_equal(masked_checksums(bodies), [check for _, check in batch]):
                    raise OSError(f"damaged record in {partition.path}")
                for body in bodies:
                    yield decode_example(body, self.source_schema)
