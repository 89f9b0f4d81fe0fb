"""Binary light-curve files: one decoder task per file, rows in the raw series layout."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fluxfold.schemas import RAW_SERIES

BLOCK = 2880
CARD = 80
# Decoded files are handed on in chunks of about this size.
CHUNK_BYTES = 16 << 20
# Binary table format codes of the file standard.
FORMATS = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
# The column type of each code.
COLUMN_TYPES = {
    "L": T.ByteType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(),
    "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "A": T.StringType(),
}


def _value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        return text[1 : text.rindex("'")].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def _plain(data: bytes) -> bytes:
    """The file itself; EOFError, OSError or zlib.error where its compressed form is broken."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _header(data: bytes, at: int) -> tuple[dict[str, object], int]:
    cards: dict[str, object] = {}
    while True:
        card = data[at : at + CARD].decode("ascii", "replace")
        at += CARD
        if not card or card.startswith("END "):
            return cards, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            cards[card[:8].strip()] = _value(card[10:])


def _units(data: bytes) -> Iterator[tuple[dict[str, object], int]]:
    at = 0
    while at < len(data):
        cards, start = _header(data, at)
        yield cards, start
        size = abs(int(cards.get("BITPIX", 8))) // 8 if cards.get("NAXIS") else 0
        for i in range(1, int(cards.get("NAXIS", 0)) + 1):
            size *= int(cards[f"NAXIS{i}"])
        size += int(cards.get("PCOUNT", 0)) if "XTENSION" in cards else 0
        at = start + -(-size // BLOCK) * BLOCK


def _table(data: bytes, extension: str | int) -> tuple[dict[str, object], dict[str, object], int]:
    """Cards of the primary header and of the table ``extension`` (name or number), and where its
    rows start."""
    primary = None
    for number, (cards, start) in enumerate(_units(data)):
        primary = cards if primary is None else primary
        if extension in (number, cards.get("EXTNAME")) and "TFIELDS" in cards:
            return primary, cards, start
    raise KeyError(f"no table extension {extension!r}")


def _fields(cards: dict[str, object]) -> list[tuple[str, str, int]]:
    """Name, format code and number of values of every table column."""
    out = []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = str(cards[f"TFORM{i}"]).strip()
        out.append((str(cards[f"TTYPE{i}"]).strip(), form[-1], int(form[:-1] or 1)))
    return out


def _kind(name: str, code: str, count: int) -> tuple[str, str, tuple[int, ...]]:
    """The numpy field of a column."""
    if code == "A":
        return name, f"S{count}", ()
    return name, FORMATS[code], () if count == 1 else (count,)


def decode_file(
    data: bytes, extension: str | int, columns: Sequence[str], meta: Sequence[str]
) -> dict[str, object]:
    """Primary header fields ``meta`` and table columns ``columns`` of one file, which may be
    compressed by gzip."""
    data = _plain(data)
    primary, cards, start = _table(data, extension)
    fields = [_kind(*field) for field in _fields(cards)]
    table = np.frombuffer(data, np.dtype(fields), int(cards["NAXIS2"]), start)
    return {c: primary[c] for c in meta} | {c: table[c] for c in columns}


def file_schema(
    spark: SparkSession, path: str, extension: str | int = "LIGHTCURVE",
    columns: Sequence[str] | None = None, meta: Sequence[str] = (),
) -> T.StructType:
    """The schema to decode files like the one at ``path`` with: the wanted header values, then
    the wanted table columns in file order (None: all of them).

    Raises KeyError where the file has no such extension, column or header value.
    """
    data = _plain(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
    primary, cards, _ = _table(data, extension)
    fields = _fields(cards)
    absent = set(columns or ()) - {name for name, _, _ in fields} | set(meta) - set(primary)
    if absent:
        raise KeyError(f"not in {path}: {sorted(absent)}")
    scalars = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    out = [T.StructField(c, scalars[type(primary[c])]) for c in meta]
    for name, code, count in fields:
        if columns is None or name in columns:
            kind = COLUMN_TYPES[code]
            kind = T.ArrayType(kind) if count > 1 and code != "A" else kind
            out.append(T.StructField(name, T.ArrayType(kind)))
    return T.StructType(out)


def _native(values: np.ndarray) -> np.ndarray | list[str]:
    """Values in the byte order and types of Arrow; this also releases the file."""
    if values.dtype.kind == "S":
        return [v.decode("ascii", "replace").rstrip() for v in values.tolist()]
    if values.dtype.kind == "u":
        values = values.astype(np.int16)
    values = values.astype(values.dtype.newbyteorder("="))
    return values if values.ndim == 1 else list(values)


def _card(key: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = f"'{value:<8}'"
    else:
        text = f"{value:>20}"
    return f"{key:<8}= {text}".ljust(CARD).encode("ascii")


def _pad(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % BLOCK)


def encode_file(extension: str, columns: dict[str, np.ndarray], meta: dict[str, object]) -> bytes:
    """A file with one table of double columns; the counterpart of the decoder."""
    head = {"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True} | meta
    names = list(columns)
    table = np.rec.fromarrays(
        [np.asarray(columns[c], ">f8") for c in names], dtype=[(c, ">f8") for c in names]
    )
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 8 * len(names),
             "NAXIS2": len(table), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(names)}
    for i, c in enumerate(names, 1):
        cards |= {f"TTYPE{i}": c, f"TFORM{i}": "D"}
    cards |= {"EXTNAME": extension}
    end = b"END".ljust(CARD)
    parts = (b"".join(_card(k, v) for k, v in part.items()) + end for part in (head, cards))
    return b"".join(_pad(p, b" ") for p in parts) + _pad(table.tobytes(), b"\0")


def _parts(schema: T.StructType) -> tuple[list[str], list[str]]:
    """Table columns (array fields) and header values of a schema."""
    columns = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    return columns, [f.name for f in schema if f.name not in columns]


def decode_files(
    files: DataFrame,
    extension: str | int = "LIGHTCURVE",
    schema: T.StructType = RAW_SERIES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per file from (path, content) rows: array fields are table columns, the other
    fields come from the primary header. The columns ``keep`` of ``files`` are handed on."""
    columns, meta = _parts(schema)
    keep = list(keep)
    out = T.StructType([*[files.schema[c] for c in keep], *schema])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            kept = batch[keep].to_dict("records") if keep else [{}] * len(batch)
            for content, own in zip(batch["content"], kept, strict=True):
                row = decode_file(content, extension, columns, meta)
                rows.append(own | {k: _native(v) if k in columns else v for k, v in row.items()})
                size += len(content)
                if size > CHUNK_BYTES:
                    yield pd.DataFrame(rows, columns=out.names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=out.names)

    return files.select(*keep, "content").mapInPandas(decode, out)


def broken_files(
    files: DataFrame, extension: str | int = "LIGHTCURVE", schema: T.StructType = RAW_SERIES
) -> DataFrame:
    """path and error of the files that ``decode_files`` cannot read."""
    columns, meta = _parts(schema)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    decode_file(content, extension, columns, meta)
                except (KeyError, ValueError, IndexError, TypeError, OSError, EOFError, zlib.error) as error:
                    found.append((path, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(found, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(look, "path string, error string")


def scan_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")
