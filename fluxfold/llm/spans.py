"""Words of byte texts with their places, and very long texts in overlapping parts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from fluxfold.llm.common import text_slices
from fluxfold.llm.words import _FACTOR, _INVERSE, _VALUES, _powers, mix

#: A longer text is cut into parts of this size, each with the words its last windows need.
PART_BYTES = 1 << 20


class Part(NamedTuple):
    row: int
    raw: bytes
    #: Windows that start at or behind this place belong to the next part.
    own: int


class Spans(NamedTuple):
    blob: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Part of each word, and whether a window that starts with the word belongs to that part.
    part: np.ndarray
    own: np.ndarray


def cut(row: int, raw: bytes, space: re.Pattern, ahead: int, size: int = PART_BYTES) -> Iterator[Part]:
    """``raw`` in parts cut at ``space``, each followed by the next ``ahead`` words."""
    start = 0
    while len(raw) - start > size:
        here = space.search(raw, start + size)
        if here is None:
            break
        end = stop = here.end()
        for _ in range(ahead + 1):
            following = space.search(raw, stop)
            # Several separators in a row only make the lookahead shorter than a word.
            while following is not None and following.start() == stop:
                stop = following.end()
                following = space.search(raw, stop)
            stop = len(raw) if following is None else following.start()
        yield Part(row, raw[start:stop], end - start)
        start = end
    yield Part(row, raw[start:], len(raw) - start)


def part_slices(
    batches: Iterator[pa.RecordBatch], column: str, space: re.Pattern, ahead: int
) -> Iterator[tuple[pa.RecordBatch, list[Part], bool]]:
    """The batches in slices; a very long text is a slice that comes part by part, with True as long
    as more of it follow."""
    for batch in text_slices(batches, column):
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if len(raw) == 1 and len(raw[0]) > PART_BYTES:
            last = None
            for part in cut(0, raw[0], space, ahead):
                if last is not None:
                    yield batch, [last], True
                last = part
            yield batch, [last], False
        else:
            yield batch, [Part(i, r, len(r)) for i, r in enumerate(raw)], False


def word_spans(parts: list[Part], table: bytes) -> Spans:
    """Words of every part as 64-bit hashes, with places in ``blob``, all parts one after another."""
    blob = b" ".join(p.raw for p in parts) + b" "
    sizes = np.array([len(p.raw) + 1 for p in parts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    letters = np.frombuffer(blob.translate(table), np.uint8)
    inside = np.empty(len(letters) + 1, bool)
    inside[0] = False
    np.not_equal(letters, 0x20, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(letters) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[letters] * _powers(_FACTOR, len(letters)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(letters))[starts])
    part = np.searchsorted(firsts, starts, "right") - 1
    own = starts < (firsts + np.array([p.own for p in parts], np.int64))[part]
    return Spans(np.frombuffer(blob, np.uint8), hashes, starts, ends, part, own)
