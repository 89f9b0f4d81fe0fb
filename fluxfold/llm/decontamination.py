"""Operator 10: benchmark passages in training texts, found by spaced seeds.

A seed is a hash of the words at the ones of a fixed mask; the zeros are positions that may
differ. The masks below find every 13-word window that has at most two substituted words (checked
by a test). The benchmark is the stated query set: its words are taken in blocks of bounded size,
and every block meets all documents inside Arrow tasks, so no text is shuffled and no task grows
with a hot passage. Every seed that matches fixes an alignment of item and text; there the words
are compared one by one, and the windows with enough equal words make up the overlap.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. Items of 8 to
12 words must be there with as large a share of equal words as a window (one substitution in 8 or 9
words, two in 10 to 12); a shorter mask finds each such place. Items of 3 to 7 words must be there
word for word and are found by the hash of all their words. One or two words (or null text) are
everyday language, not a passage, and find nothing. Null texts have no overlap, repeated rows are
judged each, empty tables give empty results, and other columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import text_slices
from fluxfold.llm.words import ALPHANUMERIC, hash_words, windows

#: Ones are compared, zeros may differ. A substitution spoils at most three of the places of
#: ``SHORT_MASK``, which has five in 8 words and seven in 10.
MASKS = ("11101011", "11001111")
SHORT_MASK = "1101"
WINDOW = 13
MIN_MATCH = 0.8
#: Items below ``EXACT_BELOW`` words are compared whole, word for word.
EXACT_BELOW = 8
MIN_ITEM_WORDS = 3
ALL_MASKS = (*MASKS, SHORT_MASK, *("1" * n for n in range(MIN_ITEM_WORDS, EXACT_BELOW)))
#: Characters of benchmark text that are handed to the tasks at once.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22


class Block(NamedTuple):
    """The seeds of a bounded part of the benchmark, sorted by hash."""

    words: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    seeds: np.ndarray
    seed_items: np.ndarray
    seed_places: np.ndarray
    present: np.ndarray
    #: The masks (positions in ALL_MASKS) that have seeds here.
    masks: tuple[int, ...]


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _seeded(hashes: np.ndarray, k: int) -> np.ndarray:
    return windows(hashes, _offsets(ALL_MASKS[k])) + np.uint64(k)


def _masks_of(n_words: int) -> list[int]:
    """The masks that find an item of so many words, as positions in ALL_MASKS."""
    if n_words < MIN_ITEM_WORDS:
        return []
    if n_words < EXACT_BELOW:
        return [ALL_MASKS.index("1" * n_words, len(MASKS) + 1)]
    return [len(MASKS)] if n_words < WINDOW else list(range(len(MASKS)))


def make_block(items: list[tuple[int | None, str | None]]) -> Block:
    words = hash_words([text for _, text in items], ALPHANUMERIC)
    seeds, owners, places = [], [], []
    used: set[int] = set()
    for i in range(len(items)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        for k in _masks_of(len(own)):
            found = _seeded(own, k)
            used.add(k)
            seeds.append(found)
            owners.append(np.full(len(found), i))
            places.append(np.arange(len(found)))
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owners, places)]
    order = np.argsort(flat[0], kind="stable")
    present = np.zeros(1 << _FILTER_BITS, bool)
    seeds_sorted = flat[0][order].astype(np.uint64)
    present[(seeds_sorted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    ids = np.array([-1 if i is None else i for i, _ in items], np.int64)
    return Block(
        words.hashes, words.bounds, ids, seeds_sorted, flat[1][order], flat[2][order], present, tuple(sorted(used))
    )


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list:
    """The benchmark cut into parts of at most about ``BLOCK_CHARS``, each a broadcast variable."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // BLOCK_CHARS) + 1
    parts = range(n) if total else []
    for part in parts:
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == part).collect()
        yield spark.sparkContext.broadcast(make_block([(r["id"], r["text"]) for r in rows]))


class Overlap(NamedTuple):
    item: int
    start: int
    length: int
    n_equal: int


def _aligned(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Start in the text, length and equal words of the overlap at one alignment."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(WINDOW, len(item))
    if last - first < size:
        return None
    equal = doc[first + shift : last + shift] == item[first:last]
    sums = np.concatenate([[0], np.cumsum(equal)])
    needed = MIN_MATCH * size if size >= EXACT_BELOW else size
    good = np.flatnonzero(sums[size:] - sums[:-size] >= needed)
    if not len(good):
        return None
    begin, end = int(good[0]), int(good[-1]) + size
    return first + shift + begin, end - begin, int(sums[end] - sums[begin])


def overlaps(block: Block, texts: list[str | None]) -> list[list[Overlap]]:
    """Per text, one overlap for every item and alignment that passes."""
    words = hash_words(texts, ALPHANUMERIC)
    out: list[list[Overlap]] = [[] for _ in texts]
    candidates = [np.zeros((0, 3), np.int64)]
    for k in block.masks:
        found = _seeded(words.hashes, k)
        maybe = np.flatnonzero(block.present[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(block.seeds, found[maybe], "left")
        high = np.searchsorted(block.seeds, found[maybe], "right")
        many = high - low
        at = np.repeat(maybe, many)
        # Seeds that several items or places share are all followed.
        seed = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        text = np.searchsorted(words.bounds, at, "right") - 1
        # A window must not run over the end of its text.
        inside = at + len(ALL_MASKS[k]) <= words.bounds[text + 1]
        at, seed, text = at[inside], seed[inside], text[inside]
        shift = at - words.bounds[text] - block.seed_places[seed]
        candidates.append(np.stack([text, block.seed_items[seed], shift], axis=1))
    for t, i, shift in np.unique(np.concatenate(candidates), axis=0):
        doc = words.hashes[words.bounds[t] : words.bounds[t + 1]]
        item = block.words[block.bounds[i] : block.bounds[i + 1]]
        passed = _aligned(doc, item, int(shift))
        if passed:
            out[t].append(Overlap(int(block.ids[i]), *passed))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``key``, item_id, start_word, n_words, n_equal: one row per overlap of a row and an item."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id long, start_word long, n_words long, n_equal long"
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    result = None
    for block in blocks(benchmark, item_key, item_text):

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                found = overlaps(block.value, batch.column(1).to_pylist())
                rows = np.array([i for i, f in enumerate(found) for _ in f], np.int64)
                flat = np.array([o for f in found for o in f], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *(pa.array(flat[:, c]) for c in range(4))],
                    ["key", "item_id", "start_word", "n_words", "n_equal"],
                )

        part = source.mapInArrow(find, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.withColumnRenamed("key", key)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns; no shuffle."""
    for block in blocks(benchmark, item_key, item_text):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, text):
                column = batch.column(batch.schema.get_field_index(text))
                found = overlaps(block.value, column.to_pylist())
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
