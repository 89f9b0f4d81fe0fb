"""Operator 9: repeated byte strings across documents, by enhanced suffix arrays.

A byte of a text is removed if a string of ``MIN_BYTES`` bytes that covers it also starts in a
document with a smaller key. Suffix arrays are built where repeats can be, in three steps:

1. Equal texts are one text, that of the smallest key; a later copy goes as a whole.
2. Anchors: of every ``MIN_BYTES``-byte window the 20-byte string with the smallest hash. Equal
   windows have equal anchors, so windows whose anchor stands in one document only are done.
3. The windows of one anchor form its context, at most 80 bytes. Contexts that are equal as a whole
   need no sorting: all but those of the smallest key go. The remaining ones meet by anchor; a
   suffix array with common-prefix lengths over them is stack-scanned into the interval tree, and
   intervals with different bytes to their left are the maximal repeats, with all occurrences.

Contexts are found in one pass over the texts, packed by hash range of their anchors and compared per
range; what one task has seen of an anchor is compared before that, so a common passage is sent once
per pack.

Anchors with more than ``HEAVY`` different contexts (ends of a very common passage) are not
gathered in one task. Their contexts are parted: of two equal windows the anchor has as many bytes
before it, so windows with at most 15 bytes before it also share the 15 bytes behind it, and the others
the bytes before it. Each part of a context meets the parts with the same shared bytes, as contexts do;
parts of which there still are too many are parted again, down to single windows.

Null or empty texts and texts below ``MIN_BYTES`` bytes lose nothing. Rows with null keys lose
nothing and are no source. Rows with the same key are one document (no source for each other).
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import keep, small_arrow_batches, small_batches, text_slices, tidy_shuffles
from fluxfold.llm.hash_counts import packing_parts
from fluxfold.llm.words import mix

MIN_BYTES = 50
HEAVY = 2000
_GRAM = 20
_WINDOW = MIN_BYTES - _GRAM + 1
_WIDTH = _WINDOW - 1 + MIN_BYTES
#: Low bits of a hash that hold the position while the smallest one is looked for.
_PLACE = 22
#: Bytes of text whose contexts one hash range aims at, and contexts that a task packs at once.
RANGE_BYTES = 12 << 20
PACK_CONTEXTS = 500_000
#: Rows of a blob that is not bound to a range.
_BLOB = 50_000
#: Contexts of an anchor that has too many for one task, and the id of the row that says so.
_MANY = np.int64(1) << np.int64(40)
_LAST = np.iinfo(np.int64).max
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Tasks at most; beyond, a task takes several ranges one after another.
MAX_TASKS = 50_000


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from every position."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    at = np.ascontiguousarray(words).view("<u8").ravel()
    n = len(data) - _GRAM + 1
    return mix(
        at[:n] * np.uint64(0x9E3779B97F4A7C15)
        ^ mix(at[8 : 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        ^ (at[12 : 12 + n] >> np.uint64(32)) * np.uint64(0x165667B19E3779F9)
    )


def window_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all texts: window start and anchor position in the joined bytes, the
    hashes of the grams, and where each text starts."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    total = int(starts[-1])
    if total < MIN_BYTES:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), starts
    hashes = _gram_hashes(data[:total])
    bits = np.uint64(max(_PLACE, int(total).bit_length()))
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= _WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = _WINDOW - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchors = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.repeat(starts[1:], np.diff(starts))[: len(anchors)]
    windows = np.flatnonzero(np.arange(MIN_BYTES, MIN_BYTES + len(anchors)) <= ends)
    return windows, anchors[windows], hashes, starts


def _bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


class Contexts(NamedTuple):
    """Columns: lower 48 bits of the anchor's hash (the smallest of many: by its upper bits, the first
    ranges would get most), a hash of the context's bytes, id, start and size."""

    h: np.ndarray
    c: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(*(x[rows] for x in self))

    @staticmethod
    def of(held: list[Contexts]) -> Contexts:
        return Contexts(*(np.concatenate(x) for x in zip(*held, strict=True)))


_KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.uint8)
_NONE = Contexts(*(np.zeros(0, kind) for kind in _KINDS))


def text_contexts(ids: np.ndarray, texts: list[bytes]) -> Contexts:
    """The contexts of all anchors of some texts."""
    windows, anchors, hashes, starts = window_anchors(texts)
    if not len(windows):
        return _NONE
    # Neighbouring texts never share a run of windows: an anchor lies inside its text.
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], len(anchors)) - 1
    begin, end = windows[first], windows[last] + MIN_BYTES
    owner = np.searchsorted(starts, begin, "right") - 1
    # Four strings of 20 bytes cover the 50 to 80 bytes.
    c = (end - begin).astype(np.uint64)
    for places, weight in zip((begin, begin + _GRAM, end - 2 * _GRAM, end - _GRAM), _WEIGHTS, strict=True):
        c += hashes[places] * weight
    columns = (hashes[anchors[first]] & np.uint64((1 << 48) - 1), mix(c), ids[owner], begin - starts[owner], end - begin)
    return Contexts(*(x.astype(kind) for x, kind in zip(columns, _KINDS, strict=True)))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate([values[:1] == values[:1], values[1:] != values[:-1]]))


def compare_contexts(rows: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of contexts that stand under a smaller id as a whole; of the others, those of anchors with
    different contexts under several ids, and how many contexts their anchors have.

    A context of size 0 marks an anchor that has too many.
    """
    order = np.argsort(rows.h)
    begins = _runs(rows.h[order])
    counts = np.diff(np.append(begins, len(order)))
    order = order[np.repeat(counts > 1, counts)]
    if not len(order):
        return order, order, order
    order = order[np.lexsort((rows.ids[order], rows.c[order], rows.h[order]))]
    h, c, ids = rows.h[order], rows.c[order], rows.ids[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    head = np.flatnonzero(new)
    first = ids[head][np.cumsum(new) - 1]
    group = _runs(h[head])
    of_row = np.repeat(np.arange(len(group)), np.diff(np.append(head[group], len(order))))
    real = rows.sizes[order] > 0
    low, high = np.minimum.reduceat(ids[head], group), np.maximum.reduceat(ids[head], group)
    marked = np.minimum.reduceat(rows.sizes[order], head[group]) == 0
    contexts = np.where(marked, _MANY, np.diff(np.append(group, len(head))))
    later = real & (ids > first)
    leading = real & (ids == first) & ((low < high) | marked)[of_row]
    return order[later], order[leading], contexts[of_row[leading]]


def _met_contexts(base: DataFrame, parts: int, heavy: int) -> DataFrame:
    """id, s, e of contexts that stand under a smaller id as a whole (h null), and of those that are left
    to compare, with h and the number of contexts of the anchor."""
    import zstandard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        turn = TaskContext.get().partitionId()

        def squeezed(rows: Contexts) -> bytes:
            steps = np.diff(rows.ids, prepend=0)
            return squeeze(steps.tobytes() + rows.starts.tobytes() + rows.sizes.tobytes())

        def blobs(rows: Contexts, anchors: bool) -> Iterator[tuple]:
            nonlocal turn
            for at in range(0, len(rows.h), _BLOB):
                some = rows.take(slice(at, at + _BLOB))
                turn += 1
                yield turn % parts, len(some.h), some.h.tobytes() if anchors else None, None, None, squeezed(some)

        def packed(rows: Contexts) -> pa.RecordBatch:
            later, leading, contexts = compare_contexts(rows)
            many = leading[contexts > heavy]
            out = [*blobs(rows.take(later), False), *blobs(rows.take(many), True)]
            kept = np.ones(len(rows.h), bool)
            kept[later] = kept[many] = False
            marks = np.unique(rows.h[many])
            rows = Contexts.of([rows.take(kept), _NONE._replace(
                h=marks, c=np.zeros(len(marks), np.uint64), ids=np.full(len(marks), _LAST),
                starts=np.zeros(len(marks), np.int32), sizes=np.zeros(len(marks), np.uint8),
            )])
            part = ((rows.h >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
            rows, part = rows.take(order), part[order]
            begins = _runs(part)
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True):
                some = rows.take(slice(begin, end))
                out.append((
                    int(part[begin]), end - begin, (some.h >> np.uint64(16)).astype(np.uint32).tobytes(),
                    (some.h & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), some.c.tobytes(), squeezed(some),
                ))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "size", "high", "low", "c", "rest"]
            )

        held, entries = [], 0
        for batch in text_slices(batches):
            held.append(text_contexts(np.asarray(batch.column(0)), _bytes_of(batch, 1)))
            entries += len(held[-1].h)
            if entries >= PACK_CONTEXTS:
                yield packed(Contexts.of(held))
                held, entries = [], 0
        if held:
            yield packed(Contexts.of(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        now, held = None, []

        def spans(rows: Contexts, contexts: np.ndarray | None) -> pa.RecordBatch:
            begin = rows.starts.astype(np.int64)
            none = contexts is None
            h = pa.nulls(len(begin), pa.int64()) if none else pa.array(rows.h.view(np.int64))
            n = pa.nulls(len(begin), pa.int64()) if none else pa.array(contexts.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows.ids), pa.array(begin), pa.array(begin + rows.sizes), h, n], ["id", "s", "e", "h", "contexts"]
            )

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = Contexts.of(held)
                held.clear()
                later, leading, contexts = compare_contexts(rows)
                yield spans(rows.take(later), None)
                yield spans(rows.take(leading), contexts)

        for batch in batches:
            for part, n, high, low, c, rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != now:
                    yield from done()
                    now = part
                rest = open_up(rest)
                ids = np.cumsum(np.frombuffer(rest, np.int64, n))
                starts = np.frombuffer(rest, np.int32, n, 8 * n)
                sizes = np.frombuffer(rest, np.uint8, n, 12 * n)
                if c is None:
                    h = np.zeros(n, np.uint64) if high is None else np.frombuffer(high, np.uint64)
                    rows = Contexts(h, h, ids, starts, sizes)
                    yield spans(rows, None if high is None else np.full(n, _MANY))
                    continue
                h = np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16)
                h |= np.frombuffer(low, np.uint16)
                held.append(Contexts(h, np.frombuffer(c, np.uint64), ids, starts, sizes))
        yield from done()

    blobs = base.mapInArrow(lambda batches: small_batches(pack(batches)), "part int, size long, high binary, low binary, c binary, rest binary")
    dealt = blobs.repartition(min(parts, MAX_TASKS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(
        lambda batches: small_batches(meet(batches)), "id long, s long, e long, h long, contexts long"
    )


def _read_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed contexts: h, size (of the anchor's group), id, start, context."""
    for batch in text_slices(batches):
        ids, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = [
            (c["h"], c["contexts"], key, c["start"], text[c["start"] : c["start"] + c["size"]])
            for key, text, own in zip(ids, _bytes_of(batch, 1), lists, strict=True)
            for c in own
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["h", "contexts", "id", "start", "context"],
        )


def enhanced_suffix_array(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of at least ``MIN_BYTES`` bytes: context, offset, and the length that each
    has in common with the one before it."""
    lengths = np.array([len(c) for c in contexts])
    counts = lengths - MIN_BYTES + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.zeros((len(contexts), _WIDTH * 2), np.uint8)
    for i, context in enumerate(contexts):
        padded[i, : len(context)] = np.frombuffer(context, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH, axis=1)[owner, offset]
    keys = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort(keys.T[::-1])
    owner, offset, rows = owner[order], offset[order], rows[order]
    left = lengths[owner] - offset
    common = np.zeros(len(owner), np.int64)
    differs = rows[1:] != rows[:-1]
    where = differs.argmax(axis=1)
    where[~differs.any(axis=1)] = _WIDTH
    common[1:] = np.minimum(where, np.minimum(left[1:], left[:-1]))
    return owner, offset, common


def maximal_repeats(contexts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, contexts and offsets of every maximal repeat of at least ``MIN_BYTES`` bytes.

    One stack scan over the common-prefix lengths visits the interval tree bottom-up; an interval
    is kept if its occurrences have different bytes to their left (or none in their context).
    """
    owner, offset, common = enhanced_suffix_array(contexts)
    left = [
        contexts[c][o - 1] if o else -1 - c for c, o in zip(owner.tolist(), offset.tolist(), strict=True)
    ]
    # Places up to which all bytes to the left are equal, counted back from each position.
    change = np.zeros(len(left), np.int64)
    if len(left):
        values = np.array(left)
        change[1:] = np.cumsum(values[1:] != values[:-1])
    stack: list[tuple[int, int]] = []  # common length, first position
    inside = np.flatnonzero(common >= MIN_BYTES)
    if not len(inside):
        return
    lengths = common.tolist()
    breaks = np.flatnonzero(np.diff(inside) > 1)
    begins = inside[np.concatenate([[0], breaks + 1])]
    ends = inside[np.concatenate([breaks, [len(inside) - 1]])] + 1
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        for i in range(begin, end + 1):
            length = lengths[i] if i < end else 0
            start = i - 1
            while stack and stack[-1][0] > length:
                deep, start = stack.pop()
                if change[i - 1] > change[start]:
                    yield deep, owner[start:i], offset[start:i]
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, start))


def _repeat_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, s, e of the repeated strings of a task's anchors; rows come sorted by anchor."""
    held: list[pa.RecordBatch] = []

    def solve(part: pa.Table) -> pa.RecordBatch:
        ids, starts = np.asarray(part["id"]), np.asarray(part["start"])
        contexts = part["context"].to_pylist()
        spans = [np.zeros((0, 3), np.int64)]
        for length, which, offsets in maximal_repeats(contexts):
            keys = ids[which]
            later = keys > keys.min()
            begin = (starts[which] + offsets)[later]
            spans.append(np.stack([keys[later], begin, begin + length], axis=1))
        found = np.unique(np.concatenate(spans), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], ["id", "s", "e"])

    def ready(final: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        h = np.asarray(table["h"])
        cut = len(h) if final else int(np.searchsorted(h, h[-1]))
        if cut:
            yield solve(table.slice(0, cut))
        if cut < len(h):
            held.extend(table.slice(cut).to_batches())

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * HEAVY:
                yield from ready(False)
                rows = sum(b.num_rows for b in held)
    if held:
        yield from ready(True)


def _part_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts whose windows have ``least`` to ``most`` bytes before the anchor, in two halves of that
    range: h (a hash of the bytes all windows of a half share), c, id, start, context, least, most."""
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, begins, contexts, leasts, mosts = (c.to_pylist() for c in batch.columns)
        windows, anchors, _, starts = window_anchors(contexts)
        places = (anchors[np.searchsorted(windows, starts[:-1])] - starts[:-1]).tolist()
        rows = []
        for key, start, context, least, most, place in zip(ids, begins, contexts, leasts, mosts, places, strict=True):
            middle = (least + most + 1) // 2
            for low, high in ((least, middle - 1), (middle, most)):
                first = max(place - high, 0)
                end = min(place - low + MIN_BYTES, len(context))
                if end - first < MIN_BYTES:
                    continue
                shared = context[place - low : place - high + MIN_BYTES] + bytes([low, high])
                own = context[first:end]
                digests = (hashlib.blake2b(x, digest_size=8).digest() for x in (shared, own))
                h, c = (int.from_bytes(d, "little", signed=True) for d in digests)
                rows.append((h, c, key, start + first, own, low, high))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "c", "id", "start", "context", "least", "most"]
        )


def _parted(heavy: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The spans (id, s, e) of parts that stand under a smaller id as a whole, and the parts left to
    compare, all of groups of ``limit`` contexts or fewer.

    Every round halves the range of a part; parts of single windows are equal as a whole.
    """
    known, left = [], []
    heavy = heavy.withColumns({"least": F.lit(0), "most": F.lit(MIN_BYTES - _GRAM)})
    schema = "h long, c long, id long, start long, context binary, least int, most int"
    while True:
        halves = heavy.select("id", "start", "context", "least", "most").mapInArrow(_part_contexts, schema)
        halves = keep(halves, "parted_contexts")
        # Both hashes together tell parts apart by 128 bits.
        firsts = keep(halves.groupBy("h", "c").agg(F.min("id").alias("first")), "first_parts")
        compared = keep(halves.join(firsts.hint("merge"), ["h", "c"]), "compared_parts")
        end = F.col("start") + F.length("context")
        known.append(compared.where("id > first").select("id", F.col("start").alias("s"), end.alias("e")))
        groups = (
            firsts.groupBy("h")
            .agg(F.count("*").alias("contexts"), F.min("first").alias("low"), F.max("first").alias("high"))
            .where("low < high")
            .select("h", "contexts")
        )
        rest = keep(compared.where("id = first").join(keep(groups, "open_parts").hint("merge"), "h"), "left_parts")
        left.append(rest.where(F.col("contexts") <= limit).select("h", "id", "start", "context"))
        heavy = rest.where(F.col("contexts") > limit)
        if heavy.isEmpty():
            return reduce(DataFrame.union, known), reduce(DataFrame.union, left)


def repeated_spans(base: DataFrame) -> DataFrame:
    """id, s, e of byte spans that also stand under a smaller id; ``base``: id long, text binary."""
    parts = packing_parts(base, "text", RANGE_BYTES)
    met = keep(_met_contexts(base, parts, HEAVY), "met_contexts")
    spans = met.where("h IS NULL").select("id", "s", "e")
    own = F.struct("h", "contexts", F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("size"))
    wanted = met.where("h IS NOT NULL").groupBy("id").agg(F.collect_list(own).alias("own"))
    cut = keep(
        base.join(wanted.hint("merge"), "id")
        .select("id", "text", "own")
        .mapInArrow(_read_contexts, "h long, contexts long, id long, start long, context binary"),
        "context_bytes",
    )
    light = cut.where(F.col("contexts") <= HEAVY).select("h", "id", "start", "context")
    heavy = cut.where(F.col("contexts") > HEAVY)
    if not heavy.isEmpty():
        whole, parted = _parted(heavy, HEAVY)
        spans, light = spans.union(whole), light.union(parted)
    found = light.repartition("h").sortWithinPartitions("h").mapInArrow(_repeat_spans, "id long, s long, e long")
    return spans.union(keep(found, "repeat_spans"))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = _bytes_of(batch, 1)
        begins, ends, copies = (batch.column(c).to_pylist() for c in (2, 3, 4))
        rows = []
        for text, s, e, copy in zip(texts, begins, ends, copies, strict=True):
            spans = _union(list(zip(s or (), e or (), strict=True)))
            if copy and len(text) >= MIN_BYTES:
                spans = [(0, len(text))]
            digest, at = hashlib.sha256(), 0
            for begin, end in spans:
                digest.update(text[at:begin])
                at = end
            digest.update(text[at:])
            rows.append((len(text), sum(e - s for s, e in spans), len(spans), digest.hexdigest()))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in columns)],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``."""
    with tidy_shuffles(docs.sparkSession), small_arrow_batches(docs.sparkSession):
        source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
        identity = [F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length("text").alias("size")]
        known = source.select("id", *identity).where(F.col("id").isNotNull() & (F.col("size") >= MIN_BYTES))
        lowest = known.groupBy("t1", "t2", "size").agg(F.min("id").alias("low"))
        owners = keep(lowest.select(F.col("low").alias("id")).distinct(), "text_owners")
        copies = keep(
            known.join(keep(lowest, "text_lowest").hint("merge"), ["t1", "t2", "size"])
            .where(F.col("id") > F.col("low"))
            .select("id", "t1", "t2"),
            "copies",
        )
        base = keep(
            source.where(F.length("text") >= MIN_BYTES).join(owners.hint("merge"), "id", "left_semi"), "base_texts"
        )
        spans = keep(repeated_spans(base), "spans")
        merged = spans.groupBy("id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
        marks = merged.join(copies.select("id", F.lit(True).alias("copy")).distinct().hint("merge"), "id", "full")
        return keep(
            source.join(marks.hint("merge"), "id", "left")
            .select("id", "text", "s", "e", F.coalesce("copy", F.lit(False)).alias("copy"))
            .mapInArrow(_digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"),
            "substring_dedup",
        ).withColumnRenamed("id", key)
