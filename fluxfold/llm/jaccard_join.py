"""Operator 11: similarity join of documents on n-gram sets, by rare-first prefixes.

A document is the set of its distinct n-word shingles. All sets are sorted by one order, rarest
shingle first. Two sets of Jaccard similarity at the threshold share a shingle within their
prefixes, so postings of prefix shingles are joined, and a pair must pass

* the length filter: the smaller set has enough shingles for the larger,
* the positional filter: one common shingle, plus all that may follow, reach the needed overlap,
* the suffix filter: what follows is cut into 1,024 cells by hash, and an odd number of shingles in
  a cell of one set against an even number in the other's is a shingle only one of them has,

all three of which lose nothing. Every pair that is left is verified once, on the full sets.

Frequencies are exact for shingles that are not hot: texts are packed by hash range and counted per
range, which also gives the shingles of one document only, where no pair can meet. A pack
numbers its documents, so what is sent of a shingle is its place in the range and two bytes. Hot shingles
(above a count that bounds their number) come last in the order; their counts are taken
beforehand, and since a document knows how many it has, those within its prefix are known without
moving any. Equal sets are one node from the start.

Hot groups: postings of one shingle are joined with the shingle's hub first, the document with the
most company, which is linear. Only lists that then still hold several components are joined among
themselves, across components, in blocks. In the verification the hub's set is sent once per block
of its partners.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty texts have an
empty set and are linked with nothing; null keys are never linked; rows with the same key are
looked at one by one, and each is linked by its own text; ties go to the smaller key; very long texts are read in overlapping
parts of 1 MB; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import keep, small_arrow_batches, small_batches, tidy_shuffles
from fluxfold.llm.graph import components
from fluxfold.llm.hash_counts import HashFilter, sum_counts
from fluxfold.llm.spans import part_slices, word_spans
from fluxfold.llm.words import BY_SPACE, mix, windows

SHINGLE = 5
PERCENT = 80

#: Shingles of texts that one hash range aims at, and that a task gathers before it packs them.
RANGE_SHINGLES = 750_000
PACK_SHINGLES = 1_000_000
#: Documents of a pack at most; two bytes number them.
PACK_DOCUMENTS = 1 << 16
#: Hot shingles there may be: a shingle is hot above this share of all, and above a million in all.
HOT_SHINGLES = 4_000_000
HOT_COUNT = 1_000_000
#: Tasks at most; beyond, a task takes several ranges one after another.
MAX_TASKS = 50_000
#: Postings of one shingle, or partners of one document, that one block holds.
BLOCK = 512
#: Postings handed on as one batch, about.
POSTING_ROWS = 5_000
_PACKS = "part int, pack long, kind int, entries binary"
#: Kinds of rows: nodes and sizes of a pack's documents; tokens of a range; hot tokens.
_NODES, _RARE, _HOT = range(3)
_CELLS = 1024
_CELL_WORDS = _CELLS // 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a set similar enough has one: it shares percent of 100 of all n at least."""
    return n - -(-n * percent // 100) + 1


def document_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and sorted distinct shingle hashes of the texts of a slice; columns id, text."""
    before: list[np.ndarray] = []
    for batch, parts, more in part_slices(batches, "text", _SPACE, size - 1):
        spans = word_spans(parts, BY_SPACE)
        full = windows(spans.hashes, tuple(range(size)))
        bounds = np.searchsorted(spans.part, np.arange(len(parts) + 1))
        sets = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = end - start
            if n >= size:
                sets.append(np.unique(full[start : end - size + 1][spans.own[start : end - size + 1]]))
            elif n and not before and not more:
                # A hash of its own kind: a short sequence equals no shingle of a longer text.
                whole = windows(spans.hashes[start:end], tuple(range(n)))
                sets.append(mix(whole + np.uint64(n)))
            else:
                sets.append(np.zeros(0, np.uint64))
        if more:
            before.append(sets[0])
        elif before:
            yield batch.column(0).to_pylist(), [np.unique(np.concatenate([*before, sets[0]]))]
            before = []
        else:
            yield batch.column(0).to_pylist(), sets


def _node(shingles: np.ndarray) -> int:
    """64 bits that tell sets apart."""
    spread = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(mix(spread.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def _read_sets(texts: DataFrame, size: int) -> DataFrame:
    """id, n, node of every row, and rows with h, c: shingles that a task has seen often."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0

        def often():
            if not held:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            hashes, counts = sum_counts(np.concatenate(held) >> np.uint64(16))
            kept = counts >= 8
            return hashes[kept], counts[kept]

        def batch_of(ids, sets, hashes, counts):
            none, m = [None] * len(hashes), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, *none], pa.int64()),
                    pa.array([*map(len, sets), *none], pa.int64()),
                    pa.array([*map(_node, sets), *none], pa.int64()),
                    pa.array([*[None] * m, *hashes.tolist()], pa.int64()),
                    pa.array([*[None] * m, *counts.tolist()], pa.int64()),
                ],
                ["id", "n", "node", "h", "c"],
            )

        nothing = np.zeros(0, np.uint64)
        for ids, sets in document_sets(batches, size):
            yield batch_of(ids, sets, nothing, nothing)
            held += sets
            entries += sum(map(len, sets))
            if entries >= PACK_SHINGLES:
                yield batch_of([], [], *often())
                held, entries = [], 0
        yield batch_of([], [], *often())

    return texts.mapInArrow(lambda batches: small_batches(read(batches)), "id long, n long, node long, h long, c long")


def _planes(numbers: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bytes of each number, one row per byte: bytes that change little lie together."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T


def _numbers(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _range_start(part: int, parts: int) -> int:
    """Smallest token of a range."""
    return -(-(part << 32) // parts) << 16


def _place_width(parts: int) -> int:
    """Bytes of a token's place in its range."""
    return -(-((-(-(1 << 32) // parts) << 16) - 1).bit_length() // 8)


def _packs(texts: DataFrame, nodes: DataFrame, size: int, parts: int, hot) -> DataFrame:
    """part, pack, kind, entries: the sets of a task, cut by hash range of their tokens.

    A pack numbers its documents, so a document takes two bytes beside each token, however many
    ranges there are; its node and size go once, to the pack's home. Equal sets are told by the
    first key of their node: a filter leaves out nearly all copies, one that it lets through only
    makes its tokens more frequent and its postings double, which nothing behind counts on.
    """
    chosen = HashFilter.of(nodes.select(F.xxhash64("id").alias("h")))
    some_sent = texts.sparkSession.sparkContext.broadcast((chosen.bits, chosen.words))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, (hot_tokens, _) = HashFilter(*some_sent.value), hot.value
        task, packs = TaskContext.get().partitionId(), 0
        starts = np.array([_range_start(p, parts) for p in range(parts)], np.uint64)
        width = _place_width(parts)
        held: dict[int, np.ndarray] = {}
        entries = 0

        def packed():
            number, home = task << 32 | packs, (31 * task + packs) % parts
            sizes = [len(t) for t in held.values()]
            totals = np.array(sizes, np.uint32)
            rows = [(home, number, _NODES, np.array(list(held), np.int64).tobytes() + totals.tobytes())]
            tokens = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[new], owner[new]
            if len(hot_tokens):
                at = np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)
                is_hot = hot_tokens[at] == tokens
                if is_hot.any():
                    found = np.concatenate([_planes(owner[is_hot], 2), _planes(tokens[is_hot], 8)])
                    rows.append((home, number, _HOT, found.tobytes()))
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            part = ((tokens >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint32), kind="stable")
            tokens, owner, part = tokens[order], owner[order], part[order]
            sent = np.concatenate([_planes(owner, 2), _planes(tokens - starts[part], width)])
            ends = np.searchsorted(part, np.arange(parts, dtype=np.uint64), "right")
            start = 0
            for p, end in enumerate(ends.tolist()):
                if end > start:
                    rows.append((p, number, _RARE, sent[:, start:end].tobytes()))
                start = end
            return _rows(_PACKS, rows)

        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(some.has(hashes)))
            for _, sets in document_sets(iter([batch]), size):
                for shingles in sets:
                    node = _node(shingles)
                    if len(shingles) and node not in held:
                        held[node] = shingles >> np.uint64(16)
                        entries += len(shingles)
                        if entries >= PACK_SHINGLES or len(held) == PACK_DOCUMENTS:
                            yield packed()
                            held, entries, packs = {}, 0, packs + 1
        if held:
            yield packed()

    known = texts.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"), "text")
    return known.mapInArrow(lambda batches: small_batches(pack(batches)), _PACKS)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of ``schema``, which has int, long and binary columns."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _shared_shingles(
    texts: DataFrame, nodes: DataFrame, size: int, parts: int, hot: np.ndarray, hot_counts: np.ndarray
) -> DataFrame:
    """part, pack, kind, entries: of every pack its nodes and sizes, and per range the shingles that
    other sets have too, with the number of those sets.

    A token is the upper 48 bits of a shingle's hash; two shingles with one token only count as
    more frequent than they are.
    """
    sent = texts.sparkSession.sparkContext.broadcast((hot, hot_counts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens, counts_of = sent.value
        now, packs, held = None, [], []

        def done():
            if not held:
                return
            sizes = [h.shape[1] for h in held]
            ends = np.cumsum(sizes)
            entries = np.concatenate(held, axis=1)
            tokens = _numbers(entries[2:])
            order = np.argsort(tokens)
            ordered = tokens[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            lengths = np.diff(np.append(first, len(ordered)))
            counts = np.empty(len(tokens), np.uint64)
            counts[order] = np.repeat(lengths, lengths)
            shared = counts > 1
            entries = np.concatenate([entries[:, shared], _planes(counts[shared], 4)])
            ends = np.cumsum(shared)[ends - 1].tolist()
            rows = [
                (now, pack, _RARE, entries[:, start:end].tobytes())
                for pack, start, end in zip(packs, [0, *ends[:-1]], ends, strict=True) if end > start
            ]
            packs.clear()
            held.clear()
            yield _rows(_PACKS, rows)

        for batch in batches:
            passed = []
            for part, pack, kind, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from done()
                    now = part
                if kind == _HOT:
                    found = np.frombuffer(entries, np.uint8).reshape(10, -1)
                    counts = counts_of[np.searchsorted(hot_tokens, _numbers(found[2:]))]
                    entries = np.concatenate([found, _planes(counts, 8)]).tobytes()
                if kind == _RARE:
                    packs.append(pack)
                    held.append(np.frombuffer(entries, np.uint8).reshape(2 + _place_width(parts), -1))
                else:
                    passed.append((part, pack, kind, entries))
            yield _rows(_PACKS, passed)
        yield from done()

    dealt = _packs(texts, nodes, size, parts, sent).repartition(min(parts, MAX_TASKS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: small_batches(meet(batches)), _PACKS)


def _postings(shared: DataFrame, parts: int, percent: int) -> DataFrame:
    """token, node, n, place (from 1 in the set's order), c0, c1, ...: the prefixes, and per posting
    which cells hold an odd number of the shingles behind it.

    Shingles of one set only come first and are not in ``shared``; all it needs is their number.
    """
    cells = [f"c{k}" for k in range(_CELL_WORDS)]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, found = None, [], []
        width = _place_width(parts)

        def done():
            if not found:
                return
            ((nodes, totals),) = heads
            owner, tokens, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((tokens, counts, owner))
            owner, tokens = owner[order].astype(np.int64), tokens[order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            made, rows = [], 0
            for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
                n, own = int(totals[owner[begin]]), tokens[begin:end]
                alone = n - len(own)
                length = prefix_length(n, percent) - alone
                if length <= 0:
                    continue
                cell = (mix(own) >> np.uint64(64 - 10)).astype(np.int64)
                bits = np.zeros((len(own), _CELL_WORDS), np.uint64)
                bits[np.arange(len(own)), cell >> 6] = np.uint64(1) << (cell & 63).astype(np.uint64)
                # XOR of everything behind each place.
                behind = np.bitwise_xor.accumulate(bits[::-1], axis=0)[::-1]
                behind = np.concatenate([behind[1:], np.zeros((1, _CELL_WORDS), np.uint64)])[:length]
                m = len(behind)
                made.append((own[:m].view(np.int64), np.full(m, nodes[owner[begin]]), np.full(m, n), alone + 1 + np.arange(m), behind))
                rows += m
                if rows >= POSTING_ROWS:
                    yield batch_of(made)
                    made, rows = [], 0
            if made:
                yield batch_of(made)

        def batch_of(made):
            *columns, behind = (np.concatenate(x) for x in zip(*made, strict=True))
            words = (np.ascontiguousarray(behind[:, k]).view(np.int64) for k in range(_CELL_WORDS))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *words)], ["token", "node", "n", "place", *cells])

        for batch in batches:
            for part, pack, kind, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack != now:
                    yield from done()
                    now, heads, found = pack, [], []
                if kind == _NODES:
                    m = len(entries) // 12
                    heads.append((np.frombuffer(entries, np.int64, m), np.frombuffer(entries, np.uint32, m, 8 * m)))
                    continue
                start, places = (0, 8) if kind == _HOT else (_range_start(part, parts), width)
                planes = np.frombuffer(entries, np.uint8).reshape(2 + places + (8 if kind == _HOT else 4), -1)
                tokens = _numbers(planes[2 : 2 + places]) + np.uint64(start)
                found.append((_numbers(planes[:2]), tokens, _numbers(planes[2 + places :])))
        yield from done()

    dealt = shared.repartition(min(parts, MAX_TASKS), "pack").sortWithinPartitions("pack")
    return dealt.mapInArrow(
        lambda batches: small_batches(rank(batches)), "token long, node long, n long, place long, " + ", ".join(f"{c} long" for c in cells)
    )


def _needed(percent: int) -> Column:
    total = F.col("n_a") + F.col("n_b")
    return F.floor((percent * total + (99 + percent)) / F.lit(100 + percent))


def _similar_sizes(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _candidates(open_lists: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs a < b of different components within a token's list that pass all three filters."""
    sizes = open_lists.groupBy("token").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("salts"))
    listed = keep(open_lists.join(sizes.hint("merge"), "token"), "open_postings")
    columns = [c for c in listed.columns if c not in ("token", "salts")]
    left = listed.select(
        "token", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), *(F.col(c).alias(f"{c}_a") for c in columns)
    )
    right = listed.select(
        "token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_b") for c in columns)
    )
    rest_a, rest_b = F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")
    # This is the first common shingle of some pairs; for those, what is needed behind it:
    behind = _needed(percent) - 1
    odd = sum(F.bit_count(F.col(f"c{k}_a").bitwiseXOR(F.col(f"c{k}_b"))) for k in range(_CELL_WORDS))
    fits = (
        (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & _similar_sizes(percent)
        & (F.least(rest_a, rest_b) >= behind)
        & (rest_a + rest_b - odd >= 2 * behind)
    )
    pairs = left.join(right.hint("merge"), ["token", "salt"]).where(fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _full_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles of the documents whose id is in ``wanted`` (id, node), each node once."""
    hashed = wanted.select(F.xxhash64("id").alias("h"))
    chosen = HashFilter.of(hashed)
    sent = texts.sparkSession.sparkContext.broadcast((chosen.bits, chosen.words))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = HashFilter(*sent.value)
        for batch in batches:
            hashes = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(some.has(hashes))).select([0, 1])
            for ids, sets in document_sets(iter([batch]), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(map(_node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["id", "node", "shingles"],
                )

    found = texts.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h"))
    read = found.mapInArrow(lambda batches: small_batches(pick(batches)), "id long, node long, shingles binary")
    return read.join(wanted.hint("merge"), ["id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; the set of ``b`` is sent once per
    block of its partners."""
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("salts"))
    dealt = keep(
        pairs.join(counts.hint("merge"), "b").select("a", "b", F.pmod(F.hash("a"), F.col("salts")).alias("salt")), "pairs"
    )
    mine = sets.withColumnRenamed("node", "a").hint("merge")
    partners = dealt.join(mine, "a").select("b", "salt", F.lit(1).alias("kind"), "a", "shingles")
    heads = dealt.select("b", "salt").distinct().join(sets.withColumnRenamed("node", "b").hint("merge"), "b")
    heads = heads.select("b", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "shingles")
    rows = heads.union(partners).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for b, _, kind, a, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(shingles, np.uint64)
                if kind == 0:
                    head = own
                    continue
                short, long = sorted((own, head), key=len)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                if 100 * both >= percent * (len(own) + len(head) - both):
                    good.append((a, b))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())}
            )

    return rows.mapInArrow(check, "a long, b long")


def _several(lists: DataFrame) -> DataFrame:
    """The tokens whose lists hold more than one component."""
    ends = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return ends.where("low < high").select("token")


def similar_links(
    texts: DataFrame, nodes: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, parts: int, size: int, percent: int, block: int
) -> tuple[DataFrame, DataFrame] | None:
    """(labels, links) of the sets ``nodes`` (node, n, id): links are verified pairs that join all
    sets that links of any kind join. None where no prefix shingle is shared."""
    shared = keep(_shared_shingles(texts, nodes, size, parts, hot, hot_counts), "shared_shingles")
    made = keep(_postings(shared, parts, percent), "prefixes")
    several = keep(made.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    plain = keep(made.select("token", "node", "n").join(several.hint("merge"), "token"), "postings")
    wanted = keep(plain.groupBy("node").agg(F.sum("size").alias("company")), "candidates")
    if not wanted.limit(1).count():
        return None
    ids = keep(nodes.join(wanted.select("node").hint("merge"), "node", "left_semi").select("id", "node"), "wanted")
    sets = keep(_full_sets(texts, ids, size), "full_sets")

    scored = keep(plain.select("token", "node", "n").join(wanted.hint("merge"), "node"), "scored")
    hubs = keep(
        scored.groupBy("token").agg(F.max(F.struct("company", "node", "n")).alias("hub")).select("token", "hub.node", "hub.n"),
        "hubs",
    )
    hubs = hubs.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"))
    first = keep(
        scored.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"))
        .join(hubs.hint("merge"), "token")
        .where((F.col("a") != F.col("b")) & _similar_sizes(percent))
        .select("a", "b")
        .distinct(),
        "hub_pairs",
    )
    # Two hubs may be each other's partners; that pair is verified once.
    turned = first.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a < b")
    first = keep(first.join(turned.hint("merge"), ["a", "b"], "left_anti"), "first_pairs")
    links = keep(_verified(first, sets, percent, block), "hub_links")
    labels = components(wanted.select("node"), links)

    placed = keep(made.join(labels.hint("merge"), "node"), "placed")
    open_lists = placed.join(keep(_several(placed), "open_lists").hint("merge"), "token", "left_semi")
    tried = first.union(first.select("b", "a"))
    second = keep(
        _candidates(open_lists, percent, block).join(tried.hint("merge"), ["a", "b"], "left_anti"), "cross_pairs"
    )
    if second.limit(1).count():
        links = keep(links.union(_verified(second, sets, percent, block)), "links")
        labels = components(wanted.select("node"), links)
    return labels, links


def jaccard_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    hot_limit: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """``key``, n_shingles, component_id: one row per row of ``docs``; the component is the smallest
    key reachable over pairs of similarity ``percent`` of 100 or more."""
    texts = _texts(docs, key, text)
    with tidy_shuffles(docs.sparkSession), small_arrow_batches(docs.sparkSession):
        read = keep(_read_sets(texts, size), "read_sets")
        rows = read.where("h IS NULL").select("id", "n", "node")
        linkable = rows.where("id IS NOT NULL AND n > 0")
        nodes = keep(linkable.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n")), "nodes")
        total = linkable.agg(F.sum("n")).first()[0] or 0
        parts = max(1, -(-total // RANGE_SHINGLES))
        limit = hot_limit or max(HOT_COUNT, total // HOT_SHINGLES)
        # At most HOT_SHINGLES of them, by the limit.
        found = read.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= limit)
        table = found.orderBy("h").toArrow()
        hot = table.column("h").to_numpy().astype(np.uint64)
        hot_counts = table.column("c").to_numpy().astype(np.int64) + (1 << 40)
        linked = similar_links(texts, nodes, hot, hot_counts, parts, size, percent, block)
        named = nodes.select("node", "id")
        if linked is not None:
            labelled = named.join(linked[0].hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
            lowest = keep(labelled.groupBy("component").agg(F.min("id").alias("component_id")), "lowest")
            named = labelled.join(lowest.hint("merge"), "component").select("node", F.col("component_id").alias("id"))
        named = keep(named.withColumnRenamed("id", "component_id"), "components")
        lonely = F.col("id").isNull() | (F.col("n") == 0)
        out = rows.withColumn("node", F.when(~lonely, F.col("node")))
        return keep(
            out.join(named.hint("merge"), "node", "left").select(
                F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
            ),
            "jaccard_groups",
        )
