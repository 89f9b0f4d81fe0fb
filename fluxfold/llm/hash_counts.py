"""Counts of 64-bit hashes over a whole corpus: packed by hash range, added up per range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "part int, size int, hashes binary, counts binary"
#: Entries packed at once by a task.
PACK_ENTRIES = 2_000_000
#: Tasks at most; beyond, a task takes several ranges one after another.
MAX_TASKS = 50_000
#: Bits of a filter: 8 to 16 for each hash, within these bounds.
FILTER_BITS = (1 << 16, 1 << 28)


def sum_counts(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the sum of their counts (or how often each stands there)."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    if counts is None:
        ordered = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        ordered, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if counts is None:
        return ordered[first], np.diff(np.append(first, len(ordered)))
    return ordered[first], np.add.reduceat(counts.astype(np.int64), first)


class HashFilter:
    """A bounded set of hashes with two bits for each; it may hold more than was put in."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def of(hashes: DataFrame) -> HashFilter:
        """Built by Spark; what comes to the driver is bounded by ``FILTER_BITS``."""
        n = hashes.count()
        bits = min(max(1 << (8 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        mask = bits - 1
        places = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
        one = F.lit(1).cast("long")
        words = (
            hashes.select(places.alias("at"))
            .groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
            .toArrow()
        )
        table = np.zeros(bits >> 6, np.int64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return HashFilter(bits, table.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        found = np.ones(len(hashes), bool)
        for shift in (np.uint64(0), np.uint64(32)):
            at = (hashes >> shift) & mask
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


class Packer:
    """Gathers hashes of several sizes and packs their counts by hash range."""

    def __init__(self, parts: int) -> None:
        # Ranges of the upper 32 bits; the lower end of each.
        self.edges = (np.arange(parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)
        self.held: dict[int, list[np.ndarray]] = {}
        self.entries = 0

    def add(self, size: int, hashes: np.ndarray) -> None:
        if len(hashes):
            self.held.setdefault(size, []).append(hashes)
            self.entries += len(hashes)

    def full(self) -> bool:
        return self.entries >= PACK_ENTRIES

    def take(self) -> pa.RecordBatch:
        rows = []
        for size, held in self.held.items():
            hashes, counts = sum_counts(np.concatenate(held))
            at = np.searchsorted(hashes >> np.uint64(32), self.edges)
            ends = np.append(at[1:], len(hashes))
            counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
            for part in np.flatnonzero(ends > at):
                low, high = at[part], ends[part]
                rows.append((int(part), size, hashes[low:high].tobytes(), counts[low:high].tobytes()))
        self.held, self.entries = {}, 0
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "size", "hashes", "counts"]
        )


def add_up(packed: DataFrame, parts: int, minimum: int) -> DataFrame:
    """size, h, n: the hashes counted ``minimum`` times or more. A task holds one range at a time
    of those that fall to it."""

    def combine(batches):
        now, held = None, {}

        def done():
            for size, pieces in held.items():
                hashes, counts = sum_counts(*(np.concatenate(p) for p in zip(*pieces, strict=True)))
                often = counts >= minimum
                n = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, size, np.int32)), pa.array(hashes[often].view(np.int64)), pa.array(counts[often])],
                    ["size", "h", "n"],
                )

        for batch in batches:
            for part, size, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from done()
                    now, held = part, {}
                held.setdefault(size, []).append((np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)))
        yield from done()

    dealt = packed.repartition(min(parts, MAX_TASKS), "part").sortWithinPartitions("part", "size")
    return dealt.mapInArrow(combine, "size int, h long, n long")


def packing_parts(docs: DataFrame, text: str, bytes_a_part: int) -> int:
    """As many ranges as the texts have this many bytes, one at least."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // bytes_a_part))
