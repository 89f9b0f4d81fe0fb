"""Operator 1: near-duplicate documents by HyperMinHash sketches and full verification.

A document is the set of its distinct n-word shingles (the whole word sequence where it has fewer
words). Its sketch has 256 registers; each keeps, of the smallest hash that falls into its bucket,
the number of leading zeros and the next ten mantissa bits. Bands of five registers are hashed;
empty registers borrow, for banding only, from the filled bucket that a fixed random preference
puts first, so short texts band as surely as long ones. A pair at the threshold of 0.8 shares no
band with a probability of 2e-9. Pairs whose collision-corrected estimate lies far below the
threshold go; all others are confirmed on their full sets.

Hot groups: equal sets are one node from the start. Within a band bucket every member is compared
with the bucket's hub first (the member with the most company over all bands), which is linear.
Only buckets that still hold several components are looked at again: small ones pair by pair
across components, large ones by an exact prefix filter on the rarest shingles. Nothing is capped.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty texts have an
empty set and are linked with nothing; null keys are never linked; rows with the same key are one
document; empty tables give empty results; other columns are ignored or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import keep, text_slices, tidy_shuffles
from fluxfold.llm.graph import components
from fluxfold.llm.words import BY_SPACE, hash_words, mix, windows

SHINGLE = 5
PERCENT = 80

_BUCKET_BITS = 8
_REGISTERS = 1 << _BUCKET_BITS
_REST_BITS = 64 - _BUCKET_BITS
_MANTISSA_BITS = 10
_EMPTY = 0xFFFF
_ROWS = 5
_BANDS = _REGISTERS // _ROWS
#: Independent one-bit minimum hashes, 64 to a word; they tell far pairs in large buckets apart.
_MARK_WORDS = 32
#: Buckets up to this size are paired across components; larger ones use the prefix filter.
PAIR_BUCKET = 32

_EDGES = np.arange(_REGISTERS, dtype=np.uint64) << np.uint64(_REST_BITS)
_PREFERENCE = np.random.default_rng(11).random((_REGISTERS, _REGISTERS), dtype=np.float32)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = hash_words(texts, BY_SPACE)
    full = windows(words.hashes, tuple(range(size)))
    sets = []
    for start, end in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        n = int(end - start)
        if n >= size:
            sets.append(np.unique(full[start : end - size + 1]))
        elif n:
            # A hash of its own kind: a short sequence equals no shingle of a longer text.
            whole = windows(words.hashes[start:end], tuple(range(n)))
            sets.append(mix(whole + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit registers of one set: leading zeros, then mantissa bits; 0xFFFF is empty."""
    registers = np.full(_REGISTERS, _EMPTY, np.uint16)
    if not len(shingles):
        return registers
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    filled = at < ends
    rest = shingles[at[filled]] & np.uint64((1 << _REST_BITS) - 1)
    # frexp gives the bit length; precise enough because only the leading bits are kept.
    top = (rest >> np.uint64(8)).astype(np.float64)
    fraction, exponent = np.frexp(top)
    zeros = np.minimum((_REST_BITS - 8) - exponent, 62)
    mantissa = np.floor((fraction * 2 - 1) * (1 << _MANTISSA_BITS)).clip(0).astype(np.int64)
    registers[filled] = (zeros.astype(np.int64) << _MANTISSA_BITS | mantissa).astype(np.uint16)
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, after filling the empty registers."""
    filled = np.flatnonzero(registers != _EMPTY)
    dense = registers.astype(np.uint64)
    empty = np.flatnonzero(registers == _EMPTY)
    if len(empty):
        lender = filled[_PREFERENCE[np.ix_(empty, filled)].argmin(axis=1)]
        dense[empty] = mix(dense[lender] + (lender.astype(np.uint64) << np.uint64(20)))
    rows = dense[: _BANDS * _ROWS].reshape(_BANDS, _ROWS)
    keys = np.arange(_BANDS, dtype=np.uint64)
    for column in rows.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Collision-corrected Jaccard estimate of two sketches, and the registers it rests on."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    if not n:
        return 0.0, 0
    equal = int((filled & (a == b)).sum())
    # Chance collisions of registers, about 0.17 * 2^(p - r + 1) for sets beyond the bucket count.
    chance = 0.1699 * 2.0 ** (_BUCKET_BITS - _MANTISSA_BITS + 1)
    return max(0.0, (equal - chance) / n), n


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    one = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    two = mix(shingles + np.uint64(0x1234567887654321)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, n_shingles, k1, k2 (identity of the set), sketch, bands; one row per row of ``docs``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            registers = [sketch(s) for s in sets]
            identities = [_identity(s) for s in sets]
            bands = [band_keys(r).view(np.int64) if len(s) else [] for r, s in zip(registers, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([i[0] for i in identities], pa.int64()),
                    pa.array([i[1] for i in identities], pa.int64()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "k1", "k2", "sketch", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        make, "id long, n_shingles long, k1 long, k2 long, sketch binary, bands array<long>"
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, n, sketch, shingles of the documents in ``wanted`` (column id)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["id", "n", "sketch", "shingles"],
            )

    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(
        wanted.hint("merge"), "id", "left_semi"
    )
    return picked.mapInArrow(make, "id long, n long, sketch binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sketch_a, sketch_b, set_a, set_b = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                guess, n = estimate(np.frombuffer(sketch_a[i], np.uint16), np.frombuffer(sketch_b[i], np.uint16))
                if guess < percent / 100 - 5 * (0.25 / max(n, 1)) ** 0.5:
                    continue
                x, y = np.frombuffer(set_a[i], np.uint64), np.frombuffer(set_b[i], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())}
            )

    left = sets.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("shingles").alias("set_b"))
    return (
        pairs.hint("merge")
        .join(left, "a")
        .hint("merge")
        .join(right, "b")
        .select("a", "b", "sketch_a", "sketch_b", "set_a", "set_b")
        .mapInArrow(check, "a long, b long")
    )


def _similar_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _prefixes(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """shingle, id, component, n for the rarest shingles of each set in ``wanted``.

    Two sets that reach the threshold share one of their rarest n - ceil(n * percent / 100) + 1.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, parts = (c.to_pylist() for c in batch.columns)
            for i, n, part in zip(ids, ns, parts, strict=True):
                found = np.frombuffer(part, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"shingle": pa.array(found), "id": pa.array(np.full(len(found), i)), "n": pa.array(np.full(len(found), n))}
                )

    rows = keep(
        sets.join(wanted.select("id").hint("merge"), "id", "left_semi")
        .select("id", "n", "shingles")
        .mapInArrow(unpack, "shingle long, id long, n long"),
        "shingle_rows",
    )
    shared = keep(rows.groupBy("shingle").count().where("count > 1"), "shared_shingles")
    # Shingles of one document only come first in the order, so their number is all that matters.
    common = keep(rows.join(shared, "shingle"), "common_shingles")
    order = Window.partitionBy("id").orderBy("count", "shingle")
    ranked = common.withColumn("rank", F.row_number().over(order)).withColumn(
        "n_common", F.count("*").over(Window.partitionBy("id"))
    )
    # The shingles before this one: a pair is joined on its first common shingle only.
    ranked = ranked.withColumn(
        "before", F.collect_list("shingle").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    length = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1 - (F.col("n") - F.col("n_common"))
    marks = [f"m{k}" for k in range(_MARK_WORDS)]
    return ranked.where(F.col("rank") <= length).join(wanted, "id").select("shingle", "id", "component", "n", "before", *marks)


def _across(groups: DataFrame, by: str, percent: int) -> DataFrame:
    """Pairs a < b of a group that lie in different components and may be similar enough.

    Sizes must allow it. Where both have minimum-hash bits, the bits must too: at similarity s a
    bit differs with probability (1 - s) / 2, and five standard deviations are granted on top.
    """
    renamed = [groups.select(by, *(F.col(c).alias(c + side) for c in groups.columns if c != by)) for side in ("_a", "_b")]
    fits = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
    fits = fits & _similar_sizes("n_a", "n_b", percent)
    if "m0" in groups.columns:
        n, p = 64 * _MARK_WORDS, (1 - percent / 100) / 2
        differ = sum(F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(_MARK_WORDS))
        fits = fits & (differ <= int(n * p + 5 * (n * p * (1 - p)) ** 0.5))
    if "before" in groups.columns:
        fits = fits & ~F.arrays_overlap("before_a", "before_b")
    a, b = renamed
    joined = a.join(b, (a[by] == b[by]) & fits)
    return joined.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


_MARKS = np.random.default_rng(13).integers(1, 1 << 63, (2, 64 * _MARK_WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hash_bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of 2048 independent minimum hashes, packed into 64-bit integers."""
    low = np.full(_MARKS.shape[1], np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), 64):
        part = shingles[start : start + 64, None]
        np.minimum(low, (part * _MARKS[0] ^ _MARKS[1]).min(axis=0), out=low)
    return np.packbits((mix(low) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _marked(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, component) with its minimum-hash bits m0, m1, ..."""
    names = [f"m{k}" for k in range(_MARK_WORDS)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [min_hash_bits(np.frombuffer(x, np.uint64)) for x in batch.column(2).to_pylist()]
            flat = np.array(bits, np.int64).reshape(-1, _MARK_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(flat[:, k]) for k in range(_MARK_WORDS))],
                ["id", "component", *names],
            )

    return (
        sets.join(wanted.hint("merge"), "id")
        .select("id", "component", "shingles")
        .mapInArrow(mark, "id long, component long, " + ", ".join(f"{n} long" for n in names))
    )


def _several(groups: DataFrame, by: str) -> DataFrame:
    """The groups that hold more than one component."""
    return (
        groups.groupBy(by)
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select(by)
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``key``, n_shingles, component_id, kept: one row per row of ``docs``."""
    with tidy_shuffles(docs.sparkSession):
        made = keep(sketches(docs, key, text, size), "sketches")
        linkable = made.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
        sets_of = keep(linkable.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "set_reps")
        nodes = linkable.join(sets_of.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi")
        banded = keep(
            nodes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "bands"
        )
        buckets = keep(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        members = keep(banded.join(buckets.hint("merge"), "bucket"), "members")
        wanted = keep(members.groupBy("id").agg(F.sum("size").alias("company")), "candidates")
        sets = keep(_full_sets(docs, wanted, key, text, size), "full_sets")

        # Every member against the hub of its bucket.
        scored = keep(members.join(wanted, "id").select("bucket", "id", "n", "company"), "scored")
        hubs = keep(
            scored.groupBy("bucket")
            .agg(F.max(F.struct("company", (-F.col("id")).alias("rank"), "n")).alias("hub"))
            .select("bucket", (-F.col("hub.rank")).alias("hub"), F.col("hub.n").alias("hub_n")),
            "hubs",
        )
        first = keep(
            scored.join(hubs, "bucket")
            .where((F.col("id") != F.col("hub")) & _similar_sizes("n", "hub_n", percent))
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
            .distinct(),
            "hub_pairs",
        )
        links = keep(_confirmed(first, sets, percent), "hub_links")
        labels = components(wanted.select(F.col("id").alias("node")), links)

        # What still lies apart within a bucket.
        placed = keep(
            members.join(labels.withColumnRenamed("node", "id"), "id").select("bucket", "size", "id", "n", "component"),
            "placed",
        )
        apart = keep(placed.join(keep(_several(placed, "bucket"), "open_buckets"), "bucket", "left_semi"), "apart")
        marked = keep(_marked(sets, keep(apart.select("id", "component").distinct(), "open_ids")), "marked")
        small = keep(
            apart.where(F.col("size") <= PAIR_BUCKET).select("bucket", "id", "n").join(marked.hint("merge"), "id"),
            "small_buckets",
        )
        small = _across(small, "bucket", percent)
        large = keep(apart.where(F.col("size") > PAIR_BUCKET).select("id").distinct(), "large_buckets")
        rare = keep(_prefixes(sets, marked.join(large, "id", "left_semi"), percent), "rare_shingles")
        rare = keep(rare.join(keep(_several(rare, "shingle"), "open_shingles"), "shingle", "left_semi"), "rare_open")
        second = small.union(_across(rare, "shingle", percent)).distinct().join(first, ["a", "b"], "left_anti")
        more = keep(_confirmed(keep(second, "cross_pairs"), sets, percent), "cross_links")
        if more.limit(1).count():
            labels = components(wanted.select(F.col("id").alias("node")), links.union(more))

        of_set = keep(
            sets_of.join(labels, sets_of["rep"] == labels["node"], "left").select(
                "k1", "k2", F.coalesce("component", "rep").alias("component")
            ),
            "set_components",
        )
        lonely = F.col("id").isNull() | (F.col("n_shingles") == 0)
        left = made.select("id", "n_shingles", *(F.when(~lonely, F.col(k)).alias(k) for k in ("k1", "k2")))
        result = keep(
            left.join(of_set.hint("merge"), ["k1", "k2"], "left").select(
                F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id")
            ),
            "near_duplicates",
        )
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one document of every group, the one with the smallest key."""
    gone = near_duplicates(docs, key, text, size, percent).where(~F.col("kept")).select(F.col(key).alias("gone"))
    return docs.join(gone.distinct().hint("merge"), docs[key] == F.col("gone"), "left_anti")
