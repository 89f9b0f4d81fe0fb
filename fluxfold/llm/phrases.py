"""Operator 12: phrase collocations, mined by sample, negative border and full count.

The sample, a fixed share of the rows chosen by a hash of their text, proposes phrases at a lowered
threshold. Proposals are closed under parts, so the border is what stands just outside: phrases
whose two parts one word shorter are proposed. A full pass counts all proposals and the whole
border, exactly, over every row. Border phrases that reach the threshold are failures of the
sample: they join the proposals, and a further pass counts what that adds to the border, until a
pass finds none. What is frequent is then named and counted once more by its letters, so that a hash
which two phrases share in different tasks cannot blur their counts, and scored with DataFrame joins.

Passes hash words and windows with numpy. Proposals travel as a bit filter whose size is set by
their number and bounded (``hash_counts.FILTER_BITS``): a false hit only counts a phrase more. Counts are added
up per slice, packed by hash range and added up again per range, so a phrase that stands in a third
of all rows costs a slice one entry, and no task holds more than a range.

Texts: A-Z lower-cased, cut into pieces at ``[.,;:!?\\n\\v\\f\\r]`` and those into words at blanks and
tabs. A null text has no words; a null lang counts as ``und``; repeated rows count again; ties in
score and count go to the smaller phrase; a very long text is one slice of a task; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import keep, tidy_shuffles
from fluxfold.llm.hash_counts import MAX_TASKS, PACKED, HashFilter, Packer, add_up, packing_parts
from fluxfold.llm.spans import Part, part_slices, word_spans
from fluxfold.llm.words import BY_SPACE, mix, windows

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
SAMPLE_SHARE = 0.1
#: Bytes of text whose windows one range of hashes counts.
RANGE_BYTES = 16_000_000
#: Phrases whose counts and letters a task holds before it hands them on.
NAMES_HELD = 400_000

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
#: Breaks become spaces, so that words end there.
_TO_SPACE = bytes(0x20 if b in _BREAKS else c for b, c in enumerate(BY_SPACE))
_SPACE = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Windows:
    """The windows of one to five words of some parts of texts."""

    def __init__(self, parts: list[Part], langs: list[str]) -> None:
        self.spans = s = word_spans(parts, _TO_SPACE)
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest()) for x in set(langs)}
        of_row = np.array([seeds[x] for x in langs], np.uint64)
        self.row = np.array([p.row for p in parts], np.int64)[s.part]
        self.seed = of_row[self.row] if len(s.hashes) else np.zeros(0, np.uint64)
        # Neighbours share a piece if they have the same part and no break between them.
        broken = np.cumsum(_IS_BREAK[s.blob])[s.starts]
        self.joined = (broken[1:] == broken[:-1]) & (s.part[1:] == s.part[:-1])

    def __len__(self) -> int:
        return len(self.spans.hashes)

    def hashes(self, size: int) -> np.ndarray:
        found = windows(self.spans.hashes, tuple(range(size)))
        return mix(found + self.seed[: len(found)] + np.uint64(size))

    def whole(self, size: int) -> np.ndarray:
        """Whether the window of this size from each word stays within its piece."""
        n = max(0, len(self) - size + 1)
        inside = np.ones(n, bool)
        for k in range(size - 1):
            inside &= self.joined[k : k + n]
        return inside


def _border(found: Windows, proposals: HashFilter | None, upto: int, sizes: range) -> Iterator[tuple[int, np.ndarray]]:
    """Per size, whether the window from each word has both its parts among the proposals.

    The filter holds sizes up to ``upto``; of longer parts all that could be proposed count.
    """
    known = None
    for size in range(1, sizes.stop):
        good = found.whole(size)
        if size > 1:
            good &= known[: len(good)] & known[1 : 1 + len(good)]
        if size in sizes:
            yield size, good
        known = good
        if proposals is not None and size <= upto:
            known = good.copy()
            known[good] = proposals.has(found.hashes(size)[good])


def count_windows(
    docs: DataFrame, sizes: range, minimum: int, parts: int,
    proposals: HashFilter | None = None, upto: int = 0, before: HashFilter | None = None,
) -> DataFrame:
    """size, h, n, proposed: counts of the border and the proposals, from ``minimum`` on.

    With ``before``, what was on the border of those earlier proposals is left out. ``docs`` has
    the columns text and lang.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(None if proposals is None else (proposals.bits, proposals.words))
    sent_before = context.broadcast(None if before is None else (before.bits, before.words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None if sent.value is None else HashFilter(*sent.value)
        old = None if sent_before.value is None else HashFilter(*sent_before.value)
        packer = Packer(parts)
        for batch, texts, _ in part_slices(batches, "text", _SPACE, MAX_WORDS - 1):
            found = Windows(texts, batch.column(1).to_pylist())
            done = dict(_border(found, old, upto, sizes)) if old is not None else {}
            for size, good in _border(found, now, upto, sizes):
                good = good & found.spans.own[: len(good)]
                if size in done:
                    good &= ~done[size]
                packer.add(size, found.hashes(size)[good])
            if packer.full():
                yield packer.take()
        yield packer.take()

    counted = add_up(docs.mapInArrow(count, PACKED), parts, minimum)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None if sent.value is None else HashFilter(*sent.value)
        for batch in batches:
            hashes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            yes = np.zeros(len(hashes), bool) if now is None else now.has(hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(yes)], ["size", "h", "n", "proposed"])

    return counted.mapInArrow(judge, "size int, h long, n long, proposed boolean")


def frequent_hashes(docs: DataFrame, sample: DataFrame, share: float, min_count: int) -> DataFrame:
    """(h): hashes of all phrases that may have ``min_count`` occurrences, none left out."""
    parts = packing_parts(docs, "text", RANGE_BYTES)
    few = packing_parts(sample, "text", RANGE_BYTES)
    # Two standard deviations below what a phrase at the threshold has in the sample.
    expected = share * min_count
    lowered = max(1, int(np.ceil(expected - 2 * expected**0.5))) if share < 1 else min_count

    proposed = keep(count_windows(sample, range(1, 2), lowered, few), "proposed_words")
    for sizes in (range(2, 3), range(3, MAX_WORDS + 1)):
        known = HashFilter.of(proposed)
        more = count_windows(sample, sizes, lowered, few, known, sizes.start - 1)
        proposed = keep(proposed.union(more), "proposed")

    before, now = None, HashFilter.of(proposed)
    found = []
    while True:
        counted = keep(
            count_windows(docs, range(1 if before is None else 2, MAX_WORDS + 1), min_count, parts, now, MAX_WORDS, before),
            "counted",
        )
        found.append(counted.select("size", "h"))
        # A failure of the longest size has nothing beyond it to count.
        failures = counted.where(~F.col("proposed"))
        if not failures.where(F.col("size") < MAX_WORDS).limit(1).count():
            break
        proposed = keep(proposed.select("size", "h").union(failures.select("size", "h")), "proposed")
        before, now = now, HashFilter.of(proposed)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


class _Names:
    """What a task has found of each phrase: its count and, once, its letters."""

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.index: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.counts: list[int] = []
        self.words: dict[str, int] = {}

    def add(self, found: Windows, size: int, at: np.ndarray, hashes: np.ndarray, langs: list[str]) -> None:
        # Equal hashes are taken for equal letters within a task only.
        unique, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        s = found.spans
        blob = s.blob.tobytes()
        for h, w, n in zip(unique.tolist(), at[first].tolist(), counts.tolist(), strict=True):
            k = self.index.get(h)
            if k is not None:
                self.counts[k] += n
                continue
            letters = blob[s.starts[w] : s.ends[w + size - 1]].translate(_LOWER)
            phrase = b" ".join(_SPLIT.findall(letters)).decode("utf-8", "surrogatepass")
            self.index[h] = len(self.counts)
            self.counts.append(n)
            self.rows.append(((h >> 32) * self.parts >> 32, langs[found.row[w]], size, phrase))

    def add_words(self, found: Windows, langs: list[str]) -> None:
        rows, counts = np.unique(found.row[found.spans.own], return_counts=True)
        for r, n in zip(rows.tolist(), counts.tolist(), strict=True):
            self.words[langs[r]] = self.words.get(langs[r], 0) + n

    def take(self) -> pa.RecordBatch:
        """One row per range of hashes: phrases, counts and so on as lists."""
        lists: dict[int, tuple[list, list, list, list]] = {}
        words = [(0, lang, 0, "") for lang in self.words]
        for (part, lang, size, phrase), n in zip(
            [*self.rows, *words], [*self.counts, *self.words.values()], strict=True
        ):
            for held, x in zip(lists.setdefault(part, ([], [], [], [])), (lang, size, phrase, n), strict=True):
                held.append(x)
        self.index, self.rows, self.counts, self.words = {}, [], [], {}
        columns = list(zip(*lists.values(), strict=True)) if lists else [[]] * 4
        types = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(lists), pa.int32()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True))],
            ["part", "langs", "sizes", "phrases", "counts"],
        )


_NAMED = "part int, langs array<string>, sizes array<int>, phrases array<string>, counts array<long>"


def name_phrases(docs: DataFrame, frequent: DataFrame, min_count: int) -> DataFrame:
    """lang, size, phrase, f: exact counts by letters of what is ``frequent`` (h), from
    ``min_count`` on; the row of size 0 of each lang has the number of its words."""
    known = HashFilter.of(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((known.bits, known.words))
    parts = packing_parts(docs, "text", RANGE_BYTES)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = HashFilter(*sent.value), _Names(parts)
        for batch, texts, _ in part_slices(batches, "text", _SPACE, MAX_WORDS - 1):
            langs = batch.column(1).to_pylist()
            found = Windows(texts, langs)
            for size, good in _border(found, now, MAX_WORDS, range(1, MAX_WORDS + 1)):
                at = np.flatnonzero(good & found.spans.own[: len(good)])
                hashes = found.hashes(size)[at]
                yes = now.has(hashes)
                names.add(found, size, at[yes], hashes[yes], langs)
            names.add_words(found, langs)
            if len(names.counts) >= NAMES_HELD:
                yield names.take()
        yield names.take()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals = None, {}

        def done():
            kept = [(*k, n) for k, n in totals.items() if k[1] == 0 or n >= min_count]
            columns = list(zip(*kept, strict=True)) if kept else [[]] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "size", "phrase", "f"]
            )

        for batch in batches:
            for part, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield done()
                    now, totals = part, {}
                for lang, size, phrase, n in zip(*lists, strict=True):
                    totals[lang, size, phrase] = totals.get((lang, size, phrase), 0) + n
        yield done()

    packed = docs.mapInArrow(name, _NAMED).repartition(min(parts, MAX_TASKS), "part").sortWithinPartitions("part")
    return packed.mapInArrow(add, "lang string, size int, phrase string, f long")


_SPLIT = re.compile(rb"[^\x20\x09]+")


def _slice(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored_phrases(named: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of ``named`` that stand in no longer one as
    often as by themselves."""
    single = named.where("size > 0").select("lang", "phrase", "f")
    totals = named.where("size = 0").select("lang", F.col("f").alias("n"))
    many = named.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # Each phrase against the parts that are two words or longer.
    spans = [(s, k) for k in range(2, MAX_WORDS) for s in range(1, MAX_WORDS - k + 2)]
    inner = F.array(*[
        F.when((F.lit(s + k - 1) <= F.col("size")) & (F.lit(k) < F.col("size")), _slice(F.col("w"), s, k)) for s, k in spans
    ])
    longer = many.select("lang", "a", F.explode(F.array_distinct(F.array_compact(inner))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = many.join(longer, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (100 * F.col("inside") < 100 * F.col("a"))
    )

    cuts = left.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _slice(F.col("w"), F.lit(1), F.col("k")).alias("head"),
        _slice(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )
    heads = single.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = single.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    big = "decimal(18,0)"
    # Up to 36 digits: exact. The quotient is at most 1000 * n.
    score = F.call_function(
        "div", (F.col("a") * 1000).cast(big) * F.col("n").cast(big), F.col("l").cast(big) * F.col("r").cast(big)
    )
    whole = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals), "lang")
    whole = whole.withColumn("score", score)
    worst = whole.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
    return worst.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every lang, with their rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within a salt, so that no task ranks a whole lang.
    salted = scored.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    final = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = near.where(F.col("rank") <= top).withColumn("rank", final).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_phrases(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    min_count: int = MIN_COUNT, share: float = SAMPLE_SHARE,
) -> DataFrame:
    """lang, size, phrase, f of every phrase of one to five words with ``min_count`` occurrences;
    rows of size 0 hold the number of words of each lang."""
    texts = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(10_000)) < int(share * 10_000)
    sample = docs.where(drawn).select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    with tidy_shuffles(docs.sparkSession):
        sample = keep(sample, "sample")
        frequent = keep(frequent_hashes(texts, sample, share, min_count), "frequent")
        return keep(name_phrases(texts, frequent, min_count), "named_phrases")


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    min_count: int = MIN_COUNT, top: int = TOP, share: float = SAMPLE_SHARE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every lang."""
    named = mine_phrases(docs, key, text, lang, min_count, share)
    with tidy_shuffles(docs.sparkSession):
        return keep(top_phrases(scored_phrases(named), top), "collocations")
