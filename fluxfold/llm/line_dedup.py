"""Operator 4: repeated runs of lines, by winnowing over line hashes.

A run is a sequence of whole lines with at least ``MIN_CHARS`` characters (line ends included) that
also stands earlier, in the order of (key, line). Winnowing: of every smallest window of lines with
that many characters, counted forwards from each line and backwards from each line, the line with
the smallest hash is the window's fingerprint. Equal runs hold equal windows and so select the same
fingerprints, however they lie in their texts. Only windows whose fingerprint stands at two places
or more go on; each is joined to the earliest equal window, and the later one is deleted. Forward
windows carry a match to its right, backward windows to its left, so together they cover exactly
the maximal repeated runs. All steps are DataFrame functions.

``MIN_CHARS`` is about three words of ordinary length and a line end: from there on a line is a
window of its own and goes wherever it stands again, alone or not. Shorter lines (a heading of a
word or two, ``}``, an empty line) are often equal by chance; they go only as part of a repeated run
that reaches the length together.

Rows with the same key are one document. Null keys and null or empty texts are left as they are;
empty tables give empty results; other columns pass through ``drop_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import keep, tidy_shuffles

MIN_CHARS = 25


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _windows(hashes: Column, sizes: Column, min_chars: int) -> Column:
    """Smallest windows with enough characters: structs of first and last line, from 0."""
    n = F.size(hashes)

    def reach(part: Column) -> Column:
        """Number of lines of ``part`` needed for enough characters, 0 if it has not enough."""
        state = F.aggregate(
            part,
            F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines")),
            lambda a, x: F.when(a["chars"] >= min_chars, a).otherwise(
                F.struct(
                    (a["chars"] + F.least(x, F.lit(min_chars))).alias("chars"),
                    (a["lines"] + 1).alias("lines"),
                )
            ),
        )
        return F.when(state["chars"] >= min_chars, state["lines"]).otherwise(0)

    # A line end counts, so a window never needs more than ``min_chars`` lines.
    forward = F.transform(
        sizes, lambda _, i: F.struct(i.alias("s"), (i - 1 + reach(F.slice(sizes, i + 1, min_chars))).alias("e"))
    )
    backward = F.transform(
        sizes,
        lambda _, i: F.struct(
            (
                i + 1 - reach(F.reverse(F.slice(sizes, F.greatest(F.lit(1), i + 2 - min_chars), F.least(i + 1, F.lit(min_chars)))))
            ).alias("s"),
            i.alias("e"),
        ),
    )
    both = F.concat(forward, backward)
    return F.when(n > 0, F.array_distinct(F.filter(both, lambda w: w["e"] >= w["s"]))).otherwise(both)


def line_windows(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """key, s, e (lines), fingerprint (hash), place (its line), h1 and h2 (of the window)."""
    split = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), _lines(text).alias("lines"))
    hashed = split.where(F.size("lines") > 0).select(
        "key",
        "lines",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.length(x) + 1).alias("sizes"),
    )
    placed = hashed.select(
        "key", "lines", "hashes", F.explode(_windows(F.col("hashes"), F.col("sizes"), min_chars)).alias("w")
    )
    part = lambda array: F.slice(array, F.col("w.s") + 1, F.col("w.e") - F.col("w.s") + 1)
    cut = placed.select("key", "w.s", "w.e", part("hashes").alias("part"), part("lines").alias("own"))
    fingerprint = F.array_min("part")
    return cut.select(
        "key",
        "s",
        "e",
        fingerprint.alias("fingerprint"),
        (F.col("s") + F.array_position("part", fingerprint).cast("int") - 1).alias("place"),
        F.xxhash64("part").alias("h1"),
        F.hash("own").alias("h2"),
    )


def repeated_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """key and runs (array of first and last line), for every document with lines to delete."""
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        windows = keep(line_windows(docs, key, text, min_chars), "line_windows")
        at = F.struct("key", "place")
        shared = keep(
            windows.groupBy("fingerprint")
            .agg(F.min(at).alias("low"), F.max(at).alias("high"))
            .where(F.col("low") != F.col("high"))
            .select("fingerprint"),
            "shared_fingerprints",
        )
        candidates = keep(windows.join(shared, "fingerprint", "left_semi"), "candidate_windows")
        earliest = keep(
            candidates.groupBy("h1", "h2")
            .agg(F.min(F.struct("key", "s")).alias("first"), F.max(F.struct("key", "s")).alias("last"))
            .where(F.col("first") != F.col("last"))
            .select("h1", "h2", "first"),
            "earliest_windows",
        )
        later = candidates.join(earliest, ["h1", "h2"]).where(F.struct("key", "s") > F.col("first"))
        later = later.select("key", "s", "e").distinct()
        order = Window.partitionBy("key").orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = later.withColumn("new", F.coalesce(F.col("s") > before + 1, F.lit(True)).cast("int"))
        numbered = marked.withColumn("run", F.sum("new").over(order))
        runs = numbered.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        return keep(
            runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs")), "runs"
        )


def _kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the sorted, disjoint runs."""
    n = F.size(lines)
    bounds = F.concat(
        F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))),
        runs,
        F.array(F.struct(n.alias("s"), n.alias("e"))),
    )
    gaps = F.transform(
        F.sequence(F.lit(1), F.size(bounds) - 1),
        lambda i: F.slice(
            lines, F.get(bounds, i - 1)["e"] + 2, F.get(bounds, i)["s"] - F.get(bounds, i - 1)["e"] - 1
        ),
    )
    return F.flatten(gaps)


def _cleaned(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """source (struct of all columns), lines, runs (null without any) and kept lines."""
    runs = repeated_runs(docs, key, text, min_chars).withColumnRenamed("key", "run_key")
    packed = docs.select(F.struct(*docs.columns).alias("source"), F.col(key).alias("key"))
    # A fixed kind of join: the work then grows evenly with the input.
    joined = packed.join(runs.hint("merge"), packed["key"] == runs["run_key"], "left")
    lines = _lines(f"source.{text}")
    cleaned = joined.select("source", "runs", lines.alias("lines"))
    kept = F.when(F.col("runs").isNotNull(), _kept_lines(F.col("lines"), F.col("runs"))).otherwise(F.col("lines"))
    return cleaned.withColumn("kept", kept)


def line_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Per row: key, n_lines, n_removed, n_runs and the md5 of the text that is left."""
    cleaned = _cleaned(docs.select(key, text), key, text, min_chars)
    return cleaned.select(
        F.col("source")[key].alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.md5(F.array_join("kept", "\n")).alias("kept_md5"),
    )


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` with later repeated runs cut from the text; a row left without a word goes.

    Rows without such runs are returned as they are, empty ones included. A column ``n_chars``
    keeps its value.
    """
    cleaned = _cleaned(docs, key, text, min_chars)
    left = F.array_join("kept", "\n")
    fields = [
        F.when(F.col("runs").isNotNull(), left).otherwise(F.col("source")[name]).alias(name)
        if name == text
        else F.col("source")[name].alias(name)
        for name in docs.columns
    ]
    return cleaned.where(F.col("runs").isNull() | left.rlike(r"[^\x20\x09-\x0D]")).select(*fields)
