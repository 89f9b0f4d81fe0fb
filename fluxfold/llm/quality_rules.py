"""Operator 3: quality rules as one Spark projection.

``RULES`` is a table of thresholds over ratios of lengths, symbols, stop words and lines. It is
compiled into boolean columns of a single projection over built-in functions; no user function
runs. Words are runs of anything but ASCII white space. A null text counts as empty: no words, no
lines, ``base_failed``. Repeated rows are judged each, an empty table gives an empty result; other
columns pass through ``quality_filter`` and never clash, because the verdicts are computed from
``key`` and ``text`` only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import SPACE, null_safe_text

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
END_MARKS = ".!?\"'”»…:;"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for as with was be by on not this are or from at which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et des en un du une que est pour qui dans par sur pas au "
    "el los del se las por con una su para es al lo como más"
)


class Rule(NamedTuple):
    """The measure must lie in [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words_per_word", "n_stop_words / n_words", 0.02, None),
    Rule("shouted_words", "n_upper_words / n_words", None, 0.3),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice."""
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
                i.alias("i"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return F.sort_array(windows)


def _covered(ordered: Column) -> Column:
    """From the sorted windows: the number of words that the repeated ones cover."""
    repeated = F.filter(
        ordered,
        lambda w, j: (F.get(ordered, j - 1)["h"] == w["h"]) | (F.get(ordered, j + 1)["h"] == w["h"]),
    )
    return F.sort_array(F.transform(repeated, lambda w: w["i"]))


def _span(starts: Column) -> Column:
    lengths = F.transform(
        starts, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(starts, j + 1) - p), F.lit(3))
    )
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """The counts that the rules use, one row per row of ``docs``, beside a struct ``source`` of
    the ``carried`` columns."""
    stop = list(dict.fromkeys(STOP_WORDS.split()))
    has_word = f"[^{SPACE}]"
    raw = docs.select(F.struct(*carried).alias("source"), null_safe_text(text).alias("text"))
    parts = raw.select(
        "source",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+".replace("|", r"\|"), ""))
        .cast("long")
        .alias("n_symbols"),
    )
    words, lines = F.col("words"), F.col("lines")
    ordered = parts.withColumn("ordered", _repeat_words(words))
    starts = ordered.withColumn("starts", _covered(F.col("ordered")))
    count = lambda array, test: F.size(F.filter(array, test)).cast("long")
    return starts.select(
        "source",
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _span(F.col("starts")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(stop)).alias("n_stop_words"),
        count(words, lambda w: w.rlike(r"^\p{Lu}{2,}\P{L}*$")).alias("n_upper_words"),
        count(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$")).alias("n_ellipsis_lines"),
        count(lines, lambda x: x.rlike(rf"^[{SPACE}]*[-*•]")).alias("n_bullet_lines"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A boolean column per rule, true where it holds; an undefined ratio holds."""
    columns = []
    for rule in rules:
        over, under = (F.col(x.strip()) for x in rule.measure.split("/"))
        value = F.when(under > 0, over.cast("double") / under)
        tests = [value >= rule.low] if rule.low is not None else []
        tests += [value <= rule.high] if rule.high is not None else []
        holds = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        columns.append(F.coalesce(holds, F.lit(True)).alias(f"ok_{rule.name}"))
    return columns


def _judged(docs: DataFrame, rules: tuple[Rule, ...], carried: list[str], text: str) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & F.col(f"ok_{rule.name}")
    return (
        measures(docs, carried, text)
        .select("*", *compile_rules(rules))
        .select("*", failed.alias("base_failed"), (~failed & verdict).alias("kept"))
    )


def quality_verdicts(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, the counts, one ``ok_`` column per rule, base_failed and kept."""
    judged = _judged(docs, rules, [key], text)
    names = judged.columns[1:]
    # A filter on a verdict would be pushed down, and with it copies of all the expressions that it
    # stands for; one value with a row number in it stays whole, and the filter above it.
    whole = F.struct(F.col("source")[key].alias(key), *names, F.monotonically_increasing_id().alias("_row"))
    return judged.select(whole.alias("_verdict")).select(*[F.col("_verdict")[c].alias(c) for c in (key, *names)])


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; no shuffle."""
    judged = _judged(docs, rules, docs.columns, text)
    # A filter on ``kept`` alone would be pushed down, and with it copies of all the expressions
    # it stands for, many times over; a filter that also needs a row number stays above them.
    numbered = judged.select("source", "kept", F.monotonically_increasing_id().alias("n"))
    return numbered.where(F.col("kept") & (F.col("n") >= 0)).select("source.*")
