"""Operator 7: licence notices and identifier tags.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. An
Aho-Corasick automaton over the words, joined by single spaces, finds the base phrases, further
notice phrases and the tag ``SPDX-License-Identifier``; the expression behind a tag is parsed by
the shunting-yard method and evaluated. Everything happens row by row in Arrow tasks: no shuffle.

Defined results: a null or empty text has no words, no places, empty label strings and score 0;
repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import text_slices
from fluxfold.llm.words import ALPHANUMERIC

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wordings of well-known licence notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge to any person": "mit",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
_EXPRESSION = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([A-Za-z0-9.+\-() \t]+)", re.IGNORECASE)
_PART = re.compile(r"[()]|[A-Za-z0-9.+\-]+")

# Families of identifiers with the strength of their copyleft (0 none, 1 weak, 2 strong).
FAMILIES = {
    "agpl": 2, "lgpl": 1, "gpl": 2, "apache": 0, "mit": 0, "bsd": 0, "isc": 0, "mpl": 1, "epl": 1,
    "cc-by": 0, "cc0": 0, "unlicense": 0, "zlib": 0, "0bsd": 0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class Value(NamedTuple):
    """What an expression grants: its licence labels and the copyleft of the best choice."""

    labels: frozenset[str]
    strength: int


def _licence(name: str) -> Value:
    low = name.lower()
    family = next((f for f in FAMILIES if low == f or low.startswith((f + "-", f + "+"))), low)
    return Value(frozenset([family]), FAMILIES.get(family, 2))


def _apply(operator: str, left: Value | str, right: Value | str) -> Value:
    if operator == "with":
        base = left if isinstance(left, Value) else _licence(left)
        # An exception loosens the licence that it is attached to.
        return Value(base.labels, max(0, base.strength - 1))
    a, b = (x if isinstance(x, Value) else _licence(x) for x in (left, right))
    pick = max if operator == "and" else min
    return Value(a.labels | b.labels, pick(a.strength, b.strength))


def evaluate(parts: list[str]) -> Value | None:
    """Shunting-yard evaluation of an and/or/with expression; None where it is malformed."""
    values: list[Value | str] = []
    operators: list[str] = []

    def reduce() -> bool:
        operator = operators.pop()
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append(_apply(operator, left, right))
        return True

    expect_value = True
    for part in parts:
        low = part.lower()
        if part == "(" and expect_value:
            operators.append(part)
        elif part == ")" and not expect_value:
            while operators and operators[-1] != "(":
                if not reduce():
                    return None
            if not operators:
                return None
            operators.pop()
        elif low in PRECEDENCE and not expect_value:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[low]:
                if not reduce():
                    return None
            operators.append(low)
            expect_value = True
        elif part not in "()" and low not in PRECEDENCE and expect_value:
            values.append(part)
            expect_value = False
        else:
            return None
    while operators:
        if operators[-1] == "(" or not reduce():
            return None
    if len(values) != 1:
        return None
    return values[0] if isinstance(values[0], Value) else _licence(values[0])


def tag_values(text: str) -> list[Value]:
    """The value of every tag, each up to the first part that no longer continues an expression."""
    found = []
    for match in _EXPRESSION.finditer(text):
        parts: list[str] = []
        expect_value = True
        for part in _PART.findall(match[1]):
            is_operator = part == ")" or part.lower() in PRECEDENCE
            if is_operator == expect_value:
                break
            parts.append(part)
            expect_value = part == "(" or part.lower() in PRECEDENCE
        while parts and (parts[-1] == "(" or parts[-1].lower() in PRECEDENCE):
            parts.pop()
        value = evaluate(parts)
        if value is not None:
            found.append(value)
    return found


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in {**BASE_PHRASES, **NOTICES}.items():
        automaton.add_word(f" {phrase} ", (phrase in BASE_PHRASES, label, len(phrase)))
    automaton.add_word(f" {TAG} ", (False, None, len(TAG)))
    automaton.make_automaton()
    return automaton


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, copyleft of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ALPHANUMERIC).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    starts, base, labels, tagged, notices = [], set(), set(), False, 0
    for end, (is_base, label, length) in _automaton().iter(joined):
        if is_base:
            starts.append(end - length)
            base.add(label)
        elif label:
            notices += 1
            labels.add(label)
        else:
            tagged = True
    values = tag_values(text) if tagged else []
    for value in values:
        labels |= value.labels
    first = joined.count(" ", 0, min(starts)) - 1 if starts else None
    last = joined.count(" ", 0, max(starts)) - 1 if starts else None
    score = 1.0 if values else 1.0 - 0.5 ** min(len(starts) + notices, 50)
    strength = max((v.strength for v in values), default=None)
    return (
        len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)),
        score, strength,
    )


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of findings per row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    names = "n_words n_base first_word last_word base_labels labels score copyleft".split()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            columns = zip(*map(scan, batch.column(1).to_pylist()), strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *names])

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(
            scanned,
            f"key {kind}, n_words long, n_base long, first_word long, last_word long, "
            "base_labels string, labels string, score double, copyleft long",
        )
        .withColumnRenamed("key", key)
    )
