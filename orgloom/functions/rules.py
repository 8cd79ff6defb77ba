"""Rules as data, compiled to columns: substring vocabularies, first-match tables, scores that explain themselves."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def alternation(terms: Iterable[str]) -> str:
    """One pattern that finds any of the terms as a substring; works in Java and RE2 alike."""
    return "|".join(_SPECIAL.sub(r"\\\1", t) for t in terms)


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds any term as a substring; one pass, whatever the number of terms. Null is false."""
    if not terms:
        return F.lit(False)
    return F.coalesce(text.rlike(alternation(terms)), F.lit(False))


def terms_of(text: Column, terms: Sequence[str]) -> Column:
    """Which terms a text holds as substrings, in their order; none for null. For long texts and many terms, as Python's
    search passes over most of a text without looking at it, which a pattern of all terms can't."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([[w for w in terms if w in x] for x in (t.as_py() or "" for t in texts)], type=pa.list_(pa.string()))

    return held(text)


def hit_count(text: Column, terms: Sequence[str]) -> Column:
    """How many different terms the text holds."""
    return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """The value of the first row any of whose terms the text holds."""
    out = default
    for value, terms in reversed(table):
        out = F.when(has_any(text, [terms] if isinstance(terms, str) else terms), value).otherwise(out)
    return out


@dataclass(frozen=True)
class Term:
    """Points and a reason where a condition holds."""

    when: Column
    points: int
    reason: str


def total(terms: Sequence[Term], start: int = 0) -> Column:
    return sum((F.when(t.when, t.points).otherwise(0) for t in terms), F.lit(start))


def reasons(terms: Sequence[Term]) -> Column:
    """The reasons that hold, in order."""
    return F.array_compact(F.array(*[F.when(t.when, F.lit(t.reason)) for t in terms]))


def clamp(score: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def band(score: Column, steps: Sequence[tuple[int, str]], below: str) -> Column:
    """The name of the highest step that a score reaches."""
    out = F.lit(below)
    for least, name in sorted(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def is_filled(c: Column, kind: str) -> Column:
    """Whether a value counts as given: not null, and not "", 0, false or empty by its type."""
    if kind.startswith("array") or kind.startswith("map"):
        given = F.size(c) > 0
    elif kind == "string":
        given = c != ""
    elif kind == "boolean":
        given = c
    elif kind in ("date", "timestamp", "timestamp_ntz", "binary") or kind.startswith("struct"):
        given = c.isNotNull()
    else:
        given = c != 0
    return F.coalesce(given, F.lit(False))
