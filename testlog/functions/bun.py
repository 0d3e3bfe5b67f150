"""Expressions over one trimmed line of Bun test output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from testlog.functions.text import WHITE_SPACE, unsigned, utrim

# Markers and patterns of the text report.
SECTION_TITLE = "failures:"
INLINE_MARKS = ("(fail)", "✗", "×")
BULLETS = "-*•"
COUNT_WORDS = {
    "pass": "passed",
    "fail": "failed",
    "skip": "skipped",
    "pend": "skipped",
    "todo": "todo",
    "test": "total",
}
COUNT_PATTERN = (
    r"(?U)\A([+]?[0-9]+)\s+(?:\S+\s+)??[^\p{IsAlphabetic}\p{N}\s]*(pass|fail|skip|pend|todo|test)"
)
RAN_PATTERN = r"(?U)\ARan \s*([+]?[0-9]+)\s+test"
DOTS_PATTERN = r"(?U)\A[.FfSs\s]+\z"


def summary_kind(t: Column) -> Column:
    """Counter named by a line such as ``3 pass``, or null."""
    word = F.regexp_extract(t, COUNT_PATTERN, 2)
    known = F.create_map(*[F.lit(x) for kv in COUNT_WORDS.items() for x in kv])
    starts = F.left(t, F.lit(1)).between("+", "9")
    return F.when(starts & summary_value(t).isNotNull(), F.element_at(known, F.nullif(word, F.lit(""))))


def summary_value(t: Column) -> Column:
    return unsigned(F.regexp_extract(t, COUNT_PATTERN, 1))


def ran_total(t: Column) -> Column:
    return F.when(t.startswith("Ran "), unsigned(F.regexp_extract(t, RAN_PATTERN, 1)))


def marked_text(t: Column) -> Column:
    """Text behind a failure mark, up to the first ``[``; null without a mark."""
    rest = F.lit(None).cast("string")
    for mark in reversed(INLINE_MARKS):
        rest = F.when(t.startswith(mark), F.substring(t, len(mark) + 1, 2**31 - 1)).otherwise(rest)
    return F.substring_index(rest, "[", 1)


def label_part(marked: Column) -> Column:
    return F.nullif(utrim(marked), F.lit(""))


def section_text(t: Column) -> Column:
    """Line of a failures section without its bullets."""
    return F.ltrim(t, F.lit(BULLETS + WHITE_SPACE))


def is_dots(t: Column) -> Column:
    return F.left(t, F.lit(1)).isin(".", "F", "f", "S", "s") & t.rlike(DOTS_PATTERN)


def count_chars(t: Column, chars: str) -> Column:
    return (F.char_length(t) - F.char_length(F.translate(t, chars, ""))).cast("bigint")
