"""String expressions shared by every log format.

All of them are built from JVM-side functions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space code points.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Fixed value: largest unsigned 64-bit number.
MAX_UNSIGNED = 18446744073709551615
MAX_BIGINT = 9223372036854775807

# Length limit and marker of a shortened reason.
REASON_LIMIT = 160
REASON_ELLIPSIS = "..."


def _plain(char: Column) -> Column:
    """Is it plain printable ASCII, and no space?"""
    return char.between("!", "~")


def utrim(col: Column) -> Column:
    """Strip Unicode white space at both ends (SQL trim only strips U+0020).

    Text that begins and ends plainly between its spaces takes the short path; only the rest is trimmed by the
    whole character set.
    """
    bare = F.trim(col)
    plain = (bare == "") | (_plain(F.left(bare, F.lit(1))) & _plain(F.right(bare, F.lit(1))))
    return F.when(plain, bare).otherwise(F.trim(col, F.lit(WHITE_SPACE)))


def ultrim(col: Column) -> Column:
    bare = F.ltrim(col)
    plain = (bare == "") | _plain(F.left(bare, F.lit(1)))
    return F.when(plain, bare).otherwise(F.ltrim(col, F.lit(WHITE_SPACE)))


def is_blank(col: Column) -> Column:
    return utrim(col) == ""


def nonblank(col: Column) -> Column:
    """The value itself, or null when it is null or only white space."""
    return F.when(~is_blank(col), col)


def unsigned(digits: Column) -> Column:
    """Unsigned 64-bit number from a string of digits (a plus sign may lead), else null.

    The caller has checked the characters; '' and too large numbers give null.
    """
    wide = digits.try_cast("decimal(38,0)")
    return F.when(
        F.char_length(digits).between(1, 18), digits.try_cast("bigint").cast("decimal(20,0)")
    ).when(wide <= F.lit(str(MAX_UNSIGNED)).cast("decimal(20,0)"), wide.cast("decimal(20,0)"))


def to_bigint(col: Column) -> Column:
    """Unsigned decimal as BIGINT, clamped at the top of the range."""
    top = F.lit(str(MAX_BIGINT)).cast("decimal(20,0)")
    # ``least`` would skip a null
    return F.when(col.isNotNull(), F.least(col, top).cast("bigint"))


# Trims name their input several times.  The steps below therefore take a column
# of a table and add one projection per step, so that no step repeats the work of
# the one before.


def with_first_line(df: DataFrame, name: str) -> DataFrame:
    """Replace a column by its first non-blank line, trimmed; '' when there is none."""
    return (
        df.withColumn(name, utrim(F.col(name)))
        .withColumn(name, F.substring_index(name, "\n", 1))
        .withColumn(name, utrim(F.col(name)))
    )


def with_short_reason(df: DataFrame, name: str) -> DataFrame:
    """Replace a text by its first line, cut to the length limit."""
    line = F.col(name)
    short = (
        F.when(line == "", F.lit("unknown"))
        .when(
            F.char_length(line) > REASON_LIMIT,
            F.concat(F.left(line, F.lit(REASON_LIMIT)), F.lit(REASON_ELLIPSIS)),
        )
        .otherwise(line)
    )
    return with_first_line(df, name).withColumn(name, short)


def unescape(text: Column) -> Column:
    r"""Turn ``\\`` into ``\`` and ``\#`` into ``#``; keep other escapes."""
    return F.when(
        F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\#])", "$1")
    ).otherwise(text)


def starts_with_ignore_case(col: Column, prefix: str) -> Column:
    return F.lower(F.left(col, F.lit(len(prefix)))) == prefix.lower()
