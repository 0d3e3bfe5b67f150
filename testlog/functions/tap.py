"""TAP line expressions: what a single line says, before any context.

``tap_tokens`` turns text lines into compact token rows.  The kind of a line
depends only on its trimmed text; how the kind acts depends on the lines around
it and is settled in ``operators.tap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.session import configure
from testlog.functions.text import ultrim, unescape, unsigned, utrim, starts_with_ignore_case

# The markers of the TAP 13/14 line grammar.
VERSION_PREFIX = "TAP version "
VERSIONS = ("13", "14")
SUBTEST_PREFIX = "# Subtest:"
BAILOUT_PREFIX = "Bail out!"
PRAGMA_PATTERN = r"\Apragma ([+-])([A-Za-z0-9_-]+)\z"
PLAN_PATTERN = r"(?Us)\A([+]?[0-9]+)\s*\.\.\s*([+]?[0-9]+)\s*(?: #.*)?\z"
HASH_PATTERN = r"(?Us)\A(.*?\s)#\s"
DIRECTIVE_PATTERN = r"(?Us)\A.*?\s#\s+(\S+)"
DIRECTIVES = ("TODO", "SKIP")
UNNAMED_TEST = "unnamed test"

# Line kinds, by position.
KINDS = (
    "blank",
    "version",
    "bad_version",
    "subtest",
    "comment",
    "bailout",
    "strict_on",
    "strict_off",
    "pragma",
    "plan",
    "point",
    "ok_like",
    "yaml_open",
    "yaml_close",
    "other",
)
KIND = {name: i for i, name in enumerate(KINDS)}

PAYLOAD = ("ok", "raw_id", "directive", "description", "plan_start", "plan_end", "reason")


def line_kind(t: Column) -> Column:
    """Index into KINDS for a trimmed line."""
    k = {name: F.lit(i) for name, i in KIND.items()}
    version = utrim(F.regexp_replace(t, r"\A(?:TAP version )+", ""))
    strict = F.lower(t)
    pragma = t.rlike(PRAGMA_PATTERN)
    plan = t.rlike(PLAN_PATTERN)
    plan_ok = (
        unsigned(F.regexp_extract(t, PLAN_PATTERN, 1)).isNotNull()
        & unsigned(F.regexp_extract(t, PLAN_PATTERN, 2)).isNotNull()
    )
    first = F.left(t, F.lit(1))
    return (
        F.when(t == "", k["blank"])
        .when(
            t.startswith("ok") | t.startswith("not ok"),
            F.when(
                (t == "ok") | t.startswith("ok ") | (t == "not ok") | t.startswith("not ok "),
                k["point"],
            ).otherwise(k["ok_like"]),
        )
        .when(
            first == "#", F.when(t.startswith(SUBTEST_PREFIX), k["subtest"]).otherwise(k["comment"])
        )
        .when(
            t.startswith(VERSION_PREFIX),
            F.when(version.isin(*VERSIONS), k["version"]).otherwise(k["bad_version"]),
        )
        .when(starts_with_ignore_case(t, BAILOUT_PREFIX), k["bailout"])
        .when(
            t.startswith("pragma ") & pragma,
            F.when(strict == "pragma +strict", k["strict_on"])
            .when(strict == "pragma -strict", k["strict_off"])
            .otherwise(k["pragma"]),
        )
        .when(first.between("+", "9") & F.contains(t, F.lit("..")) & plan & plan_ok, k["plan"])
        .when(t.startswith("---"), k["yaml_open"])
        .when(t.startswith("..."), k["yaml_close"])
        .otherwise(k["other"])
    )


def _ascii_upper(col: Column) -> Column:
    """Upper case of the directives' letters only: other scripts have no say here."""
    letters = "".join(sorted(set("".join(DIRECTIVES))))
    return F.translate(col, letters.lower(), letters)


def tap_tokens(lines: DataFrame) -> DataFrame:
    """``lines(run_id, line_no, line)`` -> one token row per line.

    Columns: run_id, line_no, spaces (leading U+0020), tab (a tab follows them),
    kind, and the fields of points, plans and bailouts.  Regular expressions only
    meet the few lines whose first characters call for them.
    """
    configure(lines.sparkSession)
    keep = [c for c in lines.columns if c != "line"]
    t, rest, body = F.col("t"), F.col("rest"), F.col("body")
    is_point = F.col("kind") == KIND["point"]
    is_plan = F.col("kind") == KIND["plan"]
    to_end = 2**31 - 1
    after_spaces = F.ltrim(F.col("line"))
    after_digits = F.ltrim(rest, F.lit("0123456789"))

    base = lines.select(
        *keep,
        utrim(F.col("line")).alias("t"),
        (F.char_length("line") - F.char_length(after_spaces)).cast("int").alias("spaces"),
        after_spaces.startswith("\t").alias("tab"),
    ).withColumn("kind", line_kind(t).cast("int"))
    word = F.when(t.startswith("ok"), 3).otherwise(7)
    point = base.withColumn("rest", F.when(is_point, F.substring(t, word, F.lit(to_end))))
    point = point.withColumn("rest", ultrim(rest)).withColumn("after", after_digits)
    # digits are the id, one dash may follow, the remainder is the description
    point = point.withColumn(
        "digits", F.left(rest, F.char_length(rest) - F.char_length("after"))
    ).withColumn("body", ultrim(F.col("after")))
    point = point.withColumn(
        "body", F.when(body.startswith("-"), ultrim(F.substring(body, 2, to_end))).otherwise(body)
    )
    # the first hash with white space on both sides starts a directive
    token = F.when(F.contains(body, F.lit("#")), _ascii_upper(F.regexp_extract(body, DIRECTIVE_PATTERN, 1)))
    point = point.withColumn("token", token).withColumn(
        "directive", F.when(F.col("token").isin(*DIRECTIVES), F.col("token"))
    )
    named = F.when(
        F.col("directive").isNotNull(), utrim(F.regexp_extract(body, HASH_PATTERN, 1))
    ).otherwise(body)
    point = point.withColumn("named", named)
    return point.select(
        *keep,
        "spaces",
        "tab",
        "kind",
        F.when(is_point, t.startswith("ok")).alias("ok"),
        unsigned(F.col("digits")).alias("raw_id"),
        "directive",
        F.nullif(unescape(F.col("named")), F.lit("")).alias("description"),
        F.when(is_plan, unsigned(F.regexp_extract(t, PLAN_PATTERN, 1))).alias("plan_start"),
        F.when(is_plan, unsigned(F.regexp_extract(t, PLAN_PATTERN, 2))).alias("plan_end"),
        F.when(
            F.col("kind") == KIND["bailout"],
            unescape(utrim(F.substring(t, len(BAILOUT_PREFIX) + 1, to_end))),
        ).alias("reason"),
    )
