"""Bun text reports: failure labels, summary counts and dot progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.functions import bun as B
from testlog.functions.text import to_bigint, utrim
from testlog.operators.durable import BLOCK_LINES, exceeds
from testlog.operators.ordered import last_before
from testlog.session import configure

SUMMARY_KINDS = ("total", "passed", "failed", "skipped", "todo")


def bun_sections(
    lines: DataFrame, block_lines: int = BLOCK_LINES, long_runs: bool | None = None
) -> DataFrame:
    """Trimmed lines with ``in_section``: does a failures section hold this line?

    A title opens the section; a blank or summary-count line closes it.  Both
    show in the line itself, so the last such line before decides.
    """
    configure(lines.sparkSession)
    if long_runs is None:
        long_runs = exceeds(lines, "line_no", block_lines)
    t = F.col("t")
    rows = lines.select("run_id", "line_no", utrim(F.col("line")).alias("t"))
    rows = rows.withColumn("count_kind", B.summary_kind(t))
    title = F.lower(t) == B.SECTION_TITLE
    flag = F.when(title, True).when((t == "") | F.col("count_kind").isNotNull(), False)
    rows = last_before(rows, flag, "in_section", long_runs, block_lines)
    return rows.withColumn(
        "in_section", F.coalesce("in_section", F.lit(False)) & ~title & (t != "")
    ).withColumn("title", title)


def bun_events(lines: DataFrame, **options) -> DataFrame:
    """One row per telling line.

    ``label`` marks a failure, ``count_kind``/``count`` a stated count, and
    ``dots_passed``/``dots_failed``/``dots_skipped`` progress characters.
    """
    t = F.col("t")
    rows = bun_sections(lines, **options)
    text = F.col("text")
    rows = rows.withColumn("text", F.when(F.col("in_section"), B.section_text(t)))
    rows = rows.withColumn("marked", B.marked_text(t)).withColumn("marked", B.label_part(F.col("marked")))
    listed = F.when((text != "") & ~text.endswith(":") & B.summary_kind(text).isNull(), text)
    inside = F.col("in_section") & F.col("count_kind").isNull()
    outside = ~F.col("in_section") & ~F.col("title") & F.col("count_kind").isNull()
    ran = F.when(outside, B.ran_total(t))
    label = F.when(inside, listed).when(outside & ran.isNull(), F.col("marked"))
    dots = outside & B.is_dots(t)
    kind = F.when(ran.isNotNull(), F.lit("total")).otherwise(F.col("count_kind"))
    value = F.coalesce(ran, F.when(F.col("count_kind").isNotNull(), B.summary_value(t)))
    zero = F.lit(0).cast("bigint")
    events = rows.select(
        "run_id",
        "line_no",
        label.alias("label"),
        kind.alias("count_kind"),
        to_bigint(value).alias("count"),
        F.when(dots, B.count_chars(t, ".")).otherwise(zero).alias("dots_passed"),
        F.when(dots, B.count_chars(t, "Ff")).otherwise(zero).alias("dots_failed"),
        F.when(dots, B.count_chars(t, "Ss")).otherwise(zero).alias("dots_skipped"),
    )
    return events


def bun_run_state(lines: DataFrame, **options) -> DataFrame:
    """State of every Bun run: observed counts, overridden by the last stated ones."""
    events = bun_events(lines, **options)
    n = F.col("line_no")

    def last_count(kind: str) -> Column:
        return F.max_by("count", F.when(F.col("count_kind") == kind, n)).alias(f"said_{kind}")

    agg = events.groupBy("run_id").agg(
        F.count("label").alias("labels"),
        F.sum("dots_passed").alias("dots_passed"),
        F.sum("dots_failed").alias("dots_failed"),
        F.sum("dots_skipped").alias("dots_skipped"),
        *[last_count(k) for k in SUMMARY_KINDS],
    )
    zero = F.lit(0).cast("bigint")
    seen_failed = F.col("labels") + F.col("dots_failed")
    passed = F.coalesce("said_passed", "dots_passed")
    failed = F.coalesce(F.col("said_failed"), seen_failed)
    skipped = F.coalesce("said_skipped", "dots_skipped")
    todo = F.coalesce("said_todo", zero)
    # with any stated count an unstated total is the sum, which is also the observed total
    total = F.coalesce(F.col("said_total"), passed + failed + skipped + todo)
    return agg.select(
        "run_id",
        F.lit(None).cast("bigint").alias("planned"),
        total.alias("total"),
        passed.alias("passed"),
        failed.alias("failed"),
        todo.alias("todo"),
        skipped.alias("skipped"),
        F.lit(None).cast("string").alias("bailout_reason"),
        zero.alias("parse_warning_count"),
        zero.alias("protocol_failures"),
    )


def bun_failures(events: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return events.filter(F.col("label").isNotNull()).select(
        "run_id",
        "line_no",
        F.lit(0).alias("item_no"),
        F.lit("bun").alias("source"),
        "label",
        none.alias("suite"),
        none.alias("test_file"),
        none.alias("reason"),
    )
