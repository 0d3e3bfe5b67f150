"""Failures of all sources: union, deduplication, caps and rendered messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from testlog.functions.text import nonblank
from testlog.operators.durable import materialize
from testlog.operators.runs import is_success

# Fixed value: how many distinct failures of a run are remembered.
REMEMBERED = 4096

# Message titles.
BAILOUT_TITLE = "TAP bailout"
SUMMARY_TITLE = "Run summary"

POSITION = ("stage", "path", "line_no", "item_no")


def all_failures(stream: list[DataFrame], junit: DataFrame | None = None) -> DataFrame:
    """One table of failures with a total order per run: stream first, then reports by path."""
    shape = ("source", "label", "suite", "test_file", "reason")
    parts = [
        s.select("run_id", F.lit(0).alias("stage"), F.lit("").alias("path"), "line_no", "item_no", *shape)
        for s in stream
    ]
    if junit is not None:
        parts.append(
            junit.select(
                "run_id",
                F.lit(1).alias("stage"),
                "path",
                F.col("case_no").alias("line_no"),
                F.lit(0).alias("item_no"),
                *shape,
            )
        )
    return reduce(DataFrame.unionByName, parts)


# Into how many parts the keys of a run are cut, step by step, to find its first ones.
KEY_PARTS = (256, 16, 1)


def _key_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")


def dedup_key() -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "|",
        "source",
        "label",
        F.coalesce("suite", blank),
        F.coalesce("test_file", blank),
        F.coalesce("reason", blank),
    )


def dedup_failures(
    failures: DataFrame, position: tuple[str, ...] = POSITION, remembered: int = REMEMBERED
) -> DataFrame:
    """Keep the first failure of each key per run.

    Only the first ``remembered`` distinct keys of a run are known as repeats.
    Keys are first reduced to one row each by a partial aggregate, so neither a run
    nor a key with a third of all rows ends up in one task.  That settles every run
    with no more keys than are remembered.  In other runs the remembered keys are found in parts, so
    that no task ranks a whole run; the failures behind the last one are read again, and those of no
    remembered key are kept as well.
    """
    pos = F.struct(*position)
    rest = F.struct(*failures.columns)
    keyed = failures.select("run_id", dedup_key().alias("key"), pos.alias("pos"), rest.alias("row"))
    firsts = keyed.groupBy("run_id", "key").agg(F.min("pos").alias("first_pos"), F.min_by("row", "pos").alias("row"))
    crowded = (
        firsts.groupBy("run_id").agg(F.count(F.lit(1)).alias("keys")).filter(F.col("keys") > remembered)
    )
    # the first keys of a run are among the first of each part of its keys; runs are already met part
    # by part, since a join on the run alone would leave all its keys in one task
    known = (
        firsts.select("run_id", "key", "first_pos", _key_part(KEY_PARTS[0]))
        .join(crowded.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS[0] - 1))).alias("part")),
              ["run_id", "part"], "left_semi")
    )
    for parts in KEY_PARTS:
        order = W.partitionBy("run_id", "part").orderBy("first_pos")
        known = known.select("run_id", "key", "first_pos", _key_part(parts))
        known = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= remembered)
    known = known.select("run_id", "key", "first_pos")
    edge = known.groupBy("run_id").agg(F.max("first_pos").alias("edge"))
    settled = firsts.join(edge, "run_id", "left").filter(
        F.col("edge").isNull() | (F.col("first_pos") <= F.col("edge"))
    )
    later = (
        keyed.join(edge, "run_id")
        .filter(F.col("pos") > F.col("edge"))
        .join(known.select("run_id", "key"), ["run_id", "key"], "left_anti")
    )
    return settled.select("row.*").unionByName(later.select("row.*"))


def cap_failures(
    failures: DataFrame, limit: int | None, position: tuple[str, ...] = POSITION
) -> DataFrame:
    """The first ``limit`` failures of each run; no limit keeps all, 0 keeps none."""
    if limit is None:
        return failures
    if limit == 0:
        return failures.limit(0)
    order = W.partitionBy("run_id").orderBy(*position)
    return (
        failures.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .drop("rank")
    )


CAP_BLOCK = 4096


def failure_policy(failures: DataFrame, policy: DataFrame) -> DataFrame:
    """Failures that a run's own settings let through.

    ``policy`` has ``dedup_failures`` and ``max_failure_notifications`` (null: no limit) for each run; a run
    not listed there is deduplicated and has no limit.
    """
    plain = policy.filter(~F.col("dedup_failures")).select("run_id")
    rows = dedup_failures(failures.join(plain, "run_id", "left_anti")).unionByName(
        failures.join(plain, "run_id", "left_semi")
    )
    return cap_by_run(rows, policy.select("run_id", F.col("max_failure_notifications").alias("limit")))


def cap_by_run(failures: DataFrame, limits: DataFrame) -> DataFrame:
    """The first failures of each run, up to the run's own ``limits(run_id, limit)``; null keeps all.

    Rows are counted per block of a run's order, and only the block in which a limit falls is looked into:
    first its lines, then the rows of one line.  The limit thus becomes a position, and rows before it
    are kept; no run is ever ranked as a whole.
    """
    stored = materialize(failures)
    limits = limits.filter(F.col("limit").isNotNull())
    totals = stored.groupBy("run_id").agg(F.count("*").alias("n"))
    over = totals.join(limits, "run_id").filter(F.col("n") > F.col("limit")).select("run_id", F.col("limit").alias("left"))
    over = materialize(over)
    spot = stored.select("run_id", F.struct(*POSITION).alias("pos")).join(over.select("run_id"), "run_id", "left_semi")
    at = F.col("pos")
    places = (
        # a block of lines, then a line with a block of its items, then the row
        F.struct(at["stage"], at["path"], F.floor(at["line_no"] / CAP_BLOCK)),
        F.struct(at["line_no"], F.floor(at["item_no"] / CAP_BLOCK)),
        at["item_no"],
    )
    for place in places:
        blocks = spot.groupBy("run_id", place.alias("place")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        order = W.partitionBy("run_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        crossing = (
            blocks.withColumn("upto", F.sum("n").over(order))
            .join(over.select("run_id", "left"), "run_id")
            .filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        )
        over = materialize(
            crossing.select("run_id", "place", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("first").alias("border"))
        )
        spot = spot.withColumn("place", place).join(over.select("run_id", "place"), ["run_id", "place"], "left_semi").drop("place")
    borders = over.select("run_id", "border")
    kept = stored.join(borders, "run_id", "left")
    return kept.filter(F.col("border").isNull() | (F.struct(*POSITION) < F.col("border"))).select(*failures.columns)


def _project() -> Column:
    return F.col("project")


def render_failures(failures: DataFrame) -> DataFrame:
    """Title and body of each failure's message; ``project`` (may be null) ends the body."""

    def line(name: str, value: Column) -> Column:
        return F.when(nonblank(value).isNotNull(), F.concat(F.lit(f"{name}: "), value))

    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Runner: "), "source"),
        line("Suite", F.col("suite")),
        line("File", F.col("test_file")),
        F.concat(F.lit("Test: "), "label"),
        line("Reason", F.col("reason")),
        F.concat(F.lit("Project: "), _project()),
    )
    return failures.select(
        "run_id",
        F.lit("failure").alias("kind"),
        F.concat("source", F.lit(" failure")).alias("title"),
        body.alias("body"),
    )


def render_run_messages(states: DataFrame) -> DataFrame:
    """Bailout and summary messages; ``project`` is null where it is not to be named."""
    bailouts = states.filter(F.col("bailout_reason").isNotNull()).select(
        "run_id",
        F.lit("bailout").alias("kind"),
        F.lit(BAILOUT_TITLE).alias("title"),
        F.concat_ws("\n", "bailout_reason", F.concat(F.lit("Project: "), _project())).alias("body"),
    )
    status = F.when(is_success(), "success").otherwise("failure")
    summary = F.concat_ws(
        "; ",
        F.concat(F.lit("status: "), status),
        *[
            F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
            for c in ("total", "passed", "failed", "todo", "skipped")
        ],
    )
    summaries = states.select(
        "run_id",
        F.concat(F.lit("summary_"), status).alias("kind"),
        F.concat_ws(" - ", F.lit(SUMMARY_TITLE), _project()).alias("title"),
        summary.alias("body"),
    )
    return bailouts.unionByName(summaries)
