"""From chunks, reports and settings of many runs to states and failures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.operators import bun, jsonlog, junit, tap
from testlog.operators.durable import BLOCK_LINES, exceeds, materialize
from testlog.operators.failures import all_failures, failure_policy, render_failures, render_run_messages
from testlog.operators.lines import choose_format, detect_format, route, stored_lines
from testlog.operators.runs import (
    absent_files,
    chosen_reports,
    fresh_reports,
    infer_tool,
    match_reports,
    merge_run_states,
    missing_reports,
    only_stale,
    prefer_reports,
    report_inputs,
    report_tools,
    run_verdict,
    skips_stream,
    suppress_stale,
)
from testlog.schema import COUNTERS, STATE_COLUMNS
from testlog.sources.sinks import routed_summaries


@dataclass
class Streams:
    """Parsed logs: states and failures of every run with a log."""

    formats: DataFrame
    states: DataFrame
    failures: list[DataFrame]


def analyze_lines(lines: DataFrame, settings: DataFrame | None = None) -> Streams:
    """Detect each run's format, parse it, and fold it to a state.

    ``settings(run_id, input_format, strict)`` override detection and switch
    strict TAP checking on.
    """
    long_runs = exceeds(lines, "line_no", BLOCK_LINES)
    formats = materialize(choose_format(detect_format(lines), settings))
    parts = route(lines, formats)
    strict = settings.select("run_id", "strict") if settings is not None else False
    depth = tap.nesting(parts["tap"])
    events = tap.tap_events(parts["tap"], strict, depth, long_runs=long_runs)
    tap_states = tap.rollup_subtests(tap.line_stream_states(parts["tap"], strict, depth, long_runs=long_runs))
    outline = materialize(jsonlog.run_outline(parts["json"]))
    bun_events = {"long_runs": long_runs}
    states = [
        tap_states.filter(F.size("path") == 0).select("run_id", *STATE_COLUMNS),
        jsonlog.json_run_state(parts["json"], outline),
        bun.bun_run_state(parts["bun"], **bun_events),
    ]
    failures = [
        tap.tap_failures(events),
        jsonlog.json_failures(parts["json"], outline),
        bun.bun_failures(bun.bun_events(parts["bun"], **bun_events)),
    ]
    return Streams(formats, reduce(DataFrame.unionByName, states), failures)


def empty_logs(runs: DataFrame, parsed: DataFrame, settings: DataFrame | None) -> DataFrame:
    """States of runs that were parsed but wrote no line: as TAP they lack a plan."""
    rows = runs.select("run_id").join(parsed.select("run_id"), "run_id", "left_anti")
    if settings is not None:
        rows = rows.join(settings.select("run_id", "input_format"), "run_id", "left")
    else:
        rows = rows.withColumn("input_format", F.lit("auto"))
    as_tap = F.coalesce(F.col("input_format").isin("auto", "tap"), F.lit(True))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "run_id",
        F.lit(None).cast("bigint").alias("planned"),
        *[zero.alias(c) for c in COUNTERS],
        F.lit(None).cast("string").alias("bailout_reason"),
        zero.alias("parse_warning_count"),
        F.when(as_tap, 1).otherwise(0).cast("bigint").alias("protocol_failures"),
    )


@dataclass
class FleetResult:
    """Verdicts, all failures and error rows of a fleet; what the runs' own settings let through of it is
    worked out on demand."""

    verdicts: DataFrame
    failures: DataFrame
    errors: DataFrame
    runs: DataFrame
    settings: DataFrame
    streams: DataFrame  # states of the parsed logs, before reports are merged

    def notified(self) -> DataFrame:
        """Failures after each run's deduplication and limit, where messages are switched on."""
        enabled = self.settings.filter("enabled").select("run_id")
        return failure_policy(materialize(self.failures.join(enabled, "run_id", "left_semi")), self.settings)

    def messages(self) -> DataFrame:
        """Rendered messages: failures, bailouts and run summaries.

        The summary of a parsed log tells of the log alone; that of other runs of their reports.
        """
        label = F.when(F.col("include_project_context"), F.coalesce("project_label", "project"))
        named = self.settings.filter("enabled").join(self.runs.select("run_id", "project"), "run_id")
        named = named.select("run_id", label.alias("project"))
        shown = self.streams.select("run_id", *STATE_COLUMNS).unionByName(
            self.verdicts.join(self.streams.select("run_id"), "run_id", "left_anti").select("run_id", *STATE_COLUMNS)
        )
        failed = render_failures(self.notified().join(named, "run_id"))
        return failed.unionByName(render_run_messages(shown.join(named, "run_id")))

    def summaries(self) -> DataFrame:
        """(run_id, summary_file, summary) in each run's own format; runs that want none have no row."""
        return routed_summaries(self.verdicts, self.settings)


def analyze_runs(
    chunks: DataFrame, runs: DataFrame, reports: DataFrame, settings: DataFrame
) -> FleetResult:
    """Logs and reports of whole fleets; ``settings`` as given by ``resolve_settings``.

    ``reports`` are candidates, with paths as seen from the run's folder: those that the run's settings
    name are read, else those at the places its build tool writes to.
    """
    skipped = materialize(skips_stream(infer_tool(runs, settings), settings))
    # logs that reports replace are left out before anything is read from them
    lines = stored_lines(chunks.join(skipped, "run_id", "left_anti"))
    streams = analyze_lines(lines, settings)
    read = runs.join(skipped, "run_id", "left_anti")
    stream = materialize(streams.states.unionByName(empty_logs(read, lines.select("run_id").distinct(), settings)))

    inputs = report_inputs(settings)
    matched = materialize(match_reports(reports, inputs))
    tools = materialize(report_tools(runs, settings, matched))
    offered = chosen_reports(reports, matched, tools)
    dated = runs.select("run_id", "started_at").join(tools, "run_id")
    fresh = materialize(fresh_reports(offered, dated))
    # a named file that is absent is as good as a stale one
    named = dated.filter(F.col("named") & F.col("started_at").isNotNull()).select("run_id")
    stale = only_stale(offered, dated).union(named.join(fresh.select("run_id"), "run_id", "left_anti")).distinct()
    zero = F.lit(0).cast("bigint")
    absent = absent_files(runs, reports, inputs).select(
        "run_id",
        F.lit(None).cast("bigint").alias("planned"),
        *[zero.alias(c) for c in COUNTERS],
        F.lit(None).cast("string").alias("bailout_reason"),
        F.col("absent").alias("parse_warning_count"),
        zero.alias("protocol_failures"),
    )
    junit_states = materialize(junit.junit_run_state(fresh).select("run_id", *STATE_COLUMNS).unionByName(absent))

    kept = prefer_reports(stream, junit_states, tools)
    base = runs.select("run_id").join(kept, "run_id", "left")
    base = base.select(
        "run_id",
        F.lit(0).alias("stage"),
        "planned",
        *[F.coalesce(c, zero).alias(c) for c in COUNTERS],
        "bailout_reason",
        *[F.coalesce(c, zero).alias(c) for c in ("parse_warning_count", "protocol_failures")],
    )
    merged = merge_run_states(
        base.unionByName(junit_states.withColumn("stage", F.lit(1))), ["run_id"], ["stage"]
    )
    errors = missing_reports(settings, offered)
    shown = suppress_stale(merged, skipped, stale, junit_states).join(errors, "run_id", "left_anti")
    failures = all_failures(streams.failures, junit.junit_failures(junit.junit_cases(fresh)))
    return FleetResult(run_verdict(shown, runs), failures, errors, runs, settings, stream)
