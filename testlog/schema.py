"""Table shapes used across the package."""

from __future__ import annotations

# One row per run (or run and subtest path): the folded result of its log.
RUN_STATE = (
    "planned BIGINT, total BIGINT, passed BIGINT, failed BIGINT, todo BIGINT, skipped BIGINT, "
    "bailout_reason STRING, parse_warning_count BIGINT, protocol_failures BIGINT"
)
COUNTERS = ("total", "passed", "failed", "todo", "skipped")
STATE_COLUMNS = (
    "planned",
    *COUNTERS,
    "bailout_reason",
    "parse_warning_count",
    "protocol_failures",
)

LOG_CHUNKS = "run_id BIGINT, seq BIGINT, chunk STRING, event_ts TIMESTAMP"
LOG_LINES = "run_id BIGINT, line_no INT, line STRING, event_ts TIMESTAMP"
FAILURES = (
    "run_id BIGINT, line_no INT, item_no INT, source STRING, label STRING, "
    "suite STRING, test_file STRING, reason STRING"
)
FAILURE_COLUMNS = ("run_id", "line_no", "item_no", "source", "label", "suite", "test_file", "reason")
REPORTS = "run_id BIGINT, path STRING, modified TIMESTAMP, content STRING"
RUNS = "run_id BIGINT, project STRING, command ARRAY<STRING>, started_at TIMESTAMP, exit_code INT"
SETTINGS = "run_id BIGINT, layer STRING, key STRING, value STRING"

# The spelling of each failure source.
SOURCES = ("TAP", "go", "nextest", "jest", "vitest", "bun", "junit")
