"""TAP operators against a sequential fold, with whole and with cut runs."""

import random

import pytest
from pyspark.sql import functions as F

from testlog.operators.tap import tap_events, tap_failures, tap_states
from testlog.schema import STATE_COLUMNS
from tests.brute import tap

PIECES = [
    "ok", "not ok", "ok 1 - a", "not ok 2 - b", "ok 3", "not ok - c # TODO later", "ok 5 # SKIP",
    "ok - d # skip", "okay", "not ok 2 - e \\# f", "ok 18446744073709551615", "ok 99999999999999999999 x",
    "1..3", "1..0", "2..5", "3..1", "1..4 # why", "  ---", "  ...", "  key: v", "", "   ", "# note",
    "# Subtest: s", "  # Subtest: t", "TAP version 14", "TAP version 12", "\tindented", "junk",
    "Bail out! now", "bail OUT!", "pragma +strict", "pragma -strict", "pragma +other", "pragma *x",
]


def random_runs(n, size, seed):
    rng = random.Random(seed)
    runs = []
    for i in range(n):
        lines = []
        weights = [rng.choice((0, 1, 1, 3)) for _ in PIECES]
        if not any(weights):
            weights[0] = 1
        for _ in range(rng.randint(1, size)):
            depth = rng.choice((0, 0, 0, 1, 1, 2, 3)) if i % 3 else 0
            lines.append("    " * depth + rng.choices(PIECES, weights)[0])
        runs.append(lines)
    return runs


def as_lines(spark, runs):
    rows = [(i, n + 1, line) for i, run in enumerate(runs) for n, line in enumerate(run)]
    return spark.createDataFrame(rows, "run_id bigint, line_no int, line string")


def check(spark, runs, strict, block_lines):
    lines = as_lines(spark, runs)
    states = tap_states(lines, strict=strict, block_lines=block_lines)
    got = {r.run_id: r for r in states.filter(F.size("path") == 0).collect()}
    for i, run in enumerate(runs):
        want, _ = tap(run, strict)
        have = {c: got[i][c] for c in STATE_COLUMNS}
        want["planned"] = want["planned"] and min(want["planned"], 2**63 - 1)
        assert have == want, (strict, block_lines, run)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_lines", [4096, 5])
def test_random_runs_match_sequential_fold(spark, strict, block_lines):
    check(spark, random_runs(600, 14, 7 + block_lines), strict, block_lines)


def test_longer_nested_runs_cut_in_blocks(spark):
    check(spark, random_runs(60, 120, 3), False, 7)


def test_failures_are_top_level_points_in_order(spark):
    runs = random_runs(200, 12, 11)
    for block_lines in (4096, 4):
        got = {}
        for r in tap_failures(tap_events(as_lines(spark, runs), block_lines=block_lines)).collect():
            assert (r.source, r.suite, r.test_file, r.reason) == ("TAP", None, None, r.label)
            got.setdefault(r.run_id, []).append((r.line_no, r.label))
        for i, run in enumerate(runs):
            assert [label for _, label in sorted(got.get(i, []))] == tap(run)[1]
