"""JUnit reports of any shape, deep TAP subtests, piped runs and blank JSON logs."""

from pyspark.sql import functions as F

from testlog.operators import junit
from testlog.operators.jsonlog import json_run_state
from testlog.operators.runs import run_verdict
from testlog.operators.tap import tap_run_state
from tests.brute import tap

REPORTS = {
    "deep": "<testsuite name='a'>" * 9 + "<testcase name='t'><failure message='m'/></testcase>" + "</testsuite>" * 9,
    "wrapped": "<report><group><testsuite name='s'><x><testcase name='t'/></x></testsuite></group></report>",
    "nested_root": "<testsuites><testsuites><testsuite><testcase/></testsuite></testsuites></testsuites>",
    "order": "<testsuite name='o'><testsuite name='i'><testcase name='1'><error/></testcase></testsuite>"
             "<testcase name='2'><error/></testcase></testsuite>",
    "cdata": "<testsuite><testcase name='c'><failure><![CDATA[\n <error code=1> raised]]></failure><error/></testcase></testsuite>",
    "two_roots": "<testsuite/><testsuite/>",
    "skip_wins": "<testsuite><testcase><failure/><skipped/></testcase></testsuite>",
    "doctype": "<!DOCTYPE x><testsuite><testcase/></testsuite>",
    "empty": "",
}


def test_junit_shapes(spark):
    rows = [(k, k, v) for k, v in REPORTS.items()] + [("null", "null", None)]
    reports = spark.createDataFrame(rows, "run_id string, path string, content string")
    states = {r.run_id: r for r in junit.junit_run_state(reports).collect()}
    counts = {k: (s.total, s.passed, s.failed, s.skipped, s.parse_warning_count) for k, s in states.items()}
    assert counts == {
        "deep": (1, 0, 1, 0, 0), "wrapped": (1, 1, 0, 0, 0), "nested_root": (1, 1, 0, 0, 0), "order": (2, 0, 2, 0, 0),
        "cdata": (1, 0, 1, 0, 0), "two_roots": (0, 0, 0, 0, 1), "skip_wins": (1, 0, 0, 1, 0), "doctype": (0, 0, 0, 0, 1),
        "empty": (0, 0, 0, 0, 1), "null": (0, 0, 0, 0, 1),
    }
    cases = {(r.run_id, r.case_no): r for r in junit.junit_cases(reports).collect()}
    assert [cases["order", k].label for k in (0, 1)] == ["1", "2"]
    assert (cases["order", 0].suite, cases["order", 1].suite) == ("i", "o")
    assert cases["cdata", 0].reason == "<error code=1> raised"
    assert cases["nested_root", 0].label == junit.UNNAMED_CASE


def test_subtests_of_any_depth(spark):
    depth = 8
    lines = ["TAP version 14"]
    for k in range(depth):
        lines.append("    " * k + f"# Subtest: level {k}")
    lines.append("    " * depth + "not ok 1 - inner")
    lines.append("    " * depth + "1..1")
    for k in reversed(range(depth)):
        lines.append("    " * k + f"not ok 1 - level {k}")
        lines.append("    " * k + "1..1")
    rows = [(1, i, line) for i, line in enumerate(lines, 1)]
    rows += [(2, i, line) for i, line in enumerate(["    " * k + "# Subtest: open" for k in range(6)], 1)]
    table = spark.createDataFrame(rows, "run_id int, line_no int, line string")
    got = {r.run_id: r for r in tap_run_state(table).collect()}
    for run in (1, 2):
        expected, _ = tap([line for r, _, line in rows if r == run], False)
        for key in ("total", "failed", "protocol_failures", "parse_warning_count"):
            assert got[run][key] == expected[key], (run, key)


def test_piped_runs_have_no_child(spark):
    states = spark.createDataFrame(
        [(1, None, 1, 1, 0, 0, 0, None, 0, 0), (2, None, 1, 1, 0, 0, 0, None, 0, 0), (3, None, 1, 0, 1, 0, 0, None, 0, 0)],
        "run_id int, planned long, total long, passed long, failed long, todo long, skipped long, "
        "bailout_reason string, parse_warning_count long, protocol_failures long",
    )
    runs = spark.createDataFrame(
        [(1, None, None), (2, ["npm"], None), (3, None, None)], "run_id int, command array<string>, exit_code int"
    )
    codes = {r.run_id: r.exit_status for r in run_verdict(states, runs).collect()}
    assert codes == {1: 0, 2: 1, 3: 1}


def test_blank_json_log_has_a_state(spark):
    lines = spark.createDataFrame([(1, 1, "  "), (1, 2, ""), (2, 1, "noise")], "run_id int, line_no int, line string")
    warnings = {r.run_id: r.parse_warning_count for r in json_run_state(lines).collect()}
    assert warnings == {1: 0, 2: 1}
