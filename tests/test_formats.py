"""JSON, Bun and JUnit operators on small retyped samples."""

import json

from testlog.operators.bun import bun_events, bun_failures, bun_run_state
from testlog.operators.jsonlog import json_failures, json_run_state
from testlog.operators.junit import junit_cases, junit_report_state

COLUMNS = ("total", "passed", "failed", "todo", "skipped", "parse_warning_count")


def lines_of(spark, runs):
    rows = [(i, n + 1, line) for i, run in enumerate(runs) for n, line in enumerate(run)]
    return spark.createDataFrame(rows, "run_id bigint, line_no int, line string")


def states(df):
    return {r.run_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def doc(total, passed, failed, todo=0, **more):
    return {"numTotalTests": total, "numPassedTests": passed, "numFailedTests": failed, "numTodoTests": todo, **more}


JSON_RUNS = [
    (['{"Action":"pass","Test":"a"}', '{"Action":"fail","Test":"b","Output":"x"}', '{"Action":"pass"}'], (2, 1, 1, 0, 0, 0)),
    (['{"Action":5,"type":"test","event":"ok"}', '{"type":"test","event":{"status":"failed"}}'], (2, 1, 1, 0, 0, 0)),
    (['{"a":1} junk', '{"type":"test","event":"todo"}', "noise", "noise"], (1, 0, 0, 1, 0, 1)),
    ([json.dumps(doc(5, 3, 1, 1)), '{"stats":{"tests":4,"passes":4}}'], (4, 4, 0, 1, 0, 0)),
    ([json.dumps(doc(5, 3, 2)), '{"Action":"skip","Test":"a"}', json.dumps(doc(9, 9, 0))], (6, 3, 2, 0, 1, 0)),
    (json.dumps(doc(2, 1, 1), indent=2).split("\n"), (2, 1, 1, 0, 0, 0)),
    (["{", "oops"], (0, 0, 0, 0, 0, 1)),
    (['{"Action":"pass","Action":"fail","Test":"a"}'], (1, 0, 1, 0, 0, 0)),
    (['{"numTotalTests":1.0,"numPassedTests":-1}', "[1]"], (0, 0, 0, 0, 0, 0)),
]


def test_json_states(spark):
    got = states(json_run_state(lines_of(spark, [run for run, _ in JSON_RUNS])))
    assert got == {i: want for i, (_, want) in enumerate(JSON_RUNS)}


def test_json_failures(spark):
    assertion = {"status": "failed", "title": "t", "failureMessages": ["\n  " + "y" * 170]}
    entries = [
        {"name": "f.js", "assertionResults": [assertion, {"status": "passed"}]},
        {"status": "failed", "title": "suite", "message": " "},
        {"status": "failed", "name": "g.js", "assertionResults": []},
    ]
    runs = [[json.dumps(doc(2, 0, 2, testResults=entries))], ['{"Action":"fail","Test":"T","Output":" \\n "}']]
    rows = {(r.run_id, r.item_no): r for r in json_failures(lines_of(spark, runs)).collect()}
    assert set(rows) == {(0, 0), (0, 2), (1, 0)}
    first, second, third = rows[0, 0], rows[0, 2], rows[1, 0]
    assert (first.label, first.suite, first.test_file, first.reason) == ("t", "f.js", "f.js", "y" * 160 + "...")
    assert (second.label, second.suite, second.test_file, second.reason) == ("suite", "suite", None, "suite")
    assert (third.label, third.reason) == ("T", "unknown")


BUN_RUNS = [
    (["bun test v1", "(pass) a", "(fail) divides [1ms]", " 1 pass", " 1 fail", "Ran 2 tests"], (2, 1, 1, 0, 0, 0), ["divides"]),
    (["..F s", "failures:", "- x", "* y:", "Ran 3 tests", "2 skip", "(fail) z"], (8, 2, 4, 0, 2, 0), ["x", "Ran 3 tests", "z"]),
    (["✗ a", "× [b]", "(fail)"], (1, 0, 1, 0, 0, 0), ["a"]),
    (["7 of them", "3 tests passed", "4 (failed)", "5 xx todo."], (3, 0, 4, 5, 0, 0), []),
]


def test_bun(spark):
    for block_lines in (4096, 2):
        lines = lines_of(spark, [run for run, _, _ in BUN_RUNS])
        got = states(bun_run_state(lines, block_lines=block_lines))
        assert got == {i: want for i, (_, want, _) in enumerate(BUN_RUNS)}
        labels = {}
        for r in sorted(bun_failures(bun_events(lines, block_lines=block_lines)).collect()):
            labels.setdefault(r.run_id, []).append(r.label)
        assert labels == {i: want for i, (_, _, want) in enumerate(BUN_RUNS) if want}


XML = [
    '<testsuite name="s"><testcase name="a"/><testcase classname="C" name="b"><error>\n boom\n x</error>'
    '<failure message="m"/></testcase></testsuite>',
    '<testsuites><testsuite name="o" file="f"><testsuite><testcase name=" "><failure/></testcase></testsuite>'
    "</testsuite></testsuites>",
    "<testsuite><testcase></testsuite>",
    "",
    "hello",
    '<testsuite><testcase name="k"><skipped message="w"/><failure/></testcase></testsuite>',
]


def test_junit(spark):
    rows = [(i, f"r{i}.xml", None, x) for i, x in enumerate(XML)]
    reports = spark.createDataFrame(rows, "run_id bigint, path string, modified timestamp, content string")
    assert states(junit_report_state(reports)) == {
        0: (2, 1, 1, 0, 0, 0), 1: (1, 0, 1, 0, 0, 0), 2: (0, 0, 0, 0, 0, 1),
        3: (0, 0, 0, 0, 0, 1), 4: (0, 0, 0, 0, 0, 1), 5: (1, 0, 0, 0, 1, 0),
    }
    failed = {r.run_id: r for r in junit_cases(reports).filter("status = 'failed'").collect()}
    assert (failed[0].label, failed[0].suite, failed[0].reason) == ("C::b", "s", "boom")
    assert (failed[1].label, failed[1].suite, failed[1].test_file, failed[1].reason) == (
        "unnamed testcase", "o", "f", None,
    )
