"""Long documents are cut block by block: no row per token, and blocks of any size give the same."""

import json

from pyspark.sql import functions as F

from testlog.functions.jsonvalue import json_value
from testlog.operators import jsondoc, jsonlog

ENTRIES = [{"name": f"s{i} }} ] \\\" {{", "status": "failed", "x": {"y": [1, [2, {"z": list(range(9))}]]}} for i in range(12)]
DOCUMENT = {"numTotalTests": 3, "stats": {"tests": 12, "list": [1, 2]}, "testResults": ENTRIES}


def lines_of(spark, *texts):
    rows = [(run, at + 1, line) for run, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "run_id int, line_no int, line string")


def scanned(lines):
    found = jsondoc.scan_documents(lines)
    values = {r.run_id: json.loads(r.v) for r in found.values.select("run_id", F.to_json("v").alias("v")).collect()}
    entries = found.entries.select("run_id", "place", F.to_json("v").alias("v")).orderBy("run_id", "place").collect()
    return values, [(r.run_id, json.loads(r.v)["v"]) for r in entries]


def test_blocks_of_any_size(spark, monkeypatch):
    pretty = json.dumps(DOCUMENT, indent=1)
    texts = (pretty, pretty.replace("\n", "\n\n"), pretty[:-1], pretty + "\n]", json.dumps(ENTRIES, indent=2), "\n{\n}\n")
    lines = lines_of(spark, *texts)
    slim = {"numTotalTests": 3, "stats": {"tests": 12, "list": None}}
    whole = scanned(lines)
    assert whole[1] == [(run, e) for run in (0, 1) for e in ENTRIES]
    assert sorted(whole[0]) == [0, 1, 4, 5]
    assert whole[0][0]["v"]["numTotalTests"] == slim["numTotalTests"]
    for size in (1, 3, 7):
        monkeypatch.setattr(jsondoc, "BLOCK_LINES", size)
        assert scanned(lines) == whole


def test_no_row_per_token(spark, monkeypatch):
    stored = []

    def counted(df, store=jsondoc.materialize):
        out = store(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(jsondoc, "materialize", counted)
    text = json.dumps(DOCUMENT, indent=1)
    assert len(scanned(lines_of(spark, text))[1]) == len(ENTRIES)
    assert max(stored) < text.count("\n") / 4


def test_line_feeds_and_open_strings_within_a_line():
    block = jsondoc._Block(1, 0, 0)
    rows = [*block.feed(['{"a\n\\"b": "c', 'd", "e": 1', "}"])]
    # a string ends with its line at the latest: the comma in the second line stands within one
    assert [(r[3], r[6]) for r in rows] == [("", "{"), ('"a\n\\"b": "c\nd", "e": 1\n', "}")]


def test_members_are_no_values(spark):
    texts = ['"a"', '"a\\"b"', '"a": "b"', '"a" "b"', '"\\\\"', '"\\"', '"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", json_value(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()
    assert [r.ok for r in found] == [True, True, False, False, True, False, False]


def test_lines_of_few_runs_are_dealt_to_many_parts(spark):
    lines = spark.createDataFrame([(run, at, "x") for run in (1, 2, 3) for at in range(1, 101)], "run_id int, line_no int, line string")
    outline = spark.createDataFrame([(1, True, 9), (2, False, 9), (3, True, 5)], "run_id int, maybe_document boolean, bytes int")
    one, many = (jsonlog._candidates(lines, outline, F.col("bytes") > 6, parts) for parts in (1, jsonlog.LONG_PARTS))
    assert many.columns == lines.columns
    assert sorted(many.collect()) == sorted(one.collect()) == sorted(lines.filter("run_id = 1").collect())
    assert "hashpartitioning(run_id" in (plan := many._jdf.queryExecution().executedPlan().toString())
    assert ", part#" in plan
