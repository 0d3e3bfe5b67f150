"""Values of documents are whole, whatever the size of the document."""

import json

import pytest
from pyspark.sql import functions as F

from testlog.operators import jsonlog
from tests.test_document_blocks import lines_of

# no line of these is a value by itself
ENTRIES = [{"name": f"s{i} }} ]", "status": "failed", "assertionResults": [{"title": "t", "x": {"y": i}}]} for i in range(12)]
DOCUMENT = {"numTotalTests": 3, "stats": {"tests": 12, "other": {"z": "["}}, "more": {"deep": [{"a": 1}]}, "testResults": ENTRIES}
TEXTS = (json.dumps(DOCUMENT, indent=1), json.dumps(ENTRIES, indent=2), json.dumps(DOCUMENT, indent=1)[:-1], '{"a":\n1}', '\n{"Action":"pass","Test":"t"}', "\n")


@pytest.mark.parametrize("limit", [-1, 1 << 10, 1 << 20])
def test_values_do_not_depend_on_size(spark, monkeypatch, limit):
    monkeypatch.setattr(jsonlog, "GATHERED_BYTES", limit)
    values = jsonlog.json_values(lines_of(spark, *TEXTS)).select("run_id", F.to_json("v").alias("v")).collect()
    found = {r.run_id: json.loads(r.v)["v"] for r in values}
    assert found == {0: DOCUMENT, 1: ENTRIES, 3: {"a": 1}, 4: {"Action": "pass", "Test": "t"}}


def test_a_document_that_no_value_can_hold_is_not_left_out(spark, monkeypatch):
    monkeypatch.setattr(jsonlog, "GATHERED_BYTES", 1)
    monkeypatch.setattr(jsonlog, "json_value", lambda text: F.lit(None).cast("variant"))
    lines = lines_of(spark, *TEXTS)
    outline = spark.createDataFrame([(i, True, 9) for i in range(len(TEXTS))], "run_id int, maybe_document boolean, bytes int")
    broken = jsonlog.whole_documents(lines.filter("run_id = 2"), outline)
    assert broken.collect() == []
    with pytest.raises(Exception, match="too large for one value: run 0"):
        jsonlog.whole_documents(lines.filter("run_id = 0"), outline).collect()
