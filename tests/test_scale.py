"""What keeps memory and time of large tables in bounds."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from testlog.functions.jsonvalue import json_value
from testlog.operators import jsonlog, tap
from testlog.operators.durable import materialize
from testlog.operators.failures import dedup_failures
from testlog.operators.lines import chunks_to_lines
from testlog.schema import FAILURE_COLUMNS, LOG_LINES
from testlog.streaming.close import FailurePolicy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_a_small_file_are_not_broadcast(spark):
    texts = [F.lit("the same").alias(f"c{k}") for k in range(20)]
    small = materialize(spark.range(1_000_000).select("id", *texts)).select("id")
    joined = spark.range(2_000_000).join(small, "id", "left_semi")
    assert joined.count() == 1_000_000
    assert "Broadcast" not in plan(joined)


def test_outline_of_json_runs_needs_no_sort(spark):
    lines = spark.createDataFrame([(1, 1, "[", None), (1, 2, "1,2", None), (1, 3, " ]", None), (2, 1, "{", None), (2, 2, "]", None)], LOG_LINES)
    outline = jsonlog.run_outline(lines)
    assert {r.run_id: r.maybe_document for r in outline.collect()} == {1: True, 2: False}
    assert "SortAggregate" not in plan(outline)


def test_no_window_ranks_a_whole_run(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("run_id"), F.lit(0).alias("stage"), F.lit("").alias("path"), F.col("id").cast("int").alias("line_no"),
        F.lit(0).alias("item_no"), F.lit("TAP").alias("source"), F.concat(F.lit("t"), F.col("id") % 600).alias("label"),
        *[F.lit(None).cast("string").alias(c) for c in FAILURE_COLUMNS[5:]],
    )
    kept = dedup_failures(rows, remembered=100)
    # of 300 keys a run the first 100 are known, all rows of the others stay
    assert kept.groupBy("run_id").count().collect() == [(0, 100 + 200 * 5), (1, 100 + 200 * 5)]
    assert "pmod(xxhash64(key" in plan(kept)


class State:
    """A value and a map as the state store keeps them, counting the calls made."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Keys(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer


class Keys:
    def __init__(self, state):
        self.state = state

    def containsKey(self, key):
        self.state.calls += 1
        return key in self.state.map

    def updateValue(self, key, value):
        self.state.calls += 1
        self.state.map[key] = value

    def keys(self):
        self.state.calls += 1
        return iter(list(self.state.map))


def test_policy_on_a_stream_does_not_ask_the_state_for_every_failure():
    state = State()
    policy = FailurePolicy(["line_no"], dedup=True, limit=2500, remembered=50, idle_ms=1000)
    policy.init(state)
    sent, known, want = [], set(), []
    for batch in range(3):
        rows = [(1000 * batch + n, f"k{(n * n + batch) % 90}") for n in range(1000)]
        for n, key in rows:  # the rule, failure by failure
            new = key not in known
            if new and len(known) < 50:
                known.add(key)
            if new and len(want) < 2500:
                want.append(n)
        table = pd.DataFrame(rows[::-1], columns=["line_no", "key"]).assign(item_no=0, event_ts=pd.Timestamp(datetime(2024, 1, 1)))
        for out in policy.handleInputRows((1,), iter([table[:300], table[300:]]), None):
            sent += out["line_no"].tolist()
    assert sent == want
    assert state.calls <= 50 + 3


NESTED = ["1..2", "# Subtest: a", "    ok 3", "    ok", "    # Subtest: b", "        not ok 9 # TODO", "    not ok 7", "ok 2", "ok", "Bail out! x"]


def test_streams_of_short_runs_are_counted_without_events(spark):
    runs = {1: NESTED, 2: NESTED[1:5], None: ["TAP version 13", "ok", "ok 18446744073709551615", "ok"], 4: NESTED * 3}
    rows = [(run, n + 1, line) for run, lines in runs.items() for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows + [rows[0], rows[2]], "run_id bigint, line_no int, line string")
    want = sorted(tap.tap_stream_states(tap.tap_events(lines)).collect(), key=str)
    streams = tap.line_stream_states(lines)
    assert sorted(streams.collect(), key=str) == want
    assert "Window" not in plan(streams) and "collect_list" not in plan(streams)
    assert sorted(tap.line_stream_states(lines, block_lines=12).collect(), key=str) == want


def test_lines_within_chunks_are_cut_once(spark):
    chunks = [(1, 0, "a\r"), (1, 1, "\nb\n\nc\r\n"), (2, 5, "d\n"), (2, 6, ""), (2, 7, "e\n")]
    shape = "run_id bigint, seq bigint, chunk string"
    lines = chunks_to_lines(spark.createDataFrame(chunks, shape))
    got = sorted((r.run_id, r.line_no, r.line, r.bytes) for r in lines.collect())
    assert got == [(1, 1, "a", 3), (1, 2, "b", 2), (1, 3, "", 1), (1, 4, "c", 3), (2, 1, "d", 2), (2, 2, "e", 2)]
    assert "Union" not in plan(lines)
    crossing = chunks_to_lines(spark.createDataFrame([*chunks, (2, 8, "f"), (2, 9, "g")], shape))
    assert sorted((r.run_id, r.line_no, r.line, r.bytes) for r in crossing.collect()) == [*got, (2, 3, "fg", 2)]


def test_one_value_is_parsed_once(spark):
    lines = spark.createDataFrame([(1, 1, "{}"), (1, 2, "{},{}"), (1, 3, "[1] [2]"), (1, 4, "[1]]"), (1, 5, "[[1]] ]")], "run_id bigint, line_no int, line string")
    assert [r.line_no for r in jsonlog.parse_lines(lines).collect()] == [1]
    assert str(json_value(F.col("line"))).count("try_parse_json") == 1
