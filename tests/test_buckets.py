"""Runs on a stream are taken bucket by bucket: calls to the state do not grow with the runs in a bucket."""

import json
from datetime import datetime
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from testlog.plans import stream_queries
from testlog.schema import LOG_LINES
from testlog.streaming import close
from tests.test_held_lines import EARLY, Calls

TOKEN = dict.fromkeys(close.TOKEN_NAMES) | {"spaces": 0, "tab": False, "kind": close.KINDS.index("point"), "ok": True}
FACT = {"line": "x", "valid": False, "outcome": None, "kind": None, "doc": None}


class State:
    """What a processor gets: every variable counts its calls in ``calls``."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getValueState(self, name, *_):
        return self.kept.setdefault(name, Kept(self))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getExpiryTimeInMs(self):
        return self.timers.pop()

    def getCurrentWatermarkInMs(self):
        return 1 << 60


class Kept(Calls):
    def __init__(self, state):
        super().__init__()
        self.state = state

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "containsKey", "getValue", "updateValue", "removeKey", "iterator"):
            object.__getattribute__(self, "state").calls += 1
        return super().__getattribute__(name)

    def clear(self):
        self.value, self.map = None, {}


def play(processor, runs, parts, extra):
    state, out = State(), []
    processor.init(state)
    for numbers in parts:
        rows = [
            {"run": str(run), "line_no": n, "event_us": 10**15 + n, "event_ts": pd.Timestamp(datetime(2024, 1, 1)), **extra, **({"line": str(n)} if "line" in extra else {})}
            for n in numbers for run in range(runs)
        ]
        out += processor.handleInputRows((1,), iter([pd.DataFrame(rows)]), None)
    calls = state.calls
    out += processor.handleExpiredTimer((1,), state, state)
    return calls, pd.concat(out), state


def taps(runs, parts=EARLY):
    return play(close.TapBuckets(False, 0, 1000), runs, parts, TOKEN)


def jsons(runs, parts=EARLY):
    return play(close.JsonRuns(1000), runs, parts, FACT)


@pytest.mark.parametrize("work", [taps, jsons])
def test_calls_do_not_grow_with_runs(work):
    few, many = work(1), work(200)
    assert many[0] == few[0] <= 10
    assert sorted(many[1]["run_id"]) == [*range(200)]


@pytest.mark.parametrize("limit", [1 << 24, 300, 0])
def test_what_waits_past_the_limit_is_kept_in_rows(monkeypatch, limit):
    monkeypatch.setattr(close, "BUCKET_CHARS", limit)
    _, ended, state = taps(5, [*EARLY, [13, 12]])
    assert (ended["total"].tolist(), ended["line_no"].tolist()) == ([12] * 5, [13] * 5)
    _, read, kept = jsons(5, [*EARLY, [5, 6]])
    assert read["document"].tolist() == ["\n".join(map(str, range(1, 11)))] * 5
    for s in (state, kept):
        assert not any(k.map or k.value for k in s.kept.values()) and not s.timers


def test_only_ended_runs_leave_a_bucket():
    state = State()
    runs = close.TapBuckets(False, 0, 1000)
    runs.init(state)
    rows = [{"run": str(run), "line_no": 1, "event_us": us, "event_ts": pd.NaT, **TOKEN} for run, us in ((7, 5_000_000), (8, 1_000_000))]
    list(runs.handleInputRows((1,), iter([pd.DataFrame(rows)]), None))
    assert state.timers == [2000]
    state.getCurrentWatermarkInMs = lambda: 3000
    [out] = runs.handleExpiredTimer((1,), state, state)
    assert out["run_id"].tolist() == [8] and out["event_us"].tolist() == [1_000_000] and state.timers == [6000]
    assert [*json.loads(state.kept["bucket"].value[0])] == ["7"]


@pytest.mark.parametrize("size", [1 << 20, 4])
def test_parts_are_batches_of_as_many_files(spark, monkeypatch, size):
    monkeypatch.setattr(stream_queries, "FILE_LINES", size)
    lines = spark.range(1, 401).select(
        (F.col("id") % 4).alias("run_id"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"),
        F.timestamp_seconds("id").alias("event_ts"),
    )
    given = []
    scratch = stream_queries._scratch
    monkeypatch.setattr(stream_queries, "_scratch", lambda *a: given.append(scratch(*a)) or given[-1])
    assert stream_queries._in_parts(spark, lines).isStreaming
    files = sorted(Path(urlparse(given[0]).path).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    each, rest = divmod(len(files), stream_queries.PARTS)
    assert rest == 1 and (each > 1) == (size == 4)
    counts = [spark.read.schema(LOG_LINES).parquet(str(f)).count() for f in files]
    assert all(counts) and sum(counts) == 401 and counts[-1] == 1


def test_a_line_without_time_counts_and_ends_no_run():
    state = State()
    runs = close.TapBuckets(False, None, 1000)
    runs.init(state)
    failing = TOKEN | {"ok": False, "description": "d"}
    rows = [{"run": run, "line_no": n, "event_us": us, "event_ts": pd.NaT, **failing} for run, n, us in (("7", 1, 5_000_000), ("7", 2, None), (None, 1, 5_000_000))]
    [out] = runs.handleInputRows((1,), iter([pd.DataFrame(rows)]), None)
    assert [(r.run_id, r.line_no) for r in out.itertuples()][:2] == [(7, 1), (7, 2)] and pd.isna(out["run_id"].iloc[2])
    assert state.timers == [6000] and type(state.timers[0]) is int
    assert out["event_us"].isna().tolist() == [False, True, False]
