"""Run states and failures at the end of runs on streams equal those of the batch operators."""

import json
import random
from datetime import datetime, timedelta

import pytest

from testlog.operators import jsonlog, tap
from testlog.schema import LOG_LINES, STATE_COLUMNS
from testlog.streaming import close, runs
from tests.test_documents import random_document, spread

START = datetime(2024, 1, 1)
TAP = [
    "ok 1 - a", "not ok 2 - b", "ok", "not ok # TODO later", "ok 4 # SKIP", "okay", "1..3", "1..2", "2..1", "1..0", "  ---", "  ...",
    "  x: 1", "", "  ", "# Subtest: s", "    # Subtest: t", "    ok 1", "    1..1", "    not ok", "        ok 1", "        1..1", "# note",
    "TAP version 14", "TAP version 12", "Bail out! now", "    Bail out!", "pragma +strict", "pragma -strict", "pragma +x", "\t", "junk", " x",
    "ok 18446744073709551615", "ok 7", "    ---", "     ok",
]


@pytest.fixture
def rocks(spark):
    keys = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": "3",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, folder, runs, work, rng):
    """Lines arrive in five files, those of a run partly out of order and one of them twice; a last
    line much later ends all runs."""
    rows = []
    for run, lines in enumerate(runs):
        for n, line in enumerate(lines, 1):
            row = (run, n, line, START + timedelta(seconds=n))
            rows.append((min(4, max(0, 5 * n // (len(lines) + 1) + rng.choice([0, 0, 1, -1]))), row))
            if rng.random() < 0.05:
                rows.append((rows[-1][0], row))
    for part in range(6):
        mine = [r for p, r in rows if p == part] if part < 5 else [(-1, 1, "ok", START + timedelta(days=9))]
        spark.createDataFrame(mine, LOG_LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LOG_LINES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    job = (
        work(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    job.awaitTermination()
    assert sum(p.numInputRows > 0 for p in job.recentProgress) >= 4
    return spark.read.parquet(f"{folder}/out").collect()


def batch_lines(spark, runs):
    rows = [(i, n, line) for i, lines in enumerate(runs) for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "run_id bigint, line_no int, line string")


def states(rows):
    return {r.run_id: tuple(r[c] for c in STATE_COLUMNS) for r in rows}


@pytest.mark.parametrize("strict", [False, True])
def test_tap(spark, rocks, tmp_path, strict):
    rng = random.Random(8)
    weights = [6 if t.lstrip().startswith(("ok", "not ok")) else 2 for t in TAP]
    runs = [rng.choices(TAP, weights, k=rng.randrange(1, 25)) for _ in range(250)]
    runs += [[f"ok {i}" for i in rng.sample(range(1, 60), 50)] + ["1..50"]]
    lines = batch_lines(spark, runs)
    events = tap.tap_events(lines, strict)
    want = states(tap.rollup_subtests(tap.tap_stream_states(events)).filter("size(path) = 0").collect())
    got = streamed(spark, str(tmp_path), runs, lambda s: close.stream_tap_runs(s, strict), rng)
    closed = states(r for r in got if r.closed)
    for run, state in want.items():
        assert closed[run] == state, (runs[run], closed[run], state)
    failures = sorted((r.run_id, r.line_no, r.label) for r in tap.tap_failures(events).collect())
    assert sorted((r.run_id, r.line_no, r.label) for r in got if not r.closed) == failures


def test_json(spark, rocks, tmp_path):
    rng = random.Random(9)
    pieces = [
        '{"Action":"pass","Test":"a"}', '{"Action":"fail","Test":"b"}', '{"type":"test","event":"ignored"}', "noise", "  ", "[1]",
        '{"numTotalTests":5,"numPassedTests":3,"numTodoTests":2}', '{"stats":{"tests":4,"passes":4}}', '{"a":1', "7",
    ]
    runs = [rng.choices(pieces, k=rng.randrange(1, 14)) for _ in range(120)]
    runs += [("\n" + spread(json.dumps(random_document(rng), indent=1), rng)).replace("\r", "").split("\n") for _ in range(60)]
    want = states(jsonlog.json_run_state(batch_lines(spark, runs)).collect())
    got = states(streamed(spark, str(tmp_path), runs, close.stream_json_close, rng))
    for run, state in want.items():
        if any(line.strip() for line in runs[run]):  # a run of blank lines does not show on a stream
            assert got[run] == state, (runs[run], got[run], state)


def test_ids():
    rng = random.Random(1)
    ids, plain = close.Ids([]), set()
    for _ in range(3000):
        n = rng.randrange(400)
        assert ids.add(n) == (n in plain)
        plain.add(n)
    assert sorted(plain) == [n for low, high in ids.ranges for n in range(low, high + 1)]
    assert all(a[1] + 1 < b[0] for a, b in zip(ids.ranges, ids.ranges[1:]))


def failure_rows(run, labels):
    return [
        (run, START + timedelta(seconds=n), n, 0, "TAP", label, None, None, label) for n, label in enumerate(labels, 1)
    ]


FAILURE = (
    "run_id bigint, event_ts timestamp, line_no int, item_no int, source string, label string, suite string, "
    "test_file string, reason string"
)


def test_only_so_many_keys_are_remembered_on_a_stream(spark, rocks, tmp_path):
    rows = []
    for run, keys in ((1, 4096), (2, 4200)):
        rows += failure_rows(run, [f"t{k}" for k in range(keys)] + ["t0", "t4095", f"t{keys - 1}"])
    rows.sort(key=lambda r: r[2])
    for part in range(4):
        size = -(-len(rows) // 4)
        spark.createDataFrame(rows[part * size : (part + 1) * size], FAILURE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FAILURE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for limit, want in ((None, {1: 4096, 2: 4201}), (7, {1: 7, 2: 7}), (0, {})):
        job = (
            close.stream_policy(stream, limit=limit).writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/state{limit}").trigger(availableNow=True).start(f"{tmp_path}/out{limit}")
        )
        job.awaitTermination()
        out = spark.read.schema(FAILURE).parquet(f"{tmp_path}/out{limit}")
        assert dict(out.groupBy("run_id").count().collect()) == want


def test_a_batch_run_again_sends_nothing_twice(spark, tmp_path):
    rows = failure_rows(1, ["a", "a", "b"]) + failure_rows(2, ["a"])
    spark.createDataFrame(rows, FAILURE).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FAILURE).parquet(f"{tmp_path}/in")
    sent = []

    def write(messages, batch_id):
        sent.append(sorted((r.run_id, r.body) for r in messages.collect()))
        if len(sent) == 1:
            raise RuntimeError("lost after sending nothing")

    for attempt in range(3):
        job = (
            runs.alert_sink(stream, write, f"{tmp_path}/state{attempt // 2 and 9}", f"{tmp_path}/ledger")
            .trigger(availableNow=True).start()
        )
        try:
            job.awaitTermination()
        except Exception:
            assert attempt == 0
    # the first attempt failed before anything was noted, the last one has lost its checkpoint
    assert len(sent[1]) == 4 and sent[2] == []
