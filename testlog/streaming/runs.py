"""Streaming versions: lines arrive while runs are still going on.

Input streams have one line per row: run_id, line_no, line, event_ts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from testlog.operators.durable import materialize
from testlog.operators.failures import dedup_key, render_failures
from testlog.operators.jsonlog import json_events, parse_lines
from testlog.schema import LOG_LINES
from testlog.streaming.close import stream_tap_runs

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTCOMES = ("passed", "failed", "skipped", "todo")


def stream_lines(
    spark: SparkSession, path: str, schema: str = LOG_LINES, format: str = "parquet", **options: str
) -> DataFrame:
    """Line files as they arrive in a directory."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def stream_events(lines: DataFrame) -> DataFrame:
    """Counted Go and nextest events with their time; stateless."""
    # the time stamp rides along in the run id column, which no parser looks into
    packed = lines.select(F.struct("run_id", "event_ts").alias("run_id"), "line_no", "line")
    events = json_events(parse_lines(packed)).filter(F.col("outcome").isNotNull())
    return events.select("run_id.*", *[c for c in events.columns if c != "run_id"])


def stream_failures(lines: DataFrame) -> DataFrame:
    """Failures as they come in, one row each (append mode)."""
    failed = stream_events(lines).filter(F.col("outcome") == "failed")
    return failed.select(
        "run_id", "event_ts", "line_no", F.lit(0).alias("item_no"), "source", "label", "suite",
        "test_file", "reason",
    )


def _counts() -> list:
    return [
        F.count("line_no").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
    ]


def stream_run_counts(lines: DataFrame) -> DataFrame:
    """Running counters per run (update or complete mode)."""
    return stream_events(lines).groupBy("run_id").agg(*_counts())


def stream_run_close(lines: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counters of a run once no line came for ``gap`` (append mode).

    Lines later than ``delay`` behind the newest are dropped and show in the
    query's progress metrics.
    """
    events = stream_events(lines.withWatermark("event_ts", delay))
    window = F.session_window("event_ts", gap)
    return (
        events.groupBy("run_id", window.alias("session"))
        .agg(*_counts())
        .select(
            "run_id",
            F.col("session.start").alias("started_at"),
            F.col("session.end").alias("closed_at"),
            "total",
            *OUTCOMES,
        )
    )


def stream_dedup(failures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First failure of each key per run; keys are forgotten behind the watermark."""
    return (
        failures.withColumn("key", dedup_key())
        .withWatermark("event_ts", delay)
        .dropDuplicatesWithinWatermark(["run_id", "key"])
        .drop("key")
    )


def stream_cap(
    lines: DataFrame, limit: int, delay: str = "10 minutes", idle_ms: int = 3_600_000
) -> DataFrame:
    """At most ``limit`` failing points per run from a stream of TAP lines, by the rules of the protocol.

    The delay must cover how far lines of different runs are apart in time; the session must keep streaming
    state in RocksDB (``rocksdb_state``).
    """
    rows = stream_tap_runs(lines, limit=limit, delay=delay, idle_ms=idle_ms).filter(~F.col("closed"))
    label = F.col("label")
    return rows.select(
        "run_id", "event_ts", F.col("line_no").cast("int").alias("line_no"), F.lit("TAP").alias("source"), label, label.alias("reason")
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streaming state in RocksDB, which several state variables per key need, while queries are started."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def message_id(batch_id: int) -> Column:
    """Names a message of a batch, the same when the batch is run again."""
    return F.sha2(F.concat_ws("|", F.lit(batch_id).cast("string"), "run_id", "kind", "title", "body", "copy"), 256)


def alert_sink(
    failures: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    ledger: str | None = None,
):
    """Send rendered failure messages batch by batch; ``write`` gets (messages, batch id).

    With ``ledger``, a folder, messages carry a ``message_id`` and what was sent is noted there, so that a
    batch that is run again after a failure sends only what was not sent before.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        named = batch if "project" in batch.columns else batch.withColumn(
            "project", F.lit(None).cast("string")
        )
        messages = render_failures(named)
        if ledger is None:
            write(messages, batch_id)
            return
        spark = batch.sparkSession
        # equal messages of one batch are told apart by number
        again = W.partitionBy("run_id", "kind", "title", "body").orderBy(F.lit(1))
        messages = messages.withColumn("copy", F.row_number().over(again))
        messages = materialize(messages.withColumn("message_id", message_id(batch_id)).drop("copy"))
        sent = spark.read.schema("message_id STRING, batch BIGINT").parquet(ledger) if _exists(spark, ledger) else None
        if sent is not None:
            messages = messages.join(sent.filter(F.col("batch") == batch_id), "message_id", "left_anti")
        write(messages, batch_id)
        messages.select("message_id", F.lit(batch_id).cast("bigint").alias("batch")).write.mode("append").partitionBy("batch").parquet(ledger)

    return failures.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
