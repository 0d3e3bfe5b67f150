"""Streaming queries over the driver's event and line-item tables.

Each one reads a table as a file stream, runs to the end of the available input
and returns what the sink received.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.operators.durable import materialize, session_folder
from testlog.operators.lines import stored_lines
from testlog.plans import fixtures
from testlog.plans.catalog import query
from testlog.plans.report_queries import NO_PLAN, ZEROES
from testlog.plans.tap_queries import ITEM_ORDER
from testlog.streaming import close
from testlog.streaming import runs as st


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of Go test lines; the event id numbers the lines."""
    schema = fixtures.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").cast("int").alias("line_no"),
        fixtures.go_line().alias("line"),
        F.col("ts").cast("timestamp").alias("event_ts"),
    )


def _run(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Append the stream's output to a table and read it back."""
    out = _scratch(spark, "out")
    job = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", _scratch(spark, "state"))
        .trigger(availableNow=True)
        .start(out)
    )
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _run_updates(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Collect update-mode output; the last batch's row per run stands."""
    out = _scratch(spark, "updates")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    job = (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", _scratch(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    columns = [c for c in df.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in columns]
    )


@query(
    "stream_failures",
    """
    SELECT user_id AS run_id, 'T' || event_id AS label, 'pkg/' || (user_id % 7) AS suite,
           CASE WHEN event_id % 2 = 0 THEN 'boom ' || event_id ELSE 'T' || event_id END AS reason
    FROM events WHERE event_type = 'error'
    """,
)
def stream_failures(spark, sf_dir):
    out = _run(st.stream_failures(_event_lines(spark, sf_dir)), spark)
    return out.select("run_id", "label", "suite", "reason")


@query(
    "stream_run_counts",
    """
    SELECT user_id AS run_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS passed,
           count(*) FILTER (event_type = 'error') AS failed,
           count(*) FILTER (event_type = 'signup') AS skipped, CAST(0 AS BIGINT) AS todo
    FROM events WHERE event_type IN ('click', 'error', 'signup') GROUP BY user_id
    """,
)
def stream_run_counts(spark, sf_dir):
    return _run_updates(st.stream_run_counts(_event_lines(spark, sf_dir)), spark)


@query(
    "stream_run_close",
    """
    WITH e AS (
      SELECT user_id AS run_id, CAST(ts AS TIMESTAMP) AS ts, event_type,
             CAST(ts AS TIMESTAMP) >= lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS opens
      FROM events WHERE event_type IN ('click', 'error', 'signup')),
    s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY run_id ORDER BY ts) AS session FROM e),
    c AS (
      SELECT run_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS closed_at, count(*) AS total,
             count(*) FILTER (event_type = 'click') AS passed, count(*) FILTER (event_type = 'error') AS failed,
             count(*) FILTER (event_type = 'signup') AS skipped, CAST(0 AS BIGINT) AS todo
      FROM s GROUP BY run_id, session)
    SELECT * FROM c WHERE closed_at <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 10 MINUTE
    """,
)
def stream_run_close(spark, sf_dir):
    return _run(st.stream_run_close(_event_lines(spark, sf_dir)), spark)


PARTS = 4
FILE_LINES = 1 << 12  # lines in a file of the smallest part, at least; fewer stand in one


def _in_parts(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines (run_id, line_no, line, event_ts) as a stream of one part per batch: runs are spread over the
    batches, some lines come a batch early, and a line a month later ends all runs.  A part is as many files
    as any other, and none of them is empty, so that a batch is always one part."""
    path = _scratch(spark, "lines")
    n = F.col("line_no")
    part = F.least(F.pmod(F.col("run_id"), F.lit(2)) + n % 3, F.lit(PARTS - 2)) + F.when(n % 7 == 0, 0).otherwise(1)
    lines = materialize(lines.withColumn("part", part))
    sizes = [r["count"] for r in lines.filter(F.col("part").isNotNull()).groupBy("part").count().collect()]
    files = max(min(sizes) // FILE_LINES, 1) if len(sizes) == PARTS else 1
    last = lines.agg(F.max("event_ts").alias("t")).select(
        F.lit(-1).cast("bigint").alias("run_id"), F.lit(1).alias("line_no"), F.lit("end of input").alias("line"),
        (F.col("t") + F.expr("INTERVAL 30 DAYS")).alias("event_ts"),
    )
    for k in range(PARTS):
        lines.filter(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return st.stream_lines(spark, path, maxFilesPerTrigger=str(files))


@query(
    "stream_tap_close",
    f"""
    WITH r AS (
      SELECT l_orderkey AS run_id, l_returnflag, l_partkey,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS rn
      FROM lineitem)
    SELECT run_id, CAST(count(*) AS BIGINT) AS planned, count(*) AS total,
           count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag = 'R') AS failed,
           CAST(0 AS BIGINT) AS todo, count(*) FILTER (l_returnflag = 'A') AS skipped,
           CASE WHEN run_id % 9 = 0 THEN 'disk full' END AS bailout_reason,
           CAST(0 AS BIGINT) AS parse_warning_count,
           -- each point has a subtest of one passing point, which the point must agree with
           count(*) FILTER (l_returnflag = 'R') AS protocol_failures
    FROM r GROUP BY run_id
    """,
)
def stream_tap_close(spark, sf_dir):
    rows = fixtures.numbered_items(spark, sf_dir)
    flag, rn = F.col("l_returnflag"), F.col("rn")
    count = F.count("*").over(fixtures.W.partitionBy("l_orderkey"))
    rows = rows.withColumn("n", count)
    point = F.concat(
        F.when(flag == "R", "not ok ").otherwise("ok "), rn, F.lit(" - part "), F.col("l_partkey"),
        F.when(flag == "A", " # SKIP").otherwise(""),
    )
    mine = F.array(
        F.concat(F.lit("# Subtest: part "), F.col("l_partkey")), F.lit("    ok 1"), F.lit("    1..1"), point
    )
    last = F.when(rn == F.col("n"), F.array(F.concat(F.lit("1.."), F.col("n"))))
    bail = F.when((rn == F.col("n")) & (F.col("l_orderkey") % 9 == 0), F.array(F.lit("Bail out! disk full")))
    none = F.array().cast("array<string>")
    lines = rows.select(
        F.col("l_orderkey").cast("bigint").alias("run_id"), rn.alias("at"),
        F.posexplode(F.concat(mine, F.coalesce(last, none), F.coalesce(bail, none))).alias("pos", "line"),
    )
    number = (4 * (F.col("at") - 1) + F.col("pos") + 1).cast("int")
    lines = lines.select(
        "run_id", number.alias("line_no"), "line",
        (F.timestamp_seconds(1_700_000_000 + F.col("run_id") % 60 + number)).alias("event_ts"),
    )
    with st.rocksdb_state(spark):
        return _run(close.stream_tap_close(_in_parts(spark, lines)), spark).filter("run_id >= 0")


@query(
    "stream_document_close",
    f"""
    SELECT l_orderkey AS run_id, {NO_PLAN}, {ZEROES}, count(*) AS total,
           count(*) FILTER (l_returnflag = 'N') AS passed,
           count(*) FILTER (l_returnflag = 'R') AS failed,
           count(*) FILTER (l_returnflag = 'A') AS skipped, CAST(0 AS BIGINT) AS todo
    FROM lineitem GROUP BY l_orderkey
    """,
)
def stream_document_close(spark, sf_dir):
    lines = stored_lines(fixtures.document_chunks(spark, sf_dir)).select(
        F.col("run_id").cast("bigint").alias("run_id"), "line_no", "line",
        F.timestamp_seconds(1_700_000_000 + F.col("run_id") % 60 + F.col("line_no")).alias("event_ts"),
    )
    with st.rocksdb_state(spark):
        return _run(close.stream_json_close(_in_parts(spark, lines)), spark).filter("run_id >= 0")


@query(
    "stream_crowded_dedup",
    """
    WITH f AS (
      SELECT l_suppkey % 2 AS run_id, 'order ' || (l_orderkey % 6000) AS label, l_orderkey * 8 + l_linenumber AS line_no
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    k AS (SELECT *, min(line_no) OVER (PARTITION BY run_id, label) AS first_no FROM f),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY first_no) AS key_rank FROM k)
    SELECT run_id, line_no, label FROM r WHERE line_no = first_no OR key_rank > 4096
    """,
)
def stream_crowded_dedup(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    label = F.concat(F.lit("order "), F.col("l_orderkey") % 6000)
    none = F.lit(None).cast("string")
    rows = materialize(
        items.select(
            (F.col("l_suppkey") % 2).cast("bigint").alias("run_id"), F.timestamp_seconds(1_700_000_000 + number).alias("event_ts"),
            number.alias("line_no"), F.lit(0).alias("item_no"), F.lit("TAP").alias("source"), label.alias("label"),
            none.alias("suite"), none.alias("test_file"), label.alias("reason"),
        ).distinct()
    )
    path = _scratch(spark, "failures")
    top = rows.agg(F.max("line_no")).first()[0] or 0
    for k in range(PARTS):
        part = F.floor(F.col("line_no") * PARTS / (top + 1)) == k
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with st.rocksdb_state(spark):
        out = _run(close.stream_policy(stream, delay="1 hour"), spark)
    return out.select("run_id", "line_no", "label")


@query(
    "stream_dedup",
    """
    SELECT DISTINCT user_id AS run_id, 'user ' || user_id AS label FROM events WHERE event_type = 'error'
    """,
)
def stream_dedup(spark, sf_dir):
    rows = st.stream_failures(_event_lines(spark, sf_dir))
    same = F.concat(F.lit("user "), F.col("run_id"))
    rows = rows.withColumn("label", same).withColumn("reason", same)
    return _run(st.stream_dedup(rows, "10000 days"), spark).select("run_id", "label")


@query(
    "stream_cap",
    """
    SELECT run_id, line_no, label FROM (
      SELECT user_id AS run_id, CAST(rn AS INTEGER) AS line_no, 'event ' || event_id AS label,
             row_number() OVER (PARTITION BY user_id ORDER BY rn) AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
      WHERE event_type = 'error')
    WHERE k <= 5
    """,
)
def stream_cap(spark, sf_dir):
    word = F.when(F.col("event_type") == "error", "not ok").otherwise("ok")
    lines = fixtures.numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        F.col("rn").cast("int").alias("line_no"),
        F.concat_ws("", word, F.lit(" event "), "event_id").alias("line"),
        F.col("ts").cast("timestamp").alias("event_ts"),
    )
    path = _scratch(spark, "lines")
    lines.write.parquet(path)
    stream = st.stream_lines(spark, path)
    with st.rocksdb_state(spark):
        return _run(st.stream_cap(stream, 5, delay="10000 days"), spark).select("run_id", "line_no", "label")


@query(
    "stream_alerts",
    """
    SELECT user_id AS run_id, 'go failure' AS title,
           'Runner: go' || chr(10) || 'Suite: pkg/' || (user_id % 7) || chr(10) || 'Test: T' || event_id
           || chr(10) || 'Reason: '
           || CASE WHEN event_id % 2 = 0 THEN 'boom ' || event_id ELSE 'T' || event_id END AS body
    FROM events WHERE event_type = 'error'
    """,
)
def stream_alerts(spark, sf_dir):
    out, ledger = _scratch(spark, "alerts"), _scratch(spark, "ledger")
    schema = "message_id STRING, run_id BIGINT, kind STRING, title STRING, body STRING"
    # the same input twice, the second time without a checkpoint, as after a loss of it
    for _ in range(2):
        job = (
            st.alert_sink(
                st.stream_failures(_event_lines(spark, sf_dir)),
                lambda rows, batch_id: rows.select([c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(out),
                _scratch(spark, "state"),
                ledger,
            )
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
    return spark.read.schema(schema).parquet(out).select("run_id", "title", "body")
