"""Queries over JSON logs, Bun output and JUnit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from testlog.operators import bun, jsonlog, junit
from testlog.operators.durable import materialize
from testlog.operators.lines import stored_lines
from testlog.plans import fixtures
from testlog.plans.catalog import query
from testlog.plans.tap_queries import NUMBERED

NO_PLAN = "CAST(NULL AS BIGINT) AS planned, CAST(NULL AS VARCHAR) AS bailout_reason"
ZEROES = "CAST(0 AS BIGINT) AS parse_warning_count, CAST(0 AS BIGINT) AS protocol_failures"


@query(
    "go_run_state",
    f"""
    SELECT user_id AS run_id, {NO_PLAN}, {ZEROES},
           count(*) FILTER (event_type IN ('click', 'error', 'signup')) AS total,
           count(*) FILTER (event_type = 'click') AS passed,
           count(*) FILTER (event_type = 'error') AS failed,
           count(*) FILTER (event_type = 'signup') AS skipped, CAST(0 AS BIGINT) AS todo
    FROM events GROUP BY user_id
    """,
)
def go_run_state(spark, sf_dir):
    return jsonlog.json_run_state(materialize(fixtures.go_lines(spark, sf_dir)))


@query(
    "go_events",
    """
    SELECT user_id AS run_id, 'T' || event_id AS label, 'pkg/' || (user_id % 7) AS suite,
           CASE event_type WHEN 'click' THEN 'passed' WHEN 'error' THEN 'failed'
                WHEN 'signup' THEN 'skipped' END AS outcome,
           CASE WHEN event_id % 2 = 0 THEN 'boom ' || event_id ELSE 'T' || event_id END AS reason
    FROM events
    """,
)
def go_events(spark, sf_dir):
    values = jsonlog.parse_lines(materialize(fixtures.go_lines(spark, sf_dir)))
    return jsonlog.go_events(values).select("run_id", "label", "suite", "outcome", "reason")


@query(
    "nextest_run_state",
    f"""
    SELECT user_id AS run_id, {NO_PLAN}, {ZEROES},
           count(*) FILTER (event_type <> 'purchase') AS total,
           count(*) FILTER (event_type = 'click') AS passed,
           count(*) FILTER (event_type = 'error') AS failed,
           count(*) FILTER (event_type = 'signup') AS skipped,
           count(*) FILTER (event_type = 'view') AS todo
    FROM events GROUP BY user_id
    """,
)
def nextest_run_state(spark, sf_dir):
    return jsonlog.json_run_state(materialize(fixtures.nextest_lines(spark, sf_dir)))


@query(
    "nextest_failures",
    """
    WITH named AS (
      SELECT *, CASE WHEN event_id % 3 <> 0 THEN 'n' ELSE 't' END || event_id AS label FROM events)
    SELECT user_id AS run_id, 'nextest' AS source, label,
           CASE WHEN event_id % 5 = 0 THEN 'bin' || user_id ELSE 'crate' END AS suite,
           CASE WHEN event_id % 7 = 0 THEN '/bin/x' END AS test_file,
           CASE WHEN event_id % 6 = 0 THEN 'msg ' || event_id
                WHEN event_id % 4 = 1 THEN 'nested ' || event_id ELSE label END AS reason
    FROM named WHERE event_type = 'error'
    """,
)
def nextest_failures(spark, sf_dir):
    rows = jsonlog.json_failures(materialize(fixtures.nextest_lines(spark, sf_dir)))
    return rows.select("run_id", "source", "label", "suite", "test_file", "reason")


@query(
    "nextest_events",
    """
    SELECT user_id AS run_id,
           CASE WHEN event_id % 3 <> 0 THEN 'n' ELSE 't' END || event_id AS label,
           CASE event_type WHEN 'click' THEN 'passed' WHEN 'error' THEN 'failed'
                WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'todo' END AS outcome
    FROM events
    """,
)
def nextest_events(spark, sf_dir):
    values = jsonlog.parse_lines(materialize(fixtures.nextest_lines(spark, sf_dir)))
    return jsonlog.nextest_events(values).select("run_id", "label", "outcome")


@query(
    "json_noise_and_documents",
    """
    WITH c AS (
      SELECT user_id AS run_id, count(*) AS n,
             count(*) FILTER (event_type = 'click') AS p,
             count(*) FILTER (event_type = 'error') AS f,
             count(*) FILTER (event_type = 'signup') AS s
      FROM events GROUP BY user_id),
    d AS (
      SELECT *, CASE WHEN p + f + s = 0 THEN 2 WHEN run_id % 3 = 0 THEN 1 ELSE 0 END AS doc FROM c)
    SELECT run_id, CAST(NULL AS BIGINT) AS planned, CAST(NULL AS VARCHAR) AS bailout_reason,
           CAST(p + f + s + CASE doc WHEN 2 THEN 9 WHEN 1 THEN 5 ELSE 0 END AS BIGINT) AS total,
           CAST(p + CASE doc WHEN 2 THEN 8 WHEN 1 THEN 3 ELSE 0 END AS BIGINT) AS passed,
           CAST(f + CASE doc WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS failed,
           CAST(s + CASE doc WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS skipped,
           CAST(CASE doc WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS todo,
           CAST(CASE WHEN n >= 10 THEN 1 ELSE 0 END AS BIGINT) AS parse_warning_count,
           CAST(0 AS BIGINT) AS protocol_failures
    FROM d
    """,
)
def json_noise_and_documents(spark, sf_dir):
    return jsonlog.json_run_state(stored_lines(fixtures.noisy_go_chunks(spark, sf_dir)))


@query(
    "json_values",
    """
    SELECT user_id AS run_id,
           count(*) + 1 + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS json_values
    FROM events GROUP BY user_id
    UNION ALL SELECT -1 - l_orderkey, 1 FROM lineitem GROUP BY l_orderkey
    """,
)
def json_values(spark, sf_dir):
    logs = stored_lines(fixtures.noisy_go_chunks(spark, sf_dir))
    docs = stored_lines(fixtures.document_chunks(spark, sf_dir)).withColumn("run_id", -1 - F.col("run_id"))
    values = jsonlog.json_values(materialize(logs.unionByName(docs)))
    return values.groupBy("run_id").agg(F.count("line_no").alias("json_values"))


@query(
    "summary_document_state",
    f"""
    SELECT l_orderkey AS run_id, {NO_PLAN}, {ZEROES}, count(*) AS total,
           count(*) FILTER (l_returnflag = 'N') AS passed,
           count(*) FILTER (l_returnflag = 'R') AS failed,
           count(*) FILTER (l_returnflag = 'A') AS skipped, CAST(0 AS BIGINT) AS todo
    FROM lineitem GROUP BY l_orderkey
    """,
)
def summary_document_state(spark, sf_dir):
    return jsonlog.json_run_state(stored_lines(fixtures.document_chunks(spark, sf_dir)))


@query(
    "summary_documents",
    """
    SELECT l_orderkey AS run_id, CASE WHEN l_orderkey % 2 = 0 THEN 'jest' ELSE 'vitest' END AS source,
           count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS passed,
           count(*) FILTER (l_returnflag = 'R') AS failed,
           count(*) FILTER (l_returnflag = 'A') AS skipped
    FROM lineitem GROUP BY l_orderkey
    """,
)
def summary_documents(spark, sf_dir):
    lines = stored_lines(fixtures.document_chunks(spark, sf_dir))
    docs = jsonlog.summary_docs(jsonlog.json_values(lines))
    return docs.select("run_id", "source", "total", "passed", "failed", "skipped")


@query(
    "document_failures",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, CAST(rn - 1 AS INTEGER) AS item_no,
           CASE WHEN l_orderkey % 2 = 0 THEN 'jest' ELSE 'vitest' END AS source,
           CASE WHEN l_linenumber % 2 = 1 THEN 'part ' || l_partkey ELSE 'suite ' || rn END AS label,
           'suite ' || rn AS suite, 'suite ' || rn AS test_file,
           CASE WHEN l_linenumber % 2 = 1 THEN 'bad ' || l_partkey ELSE 'suite ' || rn END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY listed_rn) AS listed_no
          FROM (SELECT *, rn AS listed_rn FROM items
                WHERE l_returnflag = 'R'))
    """,
)
def document_failures(spark, sf_dir):
    lines = stored_lines(fixtures.document_chunks(spark, sf_dir))
    rows = jsonlog.json_failures(lines)
    # passed entries list no assertions, so their numbers are restored from the suite name
    number = F.regexp_extract("suite", r"([0-9]+)", 1).cast("int") - 1
    return rows.select(
        "run_id", number.alias("item_no"), "source", "label", "suite", "test_file", "reason"
    )


@query(
    "json_huge_document",
    f"""
    SELECT l_orderkey % {fixtures.HUGE_RUNS} AS run_id, {NO_PLAN}, {ZEROES}, count(*) AS total,
           count(*) FILTER (l_returnflag = 'N') AS passed,
           count(*) FILTER (l_returnflag = 'R') AS failed,
           count(*) FILTER (l_returnflag = 'A') AS skipped, CAST(0 AS BIGINT) AS todo
    FROM lineitem GROUP BY l_orderkey % {fixtures.HUGE_RUNS}
    """,
)
def json_huge_document(spark, sf_dir):
    return jsonlog.json_run_state(stored_lines(fixtures.huge_document_chunks(spark, sf_dir)))


@query(
    "huge_document_failures",
    f"""
    SELECT l_orderkey % {fixtures.HUGE_RUNS} AS run_id, 'vitest' AS source,
           CASE WHEN l_linenumber % 2 = 1 THEN 'part ' || l_partkey ELSE 'order ' || l_orderkey END AS label,
           'order ' || l_orderkey AS suite, 'bad ' || l_partkey AS reason
    FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def huge_document_failures(spark, sf_dir):
    rows = jsonlog.json_failures(stored_lines(fixtures.huge_document_chunks(spark, sf_dir)))
    return rows.select("run_id", "source", "label", "suite", "reason")


@query(
    "bun_run_state",
    f"""
    WITH c AS (
      SELECT l_orderkey AS run_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS p,
             count(*) FILTER (l_returnflag = 'R') AS f, count(*) FILTER (l_returnflag = 'A') AS s,
             CASE WHEN l_orderkey % 3 = 0 THEN 'dots' WHEN l_orderkey % 5 = 0 THEN 'section'
                  ELSE 'inline' END AS style
      FROM lineitem GROUP BY l_orderkey)
    SELECT run_id, {NO_PLAN}, {ZEROES}, CAST(0 AS BIGINT) AS todo, f AS failed,
           CASE WHEN style <> 'section' OR run_id % 2 = 0 THEN p ELSE 0 END AS passed,
           CASE WHEN style = 'section' THEN 0 ELSE s END AS skipped,
           CASE WHEN style = 'section' THEN f + CASE WHEN run_id % 2 = 0 THEN p ELSE 0 END
                ELSE n END AS total
    FROM c
    """,
)
def bun_run_state(spark, sf_dir):
    return bun.bun_run_state(stored_lines(fixtures.bun_chunks(spark, sf_dir)))


@query(
    "bun_failures",
    """
    SELECT l_orderkey AS run_id, 'bun' AS source, 'part ' || l_partkey AS label
    FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 <> 0
    """,
)
def bun_failures(spark, sf_dir):
    events = bun.bun_events(stored_lines(fixtures.bun_chunks(spark, sf_dir)))
    return bun.bun_failures(events).select("run_id", "source", "label")


@query(
    "bun_section_lines",
    """
    SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'R') AS in_section
    FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 5 = 0 GROUP BY l_orderkey
    """,
)
def bun_section_lines(spark, sf_dir):
    rows = bun.bun_sections(stored_lines(fixtures.bun_chunks(spark, sf_dir)))
    return (
        rows.groupBy("run_id")
        .agg(
            F.count_if(F.col("in_section")).alias("in_section"),
            F.bool_or("title").alias("has_section"),
        )
        .filter("has_section")
        .drop("has_section")
    )


@query(
    "junit_report_state",
    f"""
    WITH c AS (
      SELECT l_orderkey AS run_id, l_orderkey % 17 = 0 AS cut, count(*) AS n,
             count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'R') AS f,
             count(*) FILTER (l_returnflag = 'A') AS s
      FROM lineitem GROUP BY l_orderkey)
    SELECT run_id, {NO_PLAN}, CAST(0 AS BIGINT) AS todo, CAST(0 AS BIGINT) AS protocol_failures,
           CAST(CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS parse_warning_count,
           CASE WHEN cut THEN 0 ELSE n END AS total, CASE WHEN cut THEN 0 ELSE p END AS passed,
           CASE WHEN cut THEN 0 ELSE f END AS failed, CASE WHEN cut THEN 0 ELSE s END AS skipped
    FROM c
    """,
)
def junit_report_state(spark, sf_dir):
    return junit.junit_run_state(fixtures.junit_reports(spark, sf_dir))


@query(
    "junit_failures",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, CAST(rn - 1 AS INTEGER) AS case_no, 'junit' AS source,
           'c' || (rn % 3) || '::part ' || l_partkey AS label, 'order ' || l_orderkey AS suite,
           CASE WHEN rn % 2 = 0 THEN 'f' || rn || '.py' WHEN l_orderkey % 4 = 0 THEN 'inner.py' END
             AS test_file,
           CASE WHEN l_linestatus = 'F' THEN 'bad <' || l_partkey || '>'
                ELSE 'trace ' || l_partkey END AS reason
    FROM items WHERE l_returnflag = 'R' AND l_orderkey % 17 <> 0
    """,
)
def junit_failures(spark, sf_dir):
    cases = junit.junit_cases(fixtures.junit_reports(spark, sf_dir))
    return junit.junit_failures(cases).drop("path")


@query(
    "junit_cases",
    """
    SELECT l_orderkey AS run_id, count(*) AS cases,
           count(*) FILTER (l_returnflag = 'A') AS skipped
    FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey
    """,
)
def junit_cases(spark, sf_dir):
    cases = junit.junit_cases(fixtures.junit_reports(spark, sf_dir))
    return cases.groupBy("run_id").agg(
        F.count("case_no").alias("cases"), F.count_if(F.col("status") == "skipped").alias("skipped")
    )


@query(
    "junit_malformed_reports",
    """
    SELECT l_orderkey AS run_id, l_orderkey % 17 = 0 AS malformed,
           CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE count(*) END AS total
    FROM lineitem GROUP BY l_orderkey
    """,
)
def junit_malformed_reports(spark, sf_dir):
    return junit.parse_junit(fixtures.junit_reports(spark, sf_dir)).drop("path")


@query(
    "junit_deep_cases",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, CAST(rn - 1 AS INTEGER) AS case_no,
           CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS status,
           'part ' || l_partkey AS label, 'suite ' || (l_partkey % 9) AS suite,
           CASE WHEN l_returnflag = 'R' THEN '<error code=' || l_partkey || '> raised' END AS reason
    FROM items
    """,
)
def junit_deep_cases(spark, sf_dir):
    """Cases one to nine suites deep, below foreign elements, in document order."""
    cases = junit.junit_cases(fixtures.deep_reports(spark, sf_dir))
    return cases.select("run_id", "case_no", "status", "label", "suite", "reason")


@query(
    "pages_as_reports",
    f"""
    SELECT page_id AS run_id, url AS path, {NO_PLAN}, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS passed,
           CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS todo, CAST(0 AS BIGINT) AS skipped,
           CAST(1 AS BIGINT) AS parse_warning_count, CAST(0 AS BIGINT) AS protocol_failures
    FROM pages
    """,
)
def pages_as_reports(spark, sf_dir):
    pages = fixtures.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("run_id"),
        F.col("url").alias("path"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.col("html").alias("content"),
    )
    return junit.junit_report_state(pages)
