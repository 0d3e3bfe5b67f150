"""Queries over TAP output and its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from testlog.operators import tap
from testlog.operators.durable import materialize
from testlog.operators.lines import stored_lines
from testlog.operators.runs import run_verdict
from testlog.plans import fixtures
from testlog.plans.catalog import query

ITEM_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
NUMBERED = f"""
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem)
"""


@query(
    "tap_flat_state",
    """
    WITH runs AS (
      SELECT l_orderkey AS run_id,
             count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS planned,
             count(*) AS total,
             count(*) FILTER (l_returnflag = 'N') AS passed,
             count(*) FILTER (l_returnflag = 'R') AS failed,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS todo,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS skipped
      FROM lineitem GROUP BY l_orderkey)
    SELECT *, CAST(NULL AS VARCHAR) AS bailout_reason,
           CAST(0 AS BIGINT) AS parse_warning_count, CAST(0 AS BIGINT) AS protocol_failures,
           failed = 0 AND planned = total AS success, planned <> total AS plan_mismatch,
           CAST(CASE WHEN failed = 0 AND planned = total THEN 0 ELSE 1 END AS INTEGER) AS exit_status
    FROM runs
    """,
)
def tap_flat_state(spark, sf_dir):
    lines = stored_lines(fixtures.as_chunks(fixtures.flat_tap(spark, sf_dir)))
    return run_verdict(tap.tap_run_state(lines))


@query(
    "tap_ids_and_plans",
    f"""
    WITH {NUMBERED},
    raw AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS raw_id FROM items),
    seg AS (SELECT *, count(raw_id) OVER (PARTITION BY l_orderkey ORDER BY rn) AS s FROM raw),
    ids AS (
      SELECT *, CASE WHEN s = 0 THEN rn
                ELSE max(raw_id) OVER (PARTITION BY l_orderkey, s)
                     + row_number() OVER (PARTITION BY l_orderkey, s ORDER BY rn) - 1 END AS id
      FROM seg),
    runs AS (
      SELECT l_orderkey AS run_id, count(*) AS total, l_orderkey % 11 = 0 AS absent,
             count(*) FILTER (l_returnflag = 'N') AS passed,
             count(*) FILTER (l_returnflag = 'R') AS failed,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS todo,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS skipped,
             count(*) - count(DISTINCT id) AS repeats, min(id) AS low, max(id) AS high
      FROM ids GROUP BY l_orderkey)
    SELECT run_id, CASE WHEN NOT absent THEN total END AS planned, total, passed, failed, todo,
           skipped, CAST(NULL AS VARCHAR) AS bailout_reason,
           CAST(0 AS BIGINT) AS parse_warning_count,
           CAST(repeats + CASE WHEN absent THEN 1 ELSE 0 END
             + CASE WHEN NOT absent AND (low < 1 OR high > total) THEN 1 ELSE 0 END AS BIGINT)
             AS protocol_failures
    FROM runs
    """,
)
def tap_ids_and_plans(spark, sf_dir):
    chunks = fixtures.as_chunks(fixtures.odd_ids_tap(spark, sf_dir), straddle=True)
    return tap.tap_run_state(stored_lines(chunks))


NO_TEXT = "CAST(NULL AS VARCHAR) AS bailout_reason"


@query(
    "tap_subtest_state",
    f"""
    WITH counted AS (
      SELECT o_custkey, o_orderkey, o_orderstatus, count(l_orderkey) AS items,
             count(*) FILTER (l_returnflag = 'R') AS bad
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    kids AS (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS from_end
      FROM counted),
    faults AS (
      SELECT *, CASE
          WHEN items = 0 THEN CASE WHEN o_orderstatus = 'P' AND from_end = 1 THEN 2 ELSE 0 END
          WHEN o_orderstatus = 'P' THEN 1
          WHEN (o_orderstatus = 'O') <> (bad = 0) THEN 1 ELSE 0 END AS fault
      FROM kids)
    SELECT o_custkey AS run_id, count(*) FILTER (o_orderstatus <> 'P') AS planned,
           count(*) FILTER (o_orderstatus <> 'P') AS total,
           count(*) FILTER (o_orderstatus = 'O') AS passed,
           count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(0 AS BIGINT) AS todo,
           CAST(0 AS BIGINT) AS skipped, {NO_TEXT}, CAST(0 AS BIGINT) AS parse_warning_count,
           CAST(sum(fault) AS BIGINT) AS protocol_failures
    FROM faults GROUP BY o_custkey
    """,
)
def tap_subtest_state(spark, sf_dir):
    return tap.tap_run_state(stored_lines(fixtures.nested_tap(spark, sf_dir)))


@query(
    "tap_subtest_agreement",
    """
    SELECT o_custkey AS run_id, count(*) AS subtests, count(*) FILTER (bad = 0) AS succeeded,
           count(*) FILTER (o_orderstatus <> 'P' AND (o_orderstatus = 'O') = (bad = 0)) AS agreeing
    FROM (SELECT o_custkey, o_orderkey, o_orderstatus,
                 count(*) FILTER (l_returnflag = 'R') AS bad
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    GROUP BY o_custkey
    """,
)
def tap_subtest_agreement(spark, sf_dir):
    states = tap.tap_states(stored_lines(fixtures.nested_tap(spark, sf_dir)))
    subtests = tap.correlate_subtests(states)
    return subtests.groupBy("run_id").agg(
        F.count("success").alias("subtests"),
        F.count_if("success").alias("succeeded"),
        F.count_if("agrees").alias("agreeing"),
    )


@query(
    "tap_levels",
    """
    SELECT o_custkey AS run_id, CAST(1 AS INTEGER) AS depth, count(*) + count(DISTINCT o_orderkey) AS n
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey
    UNION ALL
    SELECT o_custkey, 0, 2 + count(*) + count(*) FILTER (o_orderstatus <> 'P')
    FROM orders GROUP BY o_custkey
    """,
)
def tap_levels(spark, sf_dir):
    levels = tap.tap_levels(stored_lines(fixtures.nested_tap(spark, sf_dir)))
    return levels.groupBy("run_id", F.size("path").alias("depth")).agg(F.count("line_no").alias("n"))


BUSY = f"""
WITH {NUMBERED},
busy AS (
  SELECT l_orderkey AS run_id, count(*) AS n,
         count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'R') AS f,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS t,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS s,
         CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS odd,
         CASE WHEN l_orderkey % 4 = 0 THEN count(*) FILTER (rn % 5 = 4) ELSE 0 END AS stray,
         l_orderkey % 6 = 0 AS strict, l_orderkey % 13 = 0 AS bail
  FROM items GROUP BY l_orderkey)
"""


@query(
    "tap_busy_state",
    BUSY
    + """
    SELECT run_id, n AS planned, n AS total, p AS passed, f AS failed, t AS todo, s AS skipped,
           CASE WHEN bail THEN 'order ' || run_id END AS bailout_reason,
           CAST(odd + stray AS BIGINT) AS parse_warning_count,
           CAST(CASE WHEN strict THEN odd + stray ELSE 0 END AS BIGINT) AS protocol_failures
    FROM busy
    """,
)
def tap_busy_state(spark, sf_dir):
    return tap.tap_run_state(stored_lines(fixtures.busy_tap(spark, sf_dir)))


@query(
    "tap_line_kinds",
    BUSY
    + """
    SELECT run_id, kind, n FROM (
      SELECT run_id, 'version' AS kind, 1 AS n FROM busy
      UNION ALL SELECT run_id, 'plan', 1 FROM busy
      UNION ALL SELECT run_id, 'point', n FROM busy
      UNION ALL SELECT run_id, 'yaml', 4 * f FROM busy
      UNION ALL SELECT run_id, 'indented', odd FROM busy
      UNION ALL SELECT run_id, 'unsupported', stray FROM busy
      UNION ALL SELECT run_id, 'pragma', CASE WHEN strict THEN 1 ELSE 0 END FROM busy
      UNION ALL SELECT run_id, 'bailout', CASE WHEN bail THEN 1 ELSE 0 END FROM busy)
    WHERE n > 0
    """,
)
def tap_line_kinds(spark, sf_dir):
    kinds = tap.tap_classify(stored_lines(fixtures.busy_tap(spark, sf_dir)))
    return kinds.groupBy("run_id", "kind").agg(F.count("line_no").alias("n"))


@query(
    "tap_points",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, CAST(rn AS VARCHAR) AS id, l_returnflag <> 'R' AS ok,
           'part # ' || l_partkey AS description,
           CASE WHEN l_returnflag = 'A' THEN CASE l_linestatus WHEN 'F' THEN 'TODO' ELSE 'SKIP' END END
             AS directive
    FROM items
    """,
)
def tap_points(spark, sf_dir):
    events = tap.tap_events(stored_lines(fixtures.busy_tap(spark, sf_dir)))
    return tap.tap_points(events).select(
        "run_id", F.col("id").cast("string").alias("id"), "ok", "description", "directive"
    )


@query(
    "tap_filled_ids",
    f"""
    WITH {NUMBERED},
    raw AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS raw_id FROM items),
    seg AS (SELECT *, count(raw_id) OVER (PARTITION BY l_orderkey ORDER BY rn) AS s FROM raw)
    SELECT l_orderkey AS run_id, rn AS place,
           CAST(CASE WHEN s = 0 THEN rn
                ELSE max(raw_id) OVER (PARTITION BY l_orderkey, s)
                     + row_number() OVER (PARTITION BY l_orderkey, s ORDER BY rn) - 1 END AS VARCHAR) AS id
    FROM seg
    """,
)
def tap_filled_ids(spark, sf_dir):
    lines = stored_lines(fixtures.as_chunks(fixtures.odd_ids_tap(spark, sf_dir)))
    points = tap.tap_points(tap.tap_events(lines))
    lead = (F.col("run_id") % 2 != 0) & (F.col("run_id") % 11 != 0)
    place = F.col("line_no").cast("bigint") - F.when(lead, 1).otherwise(0)
    return points.select("run_id", place.alias("place"), F.col("id").cast("string").alias("id"))


@query(
    "tap_failures",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, CAST(rn + 2 AS INTEGER) AS line_no, 'TAP' AS source,
           'part ' || l_partkey AS label, 'part ' || l_partkey AS reason
    FROM items WHERE l_returnflag = 'R'
    """,
)
def tap_failures(spark, sf_dir):
    events = tap.tap_events(materialize(fixtures.flat_tap(spark, sf_dir)))
    return tap.tap_failures(events).select("run_id", "line_no", "source", "label", "reason")


@query(
    "tap_deep_subtests",
    f"""
    WITH c AS (
      SELECT c_custkey AS run_id, c_custkey % 8 AS depth, c_acctbal < 0 AS bad,
             c_acctbal < 0 AND (c_custkey % 3 <> 0 OR c_custkey % 8 = 0) AS shown_bad
      FROM customer)
    SELECT run_id, CAST(1 AS BIGINT) AS planned, CAST(1 AS BIGINT) AS total,
           CAST(NOT shown_bad AS BIGINT) AS passed, CAST(shown_bad AS BIGINT) AS failed, CAST(0 AS BIGINT) AS todo,
           CAST(0 AS BIGINT) AS skipped, {NO_TEXT}, CAST(0 AS BIGINT) AS parse_warning_count,
           CAST(CASE WHEN bad AND NOT shown_bad THEN depth ELSE 0 END AS BIGINT) AS protocol_failures
    FROM c
    """,
)
def tap_deep_subtests(spark, sf_dir):
    """Every level whose point contradicts its subtest adds one violation to those below."""
    return tap.tap_run_state(materialize(fixtures.deep_tap(spark, sf_dir)))
