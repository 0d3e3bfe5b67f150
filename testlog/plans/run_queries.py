"""Queries over failures, settings, merged states and whole fleets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from testlog.operators import failures as fl
from testlog.operators import jsonlog, junit, runs, tap
from testlog.operators.durable import materialize, session_folder
from testlog.operators.lines import stored_lines
from testlog.plans import fixtures
from testlog.plans.catalog import query
from testlog.plans.fleet import analyze_runs
from testlog.plans.tap_queries import ITEM_ORDER, NUMBERED
from testlog.sources import sinks

FLAT = """
flat AS (
  SELECT l_orderkey AS run_id, count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS planned,
         count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS passed,
         count(*) FILTER (l_returnflag = 'R') AS failed,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS todo,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS skipped
  FROM lineitem GROUP BY l_orderkey)
"""


ORDER_BLOCK = 1024


def _part_failures(spark, sf_dir, run, label):
    """Failing points of T1 regrouped, so that runs share and repeat labels."""
    items = fixtures.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    # a run's rows are numbered per block of order keys, and counts of earlier blocks are carried in
    items = items.withColumns({"run": run, "block": F.expr(f"l_orderkey div {ORDER_BLOCK}")})
    inside = fixtures.W.partitionBy("run", "block").orderBy("l_orderkey", *fixtures.LINE_ORDER)
    across = fixtures.W.partitionBy("run").orderBy("block").rowsBetween(fixtures.W.unboundedPreceding, -1)
    sizes = items.groupBy("run", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        F.col("run").alias("run_of"), F.col("block").alias("block_of"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before")
    )
    items = items.withColumn("at", F.row_number().over(inside)).join(
        before, F.col("run").eqNullSafe(F.col("run_of")) & F.col("block").eqNullSafe(F.col("block_of"))
    )
    place = (F.col("before") + F.col("at")).cast("int")
    none = F.lit(None).cast("string")
    return items.select(
        F.col("run").alias("run_id"),
        F.lit(0).alias("stage"),
        F.lit("").alias("path"),
        place.alias("line_no"),
        F.lit(0).alias("item_no"),
        F.lit("TAP").alias("source"),
        label.alias("label"),
        none.alias("suite"),
        none.alias("test_file"),
        label.alias("reason"),
    )


def _dedup_sql(run: str, label: str, tail: str) -> str:
    return f"""
    WITH f AS (
      SELECT {run} AS run_id, {label} AS label,
             row_number() OVER (PARTITION BY {run} ORDER BY l_orderkey, {ITEM_ORDER}) AS line_no
      FROM lineitem WHERE l_returnflag = 'R'),
    k AS (SELECT *, min(line_no) OVER (PARTITION BY run_id, label) AS first_no FROM f),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY first_no) AS key_rank FROM k),
    kept AS (SELECT run_id, CAST(line_no AS INTEGER) AS line_no, label FROM r
             WHERE line_no = first_no OR key_rank > 4096)
    {tail}
    """


@query(
    "dedup_failures",
    _dedup_sql("l_suppkey % 10", "'part ' || (l_partkey % 50)", "SELECT * FROM kept"),
)
def dedup_failures(spark, sf_dir):
    rows = _part_failures(
        spark, sf_dir, F.col("l_suppkey") % 10, F.concat(F.lit("part "), F.col("l_partkey") % 50)
    )
    return fl.dedup_failures(rows).select("run_id", "line_no", "label")


@query(
    "dedup_crowded_runs",
    _dedup_sql("l_suppkey % 2", "'order ' || l_orderkey", "SELECT * FROM kept"),
)
def dedup_crowded_runs(spark, sf_dir):
    rows = _part_failures(
        spark, sf_dir, F.col("l_suppkey") % 2, F.concat(F.lit("order "), F.col("l_orderkey"))
    )
    return fl.dedup_failures(rows).select("run_id", "line_no", "label")


@query(
    "cap_failures",
    _dedup_sql(
        "l_suppkey % 10",
        "'part ' || (l_partkey % 50)",
        "SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no) <= 7",
    ),
)
def cap_failures(spark, sf_dir):
    rows = _part_failures(
        spark, sf_dir, F.col("l_suppkey") % 10, F.concat(F.lit("part "), F.col("l_partkey") % 50)
    )
    return fl.cap_failures(fl.dedup_failures(rows), 7).select("run_id", "line_no", "label")


@query(
    "all_failures",
    f"""
    WITH {NUMBERED}
    SELECT l_orderkey AS run_id, 0 AS stage, 'TAP' AS source, 'part ' || l_partkey AS label
    FROM items WHERE l_returnflag = 'R'
    UNION ALL
    SELECT l_orderkey, 1, 'junit', 'c' || (rn % 3) || '::part ' || l_partkey
    FROM items WHERE l_returnflag = 'R' AND l_orderkey % 17 <> 0
    UNION ALL
    SELECT user_id, 0, 'go', 'T' || event_id FROM events WHERE event_type = 'error'
    """,
)
def all_failures(spark, sf_dir):
    points = tap.tap_failures(tap.tap_events(materialize(fixtures.flat_tap(spark, sf_dir))))
    go = jsonlog.json_failures(materialize(fixtures.go_lines(spark, sf_dir)))
    cases = junit.junit_failures(junit.junit_cases(fixtures.junit_reports(spark, sf_dir)))
    return fl.all_failures([points, go], cases).select("run_id", "stage", "source", "label")


@query(
    "failure_messages",
    """
    WITH f AS (
      SELECT user_id AS run_id, 'T' || event_id AS label, 'pkg/' || (user_id % 7) AS suite,
             CASE WHEN event_id % 2 = 0 THEN 'boom ' || event_id ELSE 'T' || event_id END AS reason
      FROM events WHERE event_type = 'error')
    SELECT run_id, 'failure' AS kind, 'go failure' AS title,
           'Runner: go' || chr(10) || 'Suite: ' || suite || chr(10) || 'Test: ' || label || chr(10)
           || 'Reason: ' || reason
           || CASE WHEN run_id % 2 = 0 THEN chr(10) || 'Project: team ' || (run_id % 3) ELSE '' END AS body
    FROM f
    """,
)
def failure_messages(spark, sf_dir):
    rows = jsonlog.json_failures(materialize(fixtures.go_lines(spark, sf_dir)))
    team = F.concat(F.lit("team "), F.col("run_id") % 3)
    return fl.render_failures(rows.withColumn("project", F.when(F.col("run_id") % 2 == 0, team)))


@query(
    "run_messages",
    """
    WITH c AS (
      SELECT l_orderkey AS run_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS p,
             count(*) FILTER (l_returnflag = 'R') AS f,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS t,
             count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS s,
             CASE WHEN l_orderkey % 6 = 0 AND (l_orderkey % 9 = 0
                    OR (l_orderkey % 4 = 0 AND count(*) >= 4)) THEN 1 ELSE 0 END AS v
      FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT *, CASE WHEN f = 0 AND v = 0 AND run_id % 13 <> 0 THEN 'success' ELSE 'failure' END AS st
          FROM c)
    SELECT run_id, 'summary_' || st AS kind, 'Run summary - fleet' AS title,
           'status: ' || st || '; total: ' || n || '; passed: ' || p || '; failed: ' || f
           || '; todo: ' || t || '; skipped: ' || s AS body
    FROM m
    UNION ALL
    SELECT run_id, 'bailout', 'TAP bailout', 'order ' || run_id || chr(10) || 'Project: fleet'
    FROM m WHERE run_id % 13 = 0
    """,
)
def run_messages(spark, sf_dir):
    states = tap.tap_run_state(stored_lines(fixtures.busy_tap(spark, sf_dir)))
    return fl.render_run_messages(materialize(states).withColumn("project", F.lit("fleet")))


@query(
    "text_summaries",
    f"""
    WITH {FLAT}
    SELECT run_id, 'status=' || CASE WHEN failed = 0 AND planned = total THEN 'success' ELSE 'failure' END
           || ' total=' || total || ' passed=' || passed || ' failed=' || failed || ' todo=' || todo
           || ' skipped=' || skipped || ' parse_warnings=0' AS summary
    FROM flat
    """,
)
def text_summaries(spark, sf_dir):
    return sinks.summaries(tap.tap_run_state(materialize(fixtures.flat_tap(spark, sf_dir))), "text")


@query(
    "json_summaries",
    f"""
    WITH {FLAT}
    SELECT run_id, '{{"planned":' || planned || ',"total":' || total || ',"passed":' || passed
           || ',"failed":' || failed || ',"todo":' || todo || ',"skipped":' || skipped
           || ',"bailout_reason":null,"parse_warning_count":0,"protocol_failures":0}}' AS summary
    FROM flat
    """,
)
def json_summaries(spark, sf_dir):
    return sinks.summaries(tap.tap_run_state(materialize(fixtures.flat_tap(spark, sf_dir))), "json")


MERGED = f"""
WITH {FLAT},
m AS (
  SELECT run_id % 7 AS project, run_id, 0 AS stage, planned, total, passed, failed, todo, skipped FROM flat
  UNION ALL
  SELECT run_id % 7, run_id, 1, NULL, CASE WHEN run_id % 17 = 0 THEN 0 ELSE total END,
         CASE WHEN run_id % 17 = 0 THEN 0 ELSE passed END, CASE WHEN run_id % 17 = 0 THEN 0 ELSE failed END,
         0, CASE WHEN run_id % 17 = 0 THEN 0 ELSE todo + skipped END FROM flat)
"""


@query(
    "merged_states_by_level",
    MERGED
    + """
    SELECT project, run_id,
           CAST(CASE WHEN run_id % 17 = 0 THEN max(planned) END AS BIGINT) AS planned,
           CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed,
           CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(todo) AS BIGINT) AS todo,
           CAST(sum(skipped) AS BIGINT) AS skipped, CAST(NULL AS VARCHAR) AS bailout_reason,
           CAST(count(*) FILTER (stage = 1 AND total = 0) AS BIGINT) AS parse_warning_count,
           CAST(0 AS BIGINT) AS protocol_failures
    FROM m GROUP BY ROLLUP (project, run_id)
    """,
)
def merged_states_by_level(spark, sf_dir):
    stream = tap.tap_run_state(materialize(fixtures.flat_tap(spark, sf_dir))).withColumn("stage", F.lit(0))
    reports = junit.junit_run_state(fixtures.junit_reports(spark, sf_dir)).withColumn("stage", F.lit(1))
    both = stream.unionByName(reports).withColumn("project", F.col("run_id") % 7)
    return runs.merge_levels(both, ["project", "run_id"], ["run_id", "stage"])


def order_runs(spark, sf_dir):
    """R1: one run per order; commands and exit codes by modulus."""
    orders = fixtures.table(spark, sf_dir, "orders")
    customer = fixtures.table(spark, sf_dir, "customer")
    nation = fixtures.table(spark, sf_dir, "nation")
    key = F.col("o_orderkey")
    word = F.lit
    command = (
        F.when(key % 8 == 0, F.array(word("/usr/bin/Gradle"), word("test")))
        .when(key % 8 == 1, F.array(word("./mvnw"), word("verify")))
        .when(key % 8 == 2, F.array(word("python3.12"), word("-m"), word("pytest"), word("-q")))
        .when(key % 8 == 3, F.array(word("uv"), word("run"), word("--"), word("pytest")))
        .when(key % 8 == 4, F.array(word("pytest"), word("--junitxml=r.xml")))
        .otherwise(F.array(word("make"), word("check")))
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("run_id"),
            F.col("n_name").alias("project"),
            command.alias("command"),
            F.col("o_orderdate").alias("started_at"),
            F.when(key % 19 == 0, F.lit(None)).when(key % 10 == 0, 3).otherwise(0).cast("int").alias("exit_code"),
        )
    )


def order_settings(spark, sf_dir):
    """R1: settings rows on several layers, chosen by modulus."""
    key = F.col("o_orderkey")
    entries = [
        (key % 2 == 0, "user", "strict", "true"),
        (key % 3 == 0, "local", "strict", "false"),
        (key % 5 == 0, "env", "strict", " YES "),
        (key % 7 == 0, "env", "strict", "maybe"),
        (key % 4 == 0, "local", "input_format", "tap"),
        (key % 6 == 0, "cli", "input_format", "auto"),
        (key % 9 == 0, "env", "desktop", "Force_Off"),
        (key % 10 == 0, "user", "enabled", "false"),
        (key % 15 == 0, "env", "no_notify", "off"),
        (key % 11 == 0, "env", "max_failure_notifications", "7"),
        (key % 22 == 0, "cli", "max_failure_notifications", "0"),
        (key % 12 == 0, "env", "junit_glob", "a/*.xml, ,b/*.xml"),
        (key % 24 == 0, "cli", "junit_glob", " , "),
        (key % 14 == 0, "user", "project_label", "Team"),
        (key % 28 == 0, "env", "project_label", "  "),
        (key % 16 == 0, "cli", "junit_only", "true"),
        (key % 64 == 0, "cli", "junit_file", "extra.xml"),
    ]
    items = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(F.lit(layer).alias("layer"), F.lit(k).alias("key"), F.lit(v).alias("value")),
                )
                for cond, layer, k, v in entries
            ]
        )
    )
    return (
        fixtures.table(spark, sf_dir, "orders")
        .select(key.alias("run_id"), F.explode_outer(items).alias("x"))
        .filter(F.col("x").isNotNull())
        .select("run_id", "x.*")
    )


@query(
    "effective_settings",
    """
    SELECT o_orderkey AS run_id,
           CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 3 = 0 THEN false
                ELSE o_orderkey % 2 = 0 END AS strict,
           CASE WHEN o_orderkey % 6 = 0 THEN 'auto' WHEN o_orderkey % 4 = 0 THEN 'tap' ELSE 'auto' END
             AS input_format,
           CASE WHEN o_orderkey % 9 = 0 THEN 'force-off' ELSE 'auto' END AS desktop,
           CASE WHEN o_orderkey % 9 = 0 THEN 'env' ELSE 'default' END AS desktop_layer,
           o_orderkey % 15 = 0 OR o_orderkey % 10 <> 0 AS enabled,
           CASE WHEN o_orderkey % 15 = 0 THEN 'env' WHEN o_orderkey % 10 = 0 THEN 'user' ELSE 'default' END
             AS enabled_layer,
           CAST(CASE WHEN o_orderkey % 22 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 7 END AS BIGINT)
             AS max_failure_notifications,
           CASE WHEN o_orderkey % 12 = 0 THEN 'a/*.xml,b/*.xml' ELSE '' END AS junit_globs,
           CASE WHEN o_orderkey % 28 = 0 THEN NULL WHEN o_orderkey % 14 = 0 THEN 'Team' END AS project_label,
           o_orderkey % 16 = 0 AS junit_only
    FROM orders
    """,
)
def effective_settings(spark, sf_dir):
    resolved = runs.resolve_settings(order_runs(spark, sf_dir), order_settings(spark, sf_dir))
    return resolved.select(
        "run_id", "strict", "input_format", "desktop", "desktop_layer", "enabled", "enabled_layer",
        "max_failure_notifications", F.array_join("junit_glob", ",").alias("junit_globs"),
        "project_label", "junit_only",
    )


@query(
    "winning_settings",
    """
    SELECT o_orderkey AS run_id, 'strict' AS key,
           CASE WHEN o_orderkey % 5 = 0 THEN 'true' WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END AS value,
           CASE WHEN o_orderkey % 5 = 0 THEN 'env' WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'user' END AS layer
    FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0
    """,
)
def winning_settings(spark, sf_dir):
    return runs.winning_settings(order_settings(spark, sf_dir)).filter("key = 'strict'")


@query(
    "inferred_report_globs",
    """
    SELECT o_orderkey AS run_id, 'gradle' AS tool, '**/build/test-results/**/*.xml' AS glob
    FROM orders WHERE o_orderkey % 8 = 0
    UNION ALL SELECT o_orderkey, 'maven', '**/target/surefire-reports/TEST-*.xml'
    FROM orders WHERE o_orderkey % 8 = 1
    UNION ALL SELECT o_orderkey, 'maven', '**/target/failsafe-reports/TEST-*.xml'
    FROM orders WHERE o_orderkey % 8 = 1
    """,
)
def inferred_report_globs(spark, sf_dir):
    return runs.infer_report_globs(order_runs(spark, sf_dir))


@query(
    "skipped_streams",
    """
    SELECT o_orderkey AS run_id FROM orders
    WHERE o_orderkey % 16 = 0
       OR (o_orderkey % 8 IN (0, 1, 2, 3) AND o_orderkey % 12 <> 0 AND o_orderkey % 64 <> 0
           AND (o_orderkey % 6 = 0 OR o_orderkey % 4 <> 0))
    """,
)
def skipped_streams(spark, sf_dir):
    all_runs = order_runs(spark, sf_dir)
    settings = materialize(runs.resolve_settings(all_runs, order_settings(spark, sf_dir)))
    return runs.skips_stream(runs.infer_tool(all_runs, settings), settings)


def _dated_runs(spark, sf_dir):
    all_runs = order_runs(spark, sf_dir)
    return all_runs.select("run_id", "started_at").join(runs.infer_tool(all_runs), "run_id")


FRESH = """
dated AS (
  SELECT l_orderkey AS run_id, min(l_shipdate) AS modified FROM lineitem GROUP BY l_orderkey),
judged AS (
  SELECT run_id, o_orderkey % 8 IN (0, 1) AS dated_tool,
         modified >= o_orderdate - INTERVAL 2 SECOND AS fresh
  FROM dated JOIN orders ON o_orderkey = run_id)
"""


@query("fresh_reports", f"WITH {FRESH} SELECT run_id FROM judged WHERE fresh OR NOT dated_tool")
def fresh_reports(spark, sf_dir):
    reports = fixtures.junit_reports(spark, sf_dir)
    return runs.fresh_reports(reports, _dated_runs(spark, sf_dir)).select("run_id")


@query("stale_runs", f"WITH {FRESH} SELECT run_id FROM judged WHERE dated_tool AND NOT fresh")
def stale_runs(spark, sf_dir):
    return runs.only_stale(fixtures.junit_reports(spark, sf_dir), _dated_runs(spark, sf_dir))


@query(
    "run_verdicts",
    f"""
    WITH {FLAT}
    SELECT run_id, failed = 0 AND planned = total AS success, planned <> total AS plan_mismatch,
           CAST(CASE WHEN run_id % 19 = 0 THEN 1 WHEN run_id % 10 = 0 THEN 3
                WHEN failed = 0 AND planned = total THEN 0 ELSE 1 END AS INTEGER) AS exit_status
    FROM flat
    """,
)
def run_verdicts(spark, sf_dir):
    states = tap.tap_run_state(materialize(fixtures.flat_tap(spark, sf_dir)))
    verdicts = runs.run_verdict(states, order_runs(spark, sf_dir))
    return verdicts.select("run_id", "success", "plan_mismatch", "exit_status")


@query(
    "preferred_reports",
    """
    SELECT l_orderkey AS run_id FROM lineitem
    WHERE NOT (l_orderkey % 8 IN (0, 1) AND l_orderkey % 3 = 0 AND l_orderkey % 17 <> 0)
    GROUP BY l_orderkey
    """,
)
def preferred_reports(spark, sf_dir):
    noise = F.col("run_id") % 3 == 0
    lines = materialize(fixtures.flat_tap(spark, sf_dir)).withColumn(
        "line", F.when(noise, F.concat(F.lit("noise "), "line")).otherwise(F.col("line"))
    )
    reports = junit.junit_run_state(fixtures.junit_reports(spark, sf_dir))
    kept = runs.prefer_reports(
        materialize(tap.tap_run_state(lines)), reports, runs.infer_tool(order_runs(spark, sf_dir))
    )
    return kept.select("run_id")


def _fleet(spark, sf_dir):
    all_runs = materialize(order_runs(spark, sf_dir))
    settings = materialize(runs.resolve_settings(all_runs, order_settings(spark, sf_dir)))
    chunks = fixtures.as_chunks(fixtures.flat_tap(spark, sf_dir))
    return analyze_runs(chunks, all_runs, fixtures.junit_reports(spark, sf_dir), settings)


FLEET = f"""
WITH {FRESH.strip()},
base AS (
  SELECT o_orderkey AS run_id, count(l_orderkey) AS n,
         count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'R') AS f,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS t,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS s
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
facts AS (
  SELECT b.*, coalesce(j.fresh, false) AS fresh, j.run_id IS NOT NULL AS has_report,
         b.run_id % 16 = 0 AS reports_only,
         b.run_id % 12 = 0 OR b.run_id % 64 = 0 AS explicit, b.run_id % 64 = 0 AS named,
         CASE WHEN b.run_id % 8 = 0 THEN 'gradle' WHEN b.run_id % 8 = 1 THEN 'maven'
              WHEN b.run_id % 8 IN (2, 3) THEN 'pytest' END AS program,
         CASE WHEN b.run_id % 6 = 0 THEN true ELSE b.run_id % 4 <> 0 END AS auto
  FROM base b LEFT JOIN judged j ON j.run_id = b.run_id),
plan AS (
  -- the configured globs match no report, so the usual places are looked at unless a file is named
  SELECT *, reports_only OR (NOT explicit AND program IS NOT NULL AND auto) AS skip,
         has_report AND NOT named AND (coalesce(program, '') = 'gradle' OR NOT explicit AND coalesce(program, '') = 'pytest')
           AS offered
  FROM facts),
used AS (
  SELECT *, offered AND (program = 'pytest' OR fresh) AS taken FROM plan),
merged AS (
  SELECT run_id, reports_only, offered, named, skip, taken, n,
         NOT skip AND n > 0 AS logged, NOT skip AND n = 0 AS silent,
         taken AND run_id % 17 <> 0 AS counted, p, f, t, s
  FROM used)
SELECT run_id,
       CAST(CASE WHEN logged AND NOT counted THEN n + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END END AS BIGINT)
         AS planned,
       CAST(CASE WHEN logged THEN n ELSE 0 END + CASE WHEN counted THEN n ELSE 0 END AS BIGINT) AS total,
       CAST(CASE WHEN logged THEN p ELSE 0 END + CASE WHEN counted THEN p ELSE 0 END AS BIGINT) AS passed,
       CAST(CASE WHEN logged THEN f ELSE 0 END + CASE WHEN counted THEN f ELSE 0 END AS BIGINT) AS failed,
       CAST(CASE WHEN logged THEN t ELSE 0 END AS BIGINT) AS todo,
       CAST(CASE WHEN logged THEN s ELSE 0 END + CASE WHEN counted THEN t + s ELSE 0 END AS BIGINT) AS skipped,
       CAST(CASE WHEN taken AND NOT counted THEN 1 ELSE 0 END AS BIGINT) AS parse_warning_count,
       CAST(CASE WHEN silent THEN 1 ELSE 0 END AS BIGINT) AS protocol_failures
FROM merged
WHERE NOT (reports_only AND NOT offered AND NOT named)
  AND NOT (skip AND (offered OR named) AND NOT taken)
"""


@query("fleet_states", FLEET)
def fleet_states(spark, sf_dir):
    result = _fleet(spark, sf_dir)
    return result.verdicts.select(
        "run_id", "planned", "total", "passed", "failed", "todo", "skipped",
        "parse_warning_count", "protocol_failures",
    )


@query(
    "fleet_errors",
    FLEET.split("SELECT run_id,\n       CAST(CASE WHEN logged")[0]
    + "SELECT run_id, 'no_reports: only reports are asked for and there is none' AS error "
    "FROM merged WHERE reports_only AND NOT offered AND NOT named",
)
def fleet_errors(spark, sf_dir):
    return _fleet(spark, sf_dir).errors


def _report_settings(spark, sf_dir):
    """R2: report inputs on several layers, chosen by modulus."""
    key = F.col("o_orderkey")
    entries = [
        (key % 3 == 0, "junit_glob", F.lit("app/**/TEST-*0.xml,app/build/test-results/*/TEST-?.xml")),
        (key % 5 == 0, "junit_dir", F.lit("app/build/")),
        (key % 7 == 0, "junit_dir", F.lit("app/buil")),
        (key % 11 == 0, "junit_file", F.concat(F.lit("app/build/test-results/test/TEST-"), key, F.lit(".xml"))),
        (key % 13 == 0, "junit_file", F.lit("nowhere.xml")),
        (key % 17 == 0, "auto_junit_reports", F.lit("false")),
        (key % 19 == 0, "junit_glob", F.lit("*.xml,[!b]pp/**/[^T]*.xml")),
    ]
    items = F.array(
        *[
            F.when(cond, F.struct(F.lit("local").alias("layer"), F.lit(k).alias("key"), v.alias("value")))
            for cond, k, v in entries
        ]
    )
    rows = fixtures.table(spark, sf_dir, "orders").select(key.alias("run_id"), F.explode(items).alias("x"))
    # of two values of one key and layer the later entry stands
    return rows.filter(F.col("x").isNotNull()).groupBy("run_id", "x.key").agg(
        F.first("x.layer").alias("layer"), F.max("x.value").alias("value")
    )


@query(
    "fleet_reports",
    """
    WITH r AS (
      SELECT DISTINCT l_orderkey AS run_id, 'app/build/test-results/test/TEST-' || l_orderkey || '.xml' AS path FROM lineitem),
    s AS (
      SELECT o_orderkey AS run_id,
             o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 AS file_hit, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS named,
             o_orderkey % 5 = 0 AS dir_hit, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS dir,
             -- in a glob only [!...] stands for other characters, so [^T] matches a T
             CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 = 0 OR o_orderkey < 10 ELSE o_orderkey % 19 = 0 END AS glob_hit,
             o_orderkey % 3 = 0 OR o_orderkey % 19 = 0 AS globbed,
             o_orderkey % 17 <> 0 AS auto, o_orderkey % 8 AS program
      FROM orders),
    m AS (SELECT *, file_hit OR dir_hit OR glob_hit AS hit, named OR dir OR globbed AS explicit FROM s)
    SELECT run_id, path, explicit FROM m JOIN r USING (run_id)
    WHERE hit OR (NOT named AND auto AND (program = 0 OR (program IN (2, 3) AND NOT explicit)))
    """,
)
def fleet_reports(spark, sf_dir):
    all_runs = order_runs(spark, sf_dir)
    settings = materialize(runs.resolve_settings(all_runs, _report_settings(spark, sf_dir)))
    reports = fixtures.junit_reports(spark, sf_dir).select("run_id", "path")
    matched = materialize(runs.match_reports(reports, runs.report_inputs(settings)))
    tools = runs.report_tools(all_runs, settings, matched)
    chosen = runs.chosen_reports(reports, matched, tools)
    return chosen.join(tools.select("run_id", "explicit"), "run_id").select("run_id", "path", "explicit")


def _policy_fleet(spark, sf_dir):
    """R3: one run per customer with T1's lines, and settings by modulus that thin and route what is sent."""
    items = fixtures.numbered_items(spark, sf_dir)
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    failed = F.col("l_returnflag") == "R"
    line = F.concat_ws("", F.when(failed, "not ok").otherwise("ok"), F.lit(" part "), F.col("l_partkey") % 9)
    rows = items.join(orders, "l_orderkey")
    chunks = rows.select(
        F.col("o_custkey").alias("run_id"), (F.col("l_orderkey") * 64 + F.col("rn")).cast("bigint").alias("seq"),
        F.concat(line, F.lit("\n")).alias("chunk"),
    )
    customer = fixtures.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    none = F.lit(None)
    all_runs = materialize(
        customer.select(
            key.alias("run_id"), F.col("c_name").alias("project"), none.cast("array<string>").alias("command"),
            none.cast("timestamp").alias("started_at"), none.cast("int").alias("exit_code"),
        )
    )
    entries = [
        (key % 3 == 0, "cli", "dedup_failures", F.lit("false")),
        (key % 4 == 0, "env", "max_failure_notifications", (key % 5).cast("string")),
        (key % 7 == 0, "user", "enabled", F.lit("false")),
        (key % 5 == 0, "local", "include_project_context", F.lit("false")),
        (key % 6 == 0, "cli", "project_label", F.lit("Team")),
        (key % 2 == 0, "env", "summary_format", F.lit("text")),
        (key % 9 == 0, "cli", "summary_format", F.lit("json")),
        (key % 8 == 0, "local", "summary_file", F.concat(F.lit("out"), key % 3, F.lit(".txt"))),
        (key % 16 == 0, "cli", "summary_file", F.lit("-")),
    ]
    given = [
        F.when(cond, F.struct(F.lit(layer).alias("layer"), F.lit(k).alias("key"), v.alias("value")))
        for cond, layer, k, v in entries
    ]
    rows = customer.select(key.alias("run_id"), F.explode(F.array(*given)).alias("x")).filter(F.col("x").isNotNull())
    settings = materialize(runs.resolve_settings(all_runs, rows.select("run_id", "x.*")))
    reports = fixtures.junit_reports(spark, sf_dir).limit(0)
    return analyze_runs(chunks, all_runs, reports, settings)


POLICY = f"""
items AS (
  SELECT o_custkey AS run_id, 'part ' || (l_partkey % 9) AS label, l_returnflag = 'R' AS failed,
         row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, {ITEM_ORDER}) AS line_no
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
listed AS (
  SELECT run_id, CAST(line_no AS INTEGER) AS line_no, label FROM items WHERE failed
  QUALIFY run_id % 3 = 0 OR row_number() OVER (PARTITION BY run_id, label ORDER BY line_no) = 1),
sent AS (
  SELECT run_id, line_no, label FROM listed WHERE run_id % 7 <> 0
  QUALIFY run_id % 4 <> 0 OR row_number() OVER (PARTITION BY run_id ORDER BY line_no) <= run_id % 5),
state AS (
  SELECT c_custkey AS run_id, c_name, count(label) AS total, count(*) FILTER (NOT failed) AS passed, count(*) FILTER (failed) AS failed
  FROM customer LEFT JOIN items ON run_id = c_custkey GROUP BY ALL),
label AS (
  SELECT c_custkey AS run_id,
         CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 'Team' ELSE c_name END AS project
  FROM customer)
"""


@query("fleet_failures", f"WITH {POLICY} SELECT * FROM sent")
def fleet_failures(spark, sf_dir):
    return _policy_fleet(spark, sf_dir).notified().select("run_id", "line_no", "label")


@query(
    "fleet_messages",
    f"""
    WITH {POLICY}
    SELECT run_id, 'failure' AS kind, 'TAP failure' AS title,
           concat_ws(chr(10), 'Runner: TAP', 'Test: ' || label, 'Reason: ' || label, 'Project: ' || project) AS body
    FROM sent JOIN label USING (run_id)
    UNION ALL
    SELECT run_id, 'summary_failure', concat_ws(' - ', 'Run summary', project),
           'status: failure; total: ' || total || '; passed: ' || passed || '; failed: ' || failed || '; todo: 0; skipped: 0'
    FROM state JOIN label USING (run_id) WHERE run_id % 7 <> 0
    """,
)
def fleet_messages(spark, sf_dir):
    return _policy_fleet(spark, sf_dir).messages()


SUMMARIES = f"""
WITH {POLICY}
SELECT run_id, CASE WHEN run_id % 16 <> 0 AND run_id % 8 = 0 THEN 'out' || (run_id % 3) || '.txt' END AS summary_file,
       CASE WHEN run_id % 9 = 0 THEN
         '{{"planned":null,"total":' || total || ',"passed":' || passed || ',"failed":' || failed
         || ',"todo":0,"skipped":0,"bailout_reason":null,"parse_warning_count":0,"protocol_failures":1}}'
       ELSE 'status=failure total=' || total || ' passed=' || passed || ' failed=' || failed
         || ' todo=0 skipped=0 parse_warnings=0' END AS summary
FROM state WHERE run_id % 9 = 0 OR run_id % 2 = 0
"""


@query("fleet_summaries", SUMMARIES)
def fleet_summaries(spark, sf_dir):
    return _policy_fleet(spark, sf_dir).summaries()


@query(
    "written_summaries",
    f"SELECT coalesce(summary_file, '-') AS summary_file, summary FROM ({SUMMARIES})",
)
def written_summaries(spark, sf_dir):
    path = f"{session_folder(spark)}/summaries-{uuid.uuid4().hex}"
    sinks.write_routed(_policy_fleet(spark, sf_dir).summaries(), path)
    return sinks.read_routed(spark, path)
