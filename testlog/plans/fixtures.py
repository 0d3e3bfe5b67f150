"""Logs and reports rendered from the driver's tables.

Spark writes the text from columns and the operators read it back; the expected
results are computed from the columns without touching any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the row's number ``rn`` in its order and the order's size ``n``."""
    item = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return item.withColumn("rn", F.row_number().over(order)).withColumn(
        "n", F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))
    )


def explode_lines(rows: DataFrame, run: str, *entries: tuple[Column, Column, Column]) -> DataFrame:
    """Lines (condition, line number, text) emitted by each row."""
    items = F.array(
        *[F.when(c, F.struct(n.cast("int").alias("line_no"), t.alias("line"))) for c, n, t in entries]
    )
    return rows.select(
        F.col(run).alias("run_id"), F.explode(items).alias("x")
    ).filter(F.col("x").isNotNull()).select("run_id", "x.line_no", "x.line")


def as_chunks(lines: DataFrame, straddle: bool = False) -> DataFrame:
    """One chunk per line; with ``straddle`` each line's end opens the next chunk."""
    nl = F.lit("\n")
    if not straddle:
        chunk = F.concat("line", nl)
    else:
        chunk = F.when(F.col("line_no") == 1, F.col("line")).otherwise(F.concat(nl, F.col("line")))
    return lines.select("run_id", F.col("line_no").cast("bigint").alias("seq"), chunk.alias("chunk"))


def _word() -> Column:
    return F.when(F.col("l_returnflag") == "R", "not ok").otherwise("ok")


def _directive() -> Column:
    a = F.col("l_returnflag") == "A"
    return (
        F.when(a & (F.col("l_linestatus") == "F"), " # TODO later")
        .when(a & (F.col("l_linestatus") == "O"), " # SKIP")
        .otherwise("")
    )


def flat_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: version, plan (one too many every seventh order), a point per line item."""
    rows = numbered_items(spark, sf_dir)
    first = F.col("rn") == 1
    plan = F.concat(
        F.lit("1.."), F.col("n") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    )
    point = F.concat_ws(
        "", _word(), F.lit(" "), F.col("rn"), F.lit(" - part "), F.col("l_partkey"), _directive()
    )
    return explode_lines(
        rows,
        "l_orderkey",
        (first, F.lit(1), F.lit("TAP version 14")),
        (first, F.lit(2), plan),
        (F.lit(True), F.col("rn") + 2, point),
    )


def odd_ids_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: repeated and missing ids; plan first, last or absent."""
    rows = numbered_items(spark, sf_dir)
    key = F.col("l_orderkey")
    absent = key % 11 == 0
    last = (key % 2 == 0) & ~absent
    lead = ~last & ~absent
    plan = F.concat(F.lit("1.."), F.col("n"))
    point = F.concat_ws(
        "",
        _word(),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("l_linenumber"))),
        F.lit(" part "),
        F.col("l_partkey"),
        _directive(),
    )
    return explode_lines(
        rows,
        "l_orderkey",
        (lead & (F.col("rn") == 1), F.lit(1), plan),
        (F.lit(True), F.col("rn") + F.when(lead, 1).otherwise(0), point),
        (last & (F.col("rn") == F.col("n")), F.col("n") + 1, plan),
    )


def text_chunks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _chunk(rows: DataFrame, run: str, seq: Column, text: Column) -> DataFrame:
    return rows.select(F.col(run).alias("run_id"), seq.cast("bigint").alias("seq"), text.alias("chunk"))


def nested_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 as chunks: each order of a customer is a subtest with a parent point by status.

    Orders with status P have no parent point; orders without items leave a
    heading without body.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    point = F.concat_ws("", F.lit("    "), _word(), F.lit(" "), F.col("rn"), F.lit(" - part "), F.col("l_partkey"), _directive())
    body = numbered_items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.concat(F.lit("    1.."), F.count(F.lit(1)), F.lit("\n")).alias("plan"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rn", point.alias("t")))),
                lambda x: F.concat(x["t"], F.lit("\n")),
            ),
            "",
        ).alias("points"),
    )
    parent = F.when(F.col("o_orderstatus") == "F", "not ok - order\n").when(
        F.col("o_orderstatus") == "O", "ok - order\n"
    )
    text = F.concat_ws(
        "", F.lit("# Subtest: order "), F.col("o_orderkey"), F.lit("\n"), F.col("plan"), F.col("points"), parent
    )
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.join(body, "o_orderkey", "left").withColumn("place", place)
    plans = orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("m")
    )
    return text_chunks(
        _chunk(plans, "o_custkey", F.lit(0), F.concat(F.lit("TAP version 14\n1.."), F.col("m"), F.lit("\n"))),
        _chunk(rows, "o_custkey", F.col("place"), text),
    )


def busy_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 as chunks: T1 with YAML blocks, stray lines, strict pragmas and bailouts."""
    rows = numbered_items(spark, sf_dir)
    key, rn, n = F.col("l_orderkey"), F.col("rn"), F.col("n")
    nl = F.lit("\n")
    lead = F.when(
        rn == 1,
        F.concat_ws(
            "",
            F.lit("TAP version 13\n"),
            F.when(key % 6 == 0, F.lit("pragma +strict\n")),
            F.lit("1.."),
            n,
            nl,
        ),
    )
    point = F.concat_ws("", _word(), F.lit(" "), rn, F.lit(" - part \\# "), F.col("l_partkey"), _directive(), nl)
    yaml = F.when(F.col("l_returnflag") == "R", F.lit("  ---\n  message: bad\n  at: 1..2\n  ...\n"))
    odd = F.when((key % 9 == 0) & (rn == 1), F.lit("   odd\n"))
    stray = F.when((key % 4 == 0) & (rn % 5 == 4), F.lit("stray text\n"))
    bail = F.when((key % 13 == 0) & (rn == n), F.concat(F.lit("bail out! order "), key, nl))
    return _chunk(rows, "l_orderkey", rn, F.concat_ws("", lead, point, yaml, odd, stray, bail))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w))


def _pick(column: str, mapping: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(column))


GO_ACTIONS = {"click": "pass", "error": "fail", "signup": "skip", "view": "run", "purchase": "output"}


def go_line() -> Column:
    eid = F.col("event_id")
    return F.to_json(
        F.struct(
            F.lit("2024-01-01T00:00:00Z").alias("Time"),
            _pick("event_type", GO_ACTIONS).alias("Action"),
            F.concat(F.lit("pkg/"), F.col("user_id") % 7).alias("Package"),
            F.concat(F.lit("T"), eid).alias("Test"),
            F.when(eid % 2 == 0, F.concat(F.lit("\n  boom "), eid, F.lit("\nmore"))).alias("Output"),
            F.col("value").alias("Elapsed"),
        )
    )


def go_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: one Go test event per event row."""
    return numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), F.col("rn").alias("line_no"), go_line().alias("line")
    )


NEXTEST_PLAIN = {"click": "ok", "error": "failed", "signup": "ignored", "view": "todo", "purchase": "started"}
NEXTEST_NESTED = {"click": "passed", "error": "failed", "signup": "skipped", "view": "todo", "purchase": "started"}


def nextest_line() -> Column:
    eid = F.col("event_id")
    nested = F.when(
        eid % 4 == 1,
        F.struct(
            _pick("event_type", NEXTEST_NESTED).alias("status"),
            F.lit(None).cast("string").alias("kind"),
            F.concat(F.lit("nested "), eid).alias("message"),
        ),
    ).otherwise(
        F.struct(
            F.lit(None).cast("string").alias("status"),
            _pick("event_type", NEXTEST_NESTED).alias("kind"),
            F.lit(None).cast("string").alias("message"),
        )
    )
    common = [
        F.lit("test").alias("type"),
        F.when(eid % 3 != 0, F.concat(F.lit("n"), eid)).alias("name"),
        F.concat(F.lit("t"), eid).alias("test"),
        F.when(eid % 5 == 0, F.concat(F.lit("bin"), F.col("user_id"))).alias("binary_id"),
        F.lit("crate").alias("package"),
        F.when(eid % 7 == 0, F.lit("/bin/x")).alias("test_binary"),
        F.when(eid % 6 == 0, F.concat(F.lit("msg "), eid)).alias("message"),
    ]
    plain = F.to_json(F.struct(*common, _pick("event_type", NEXTEST_PLAIN).alias("event")))
    return F.when(eid % 2 == 0, plain).otherwise(F.to_json(F.struct(*common, nested.alias("event"))))


def nextest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: nextest events, named by a string or inside an object."""
    return numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), F.col("rn").alias("line_no"), nextest_line().alias("line")
    )


FIRST_DOC = '{"numTotalTests":5,"numPassedTests":3,"numFailedTests":1,"numPendingTests":1,"numTodoTests":0}'
LAST_DOC = '{"numTotalTests":9,"numPassedTests":8,"numFailedTests":0,"numPendingTests":0,"numTodoTests":1}'


def noisy_go_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4: G1 with noise after every tenth line, and summary documents around the events."""
    rows = numbered_events(spark, sf_dir).withColumn(
        "n", F.count(F.lit(1)).over(W.partitionBy("user_id"))
    )
    rn = F.col("rn")
    lead = F.when((rn == 1) & (F.col("user_id") % 3 == 0), F.lit(FIRST_DOC + "\r\n"))
    noise = F.when(rn % 10 == 0, F.lit("-- noise --\r"))
    tail = F.when(rn == F.col("n"), F.lit(LAST_DOC))
    return _chunk(rows, "user_id", rn, F.concat_ws("", lead, go_line(), F.lit("\n"), noise, tail))


def _counts_over_order(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("l_orderkey")
    flag = F.col("l_returnflag")
    return (
        rows.withColumn("n_pass", F.count_if(flag == "N").over(w))
        .withColumn("n_fail", F.count_if(flag == "R").over(w))
        .withColumn("n_skip", F.count_if(flag == "A").over(w))
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: one pretty-printed summary document per order, Jest (even) or Vitest (odd)."""
    rows = _counts_over_order(numbered_items(spark, sf_dir))
    key, rn, n, part = F.col("l_orderkey"), F.col("rn"), F.col("n"), F.col("l_partkey")
    jest = F.concat_ws(
        "",
        F.lit('{\n  "numTotalTests": '), n, F.lit(',\n  "numPassedTests": '), "n_pass",
        F.lit(',\n  "numFailedTests": '), "n_fail", F.lit(',\n  "numPendingTests": '), "n_skip",
        F.lit(',\n  "numTodoTests": 0,\n  "testResults": [\n'),
    )
    vitest = F.concat_ws(
        "",
        F.lit('{\n  "stats": {"tests": '), n, F.lit(', "passes": '), "n_pass",
        F.lit(', "failures": '), "n_fail", F.lit(', "skipped": '), "n_skip",
        F.lit('},\n  "testResults": [\n'),
    )
    lead = F.when(rn == 1, F.when(key % 2 == 0, jest).otherwise(vitest))
    failed = F.col("l_returnflag") == "R"
    listed = F.col("l_linenumber") % 2 == 1
    assertions = F.concat_ws(
        "",
        F.lit('      "assertionResults": [\n        {"status": "failed", "fullName": "part '), part,
        F.lit('", "failureMessages": ["bad '), part, F.lit('\\nmore"]}\n      ],\n'),
    )
    item = F.concat_ws(
        "",
        F.lit('    {\n'),
        F.when(failed & listed, assertions),
        F.when(~failed, F.lit('      "assertionResults": [],\n')),
        F.lit('      "status": "'), F.when(failed, "failed").otherwise("passed"),
        F.lit('",\n      "name": "suite '), rn, F.lit('"\n    }'),
        F.when(rn < n, F.lit(",\n")).otherwise(F.lit("\n  ]\n}\n")),
    )
    # a brace-only assertion line would be a JSON value of its own; keep it open
    item = F.replace(item, F.lit('"]}\n'), F.lit('"]\n        }\n'))
    return _chunk(rows, "l_orderkey", rn, F.concat_ws("", lead, item))


def bun_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: dots (key % 3 = 0), a failures section (else key % 5 = 0), or inline failures."""
    rows = _counts_over_order(numbered_items(spark, sf_dir))
    key, rn, n, part = F.col("l_orderkey"), F.col("rn"), F.col("n"), F.col("l_partkey")
    flag = F.col("l_returnflag")
    dots, section = key % 3 == 0, (key % 3 != 0) & (key % 5 == 0)
    lead = F.when(rn == 1, F.lit("bun test v1.1\n\n"))
    char = F.when(flag == "R", "F").when(flag == "A", "s").otherwise(".")
    passed = F.when(flag == "N", F.concat(F.lit("(pass) part "), part, F.lit("\n")))
    inline = F.when(flag == "R", F.concat(F.lit("(fail) part "), part, F.lit(" [1.25ms]\n")))
    here = F.when(dots, char).when(section, passed).otherwise(F.coalesce(passed, inline))
    first = _chunk(rows, "l_orderkey", rn, F.concat_ws("", lead, here))
    # the section comes after all items of the order
    title = F.when(rn == 1, F.lit("Failures:\n"))
    entry = F.when(flag == "R", F.concat(F.lit("  - part "), part, F.lit("\n")))
    close = F.when(
        rn == n,
        F.concat_ws("", F.lit("\n"), F.when(key % 2 == 0, F.concat(F.lit(" "), "n_pass", F.lit(" pass\n")))),
    )
    second = _chunk(
        rows.filter(section), "l_orderkey", rn + n, F.concat_ws("", title, entry, close)
    )
    totals = F.concat_ws(
        "",
        F.lit("\n "), "n_pass", F.lit(" pass\n "), "n_fail", F.lit(" fail\n "), "n_skip",
        F.lit(" skip\nRan "), n, F.lit(" tests across 1 files. [5.00ms]\n"),
    )
    third = _chunk(rows.filter(~dots & ~section & (rn == n)), "l_orderkey", rn + n, totals)
    return text_chunks(first, second, third)


def junit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1: one report per order; root and nesting by order key."""
    rows = numbered_items(spark, sf_dir)
    key, rn, part = F.col("l_orderkey"), F.col("rn"), F.col("l_partkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    inner = (
        F.when(flag == "A", F.lit("<skipped/>"))
        .when(
            (flag == "R") & (status == "F"),
            F.concat_ws("", F.lit('<failure message="bad &lt;'), part, F.lit('&gt;">trace</failure>')),
        )
        .when(flag == "R", F.concat_ws("", F.lit("<error>\n  trace "), part, F.lit("\n  more\n</error>")))
    )
    file = F.when(rn % 2 == 0, F.concat_ws("", F.lit(' file="f'), rn, F.lit('.py"')))
    case = F.concat_ws(
        "",
        F.lit('<testcase name="part '), part, F.lit('" classname="c'), rn % 3, F.lit('"'), file,
        F.lit(">"), inner, F.lit("</testcase>\n"),
    )
    cases = rows.groupBy("l_orderkey").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", case.alias("t")))), lambda x: x["t"]), ""
        ).alias("cases"),
        F.min("l_shipdate").alias("modified"),
    )
    nested = F.when(
        key % 4 == 0,
        F.concat_ws("", F.lit('<testsuite file="inner.py">\n'), "cases", F.lit("</testsuite>\n")),
    ).otherwise(F.col("cases"))
    suite = F.concat_ws("", F.lit('<testsuite name="order '), key, F.lit('">\n'), nested, F.lit("</testsuite>\n"))
    root = F.when(
        key % 2 == 0, F.concat_ws("", F.lit("<testsuites>\n"), suite, F.lit("</testsuites>\n"))
    ).otherwise(suite)
    content = F.concat_ws("", F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), root)
    # some reports are cut off
    content = F.when(key % 17 == 0, F.left(content, F.char_length(content) - 5)).otherwise(content)
    return cases.select(
        key.alias("run_id"),
        F.concat_ws("", F.lit("app/build/test-results/test/TEST-"), key, F.lit(".xml")).alias("path"),
        "modified",
        content.alias("content"),
    )


def deep_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2: one report per order; each case stands part key modulo 9 + 1 suites deep."""
    rows = numbered_items(spark, sf_dir)
    part = F.col("l_partkey")
    depth = (part % 9).cast("int")
    failure = F.when(
        F.col("l_returnflag") == "R",
        F.concat_ws("", F.lit("<failure><![CDATA[\n<error code="), part, F.lit("> raised]]></failure><error/>")),
    )
    case = F.concat_ws("", F.lit('<testcase name="part '), part, F.lit('">'), failure, F.lit("</testcase>"))
    nested = F.concat(
        F.repeat(F.lit("<testsuite><group>"), depth),
        F.concat_ws("", F.lit('<testsuite name="suite '), depth, F.lit('">')),
        case,
        F.lit("</testsuite>"),
        F.repeat(F.lit("</group></testsuite>"), depth),
    )
    body = F.transform(F.array_sort(F.collect_list(F.struct("rn", nested.alias("t")))), lambda x: x["t"])
    return rows.groupBy("l_orderkey").agg(F.array_join(body, "\n").alias("body")).select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("", F.lit("TEST-"), "l_orderkey", F.lit(".xml")).alias("path"),
        F.concat_ws("", F.lit("<report>"), "body", F.lit("</report>")).alias("content"),
    )


def deep_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9: one run per customer, with subtests nested customer key modulo 8 deep.

    The innermost stream fails for a negative balance; the points above it agree,
    except that every third customer's claim success throughout.
    """
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"),
        (F.col("c_custkey") % 8).cast("int").alias("depth"),
        F.when(F.col("c_acctbal") < 0, F.lit("not ok")).otherwise(F.lit("ok")).alias("inner"),
        (F.col("c_custkey") % 3 == 0).alias("boast"),
    )
    lines = F.expr(
        "concat(array('TAP version 14'), "
        "transform(sequence(0, 7), k -> IF(k < depth, concat(repeat('    ', k), '# Subtest: level ', k), NULL)), "
        "array(concat(repeat('    ', depth), inner, ' 1 - innermost'), concat(repeat('    ', depth), '1..1')), "
        "flatten(transform(sequence(7, 0), k -> IF(k < depth, array("
        "concat(repeat('    ', k), IF(boast, 'ok', inner), ' 1 - level ', k), concat(repeat('    ', k), '1..1')), "
        "array()))))"
    )
    return rows.select("run_id", F.posexplode(F.array_compact(lines)).alias("at", "line")).select(
        "run_id", (F.col("at") + 1).alias("line_no"), "line"
    )


HUGE_RUNS = 4


def huge_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5: all line items as the entries of a few pretty-printed documents, their counts at the end."""
    rows = numbered_items(spark, sf_dir).withColumn("run", F.col("l_orderkey") % HUGE_RUNS)
    failed = F.col("l_returnflag") == "R"
    nested = F.col("l_linenumber") % 2 == 1
    entry = F.concat_ws(
        "",
        F.lit(',\n  {"name": "order '), "l_orderkey", F.lit('",\n   "status": "'),
        F.when(failed, "failed").otherwise("passed"), F.lit('", "note": "a } and a ] \\" within",\n   "message": "bad '),
        "l_partkey", F.lit('"'),
        F.when(nested, F.concat_ws(
            "", F.lit(',\n   "assertionResults": [\n    {"title": "part '), "l_partkey", F.lit('",\n     "status": "'),
            F.when(failed, "failed").otherwise("passed"), F.lit('"\n    }\n   ]'))),
        F.lit("\n  }"),
    )
    items = _chunk(rows, "run", F.col("l_orderkey") * 64 + F.col("rn"), entry)
    counts = rows.groupBy("run").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("l_returnflag") == f).alias(c) for f, c in (("N", "ok"), ("R", "bad"), ("A", "left"))],
        F.max("l_orderkey").alias("last"),
    )
    head = _chunk(counts, "run", F.lit(0), F.lit('{\n "testResults": [\n  {"name": "first",\n   "status": "passed"}'))
    tail = F.concat_ws(
        "", F.lit('\n ],\n "stats": {\n  "tests": '), "n", F.lit(', "passes": '), "ok", F.lit(',\n  "failures": '), "bad",
        F.lit(', "skipped": '), "left", F.lit("\n }\n}\n"),
    )
    return head.unionByName(items).unionByName(_chunk(counts, "run", (F.col("last") + 1) * 64, tail))
