"""JSON logs: Go and nextest event lines, Jest and Vitest summary documents.

Counts need no order beyond "first" and "last", so a run of any size is folded
by partial aggregates; no run is ever gathered in one task.  For states and failures the text of a
pretty-printed document is put together only up to ``GATHERED_BYTES``; longer ones are read line by line, with
the same result.  ``json_values`` hands on whole values, so there a document of any size is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.functions.jsonvalue import array_at, count_at, json_value, string_at
from testlog.functions.text import nonblank, utrim, with_short_reason
from testlog.operators.durable import any_row, materialize
from testlog.operators.jsondoc import ScannedDocuments, scan_documents
from testlog.operators.ordered import running_total
from testlog.session import configure

# Documents up to this size are parsed as one text for states and failures.
GATHERED_BYTES = 1024 * 1024
# Longer ones are few and hold most lines: each is dealt to so many parts where its lines are picked.
LONG_PARTS = 64

# Labels used when a test has no name.
UNKNOWN = "unknown"
FAILED_ASSERTION = "failed assertion"
FAILED_SUITE = "failed test suite"

# Event names and the counter they add to.
GO_OUTCOMES = {"pass": "passed", "fail": "failed", "skip": "skipped"}
NEXTEST_OUTCOMES = {
    "passed": "passed",
    "ok": "passed",
    "failed": "failed",
    "ignored": "skipped",
    "skipped": "skipped",
    "todo": "todo",
}

DOCUMENT_LINE = 1  # a whole document stands at the run's first line

# Matching brackets have the same number from 1 on; other characters have 0.
OPENING, CLOSING = "{[", "}]"
BRACKETS = len(OPENING) + 1


def _outcome(name: Column, outcomes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in outcomes.items() for x in kv]), name)


def _text(lines: DataFrame) -> DataFrame:
    configure(lines.sparkSession)
    return (
        lines.select("run_id", "line_no", utrim(F.col("line")).alias("text"))
        .filter("text != ''")
        .select("run_id", "line_no", "text")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines that are one JSON value by themselves, with the value as ``v``.

    The generator keeps later filters from being evaluated on the parse itself,
    which would parse each line once more.
    """
    v = json_value(F.col("text"))
    rows = _text(lines).select("run_id", "line_no", F.explode_outer(F.array_compact(F.array(v))).alias("v"))
    return rows.filter(F.col("v").isNotNull())


def _go(v: Column) -> dict[str, Column]:
    test = string_at(v, "$.v.Test")
    package = string_at(v, "$.v.Package")
    action = F.when(test.isNotNull(), string_at(v, "$.v.Action"))
    return {
        "outcome": _outcome(action, GO_OUTCOMES),
        "label": F.coalesce(test, package, F.lit(UNKNOWN)),
        "suite": package,
        "test_file": F.lit(None).cast("string"),
        "reason": string_at(v, "$.v.Output"),
    }


def _nextest(v: Column) -> dict[str, Column]:
    event = F.coalesce(
        string_at(v, "$.v.event"), string_at(v, "$.v.event.status"), string_at(v, "$.v.event.kind")
    )
    return {
        "outcome": _outcome(event, NEXTEST_OUTCOMES),
        "label": F.coalesce(string_at(v, "$.v.name"), string_at(v, "$.v.test"), F.lit(UNKNOWN)),
        "suite": F.coalesce(string_at(v, "$.v.binary_id"), string_at(v, "$.v.package")),
        "test_file": string_at(v, "$.v.test_binary"),
        "reason": F.coalesce(
            string_at(v, "$.v.message"), string_at(v, "$.v.error"), string_at(v, "$.v.event.message")
        ),
    }


def _source(v: Column) -> Column:
    return F.when(string_at(v, "$.v.Action").isNotNull(), F.lit("go")).when(
        string_at(v, "$.v.type") == "test", F.lit("nextest")
    )


def with_source(values: DataFrame) -> DataFrame:
    """Go when ``Action`` is a string, else nextest when ``type`` is 'test', else null."""
    return values.withColumn("source", _source(F.col("v")))


def json_events(values: DataFrame, outcome: str | None = None) -> DataFrame:
    """Go and nextest events; ``outcome`` is null for events that count nothing.

    With ``outcome`` only events of that outcome are returned, and only their
    fields are extracted.
    """
    v = F.col("v")
    go, nextest = _go(v), _nextest(v)
    is_go = F.col("source") == "go"

    def pick(name: str) -> Column:
        return F.when(is_go, go[name]).otherwise(nextest[name])

    rows = with_source(values).filter(F.col("source").isNotNull())
    rows = rows.withColumn("outcome", pick("outcome"))
    if outcome is not None:
        rows = rows.filter(F.col("outcome") == outcome)
    names = ("label", "suite", "test_file", "reason")
    rows = rows.select("run_id", "line_no", "source", "outcome", *[pick(n).alias(n) for n in names])
    return with_short_reason(rows.withColumn("reason", F.coalesce("reason", "label")), "reason")


def go_events(values: DataFrame) -> DataFrame:
    return json_events(values).filter(F.col("source") == "go")


def nextest_events(values: DataFrame) -> DataFrame:
    return json_events(values).filter(F.col("source") == "nextest")


STATED = ("total", "passed", "failed", "skipped", "todo")


def _stated(v: Column) -> tuple[Column, dict[str, Column]]:
    """Kind of a summary document, null for other values, and the counts it states."""
    jest = {
        "total": count_at(v, "$.v.numTotalTests"),
        "passed": count_at(v, "$.v.numPassedTests"),
        "failed": count_at(v, "$.v.numFailedTests"),
        "skipped": count_at(v, "$.v.numPendingTests"),
        "todo": count_at(v, "$.v.numTodoTests"),
    }
    vitest = {
        "total": count_at(v, "$.v.stats.tests"),
        "passed": count_at(v, "$.v.stats.passes"),
        "failed": count_at(v, "$.v.stats.failures"),
        "skipped": count_at(v, "$.v.stats.skipped"),
        "todo": F.lit(None).cast("bigint"),
    }

    def told(c: dict[str, Column]) -> Column:
        return F.coalesce(c["total"], c["passed"], c["failed"]).isNotNull()

    kind = F.when(told(jest), F.lit("jest")).when(told(vitest), F.lit("vitest"))
    is_jest = F.col("kind") == "jest"
    return kind, {n: F.coalesce(F.when(is_jest, jest[n]).otherwise(vitest[n]), F.lit(0)) for n in STATED}


def summary_docs(values: DataFrame) -> DataFrame:
    """Jest and Vitest summary documents with their stated counts."""
    kind, counts = _stated(F.col("v"))
    docs = (
        with_source(values)
        .filter(F.col("source").isNull())
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
    )
    return docs.select(
        "run_id", "line_no", F.col("kind").alias("source"), *[c.alias(n) for n, c in counts.items()], "v"
    )


def value_facts(values: DataFrame) -> DataFrame:
    """What every value counts, row by row: ``outcome`` of an event, or ``kind`` and counts (``doc_..``) of a
    summary document; a null ``v`` counts nothing.  ``v`` and ``source`` are dropped."""
    v = F.col("v")
    kind, counts = _stated(v)
    is_go = F.col("source") == "go"
    outcome = F.when(is_go, _go(v)["outcome"]).when(F.col("source").isNotNull(), _nextest(v)["outcome"])
    rows = with_source(values).withColumns({"outcome": outcome, "kind": F.when(F.col("source").isNull(), kind)})
    stated = {f"doc_{n}": F.when(F.col("kind").isNotNull(), c) for n, c in counts.items()}
    return rows.withColumns(stated).drop("v", "source")


def _items(entry: Column) -> Column:
    """What may have failed in one entry: its assertions, or the entry itself where it lists none."""
    alone = F.array(F.struct(entry.alias("entry"), F.lit(None).cast("variant").alias("assertion")))
    listed = F.transform(
        array_at(entry, "$.assertionResults"),
        lambda a: F.struct(entry.alias("entry"), a.alias("assertion")),
    )
    return F.coalesce(listed, alone)


def doc_failures(docs: DataFrame) -> DataFrame:
    """Failed assertions of each document, and failed entries without assertions."""
    entries = array_at(F.col("v"), "$.v.testResults")
    rows = docs.select(
        "run_id",
        "line_no",
        "source",
        F.posexplode_outer(F.flatten(F.transform(entries, _items))).alias("item_no", "x"),
    )
    return _failed_items(rows)


def entry_failures(docs: DataFrame, scanned: ScannedDocuments) -> DataFrame:
    """The same for documents that were read line by line, from their entries."""
    entry = F.try_variant_get("v", "$.v", "variant")
    rows = scanned.entries.join(docs.select("run_id", "line_no", "source"), "run_id")
    rows = rows.select("run_id", "place", "line_no", "source", F.explode(F.array(_items(entry))).alias("items"))
    # all items are numbered, but only failed ones are carried along
    numbered = F.transform("items", lambda x, pos: F.struct(pos.alias("pos"), x["entry"].alias("entry"), x["assertion"].alias("assertion")))
    failed = F.filter(numbered, lambda x: _status(x["entry"], x["assertion"]) == "failed")
    rows = rows.select("run_id", "place", "line_no", "source", F.size("items").alias("n"), failed.alias("items"))
    rows = running_total(rows, F.col("n"), "before", order="place")
    rows = rows.select("run_id", "line_no", "source", "before", F.explode("items").alias("x"))
    return _failed_items(rows.withColumn("item_no", (F.col("before") + F.col("x.pos")).cast("int")))


def _status(entry: Column, assertion: Column) -> Column:
    return F.when(assertion.isNotNull(), string_at(assertion, "$.status")).otherwise(string_at(entry, "$.status"))


def _failed_items(items: DataFrame) -> DataFrame:
    rows = items.select("run_id", "line_no", "item_no", "source", "x.entry", "x.assertion")
    e, a = F.col("entry"), F.col("assertion")
    of_assertion = a.isNotNull()
    fields = (
        rows.filter(_status(e, a) == "failed")
        .withColumn("name", string_at(e, "$.name"))
        .withColumn("title", string_at(e, "$.title"))
        .withColumn("own", string_at(a, "$.failureMessages[0]"))
        .withColumn("own_single", string_at(a, "$.failureMessage"))
        .withColumn("message", string_at(e, "$.message"))
        .withColumn("single", string_at(e, "$.failureMessage"))
        .withColumn("of_assertion", of_assertion)
        .withColumn(
            "label",
            F.when(
                of_assertion,
                F.coalesce(string_at(a, "$.fullName"), string_at(a, "$.title"), F.lit(FAILED_ASSERTION)),
            ).otherwise(F.coalesce("name", "title", F.lit(FAILED_SUITE))),
        )
    )
    own, own_single, message, single, label = (
        nonblank(F.col(c)) for c in ("own", "own_single", "message", "single", "label")
    )
    reason = F.when(F.col("of_assertion"), F.coalesce(own, own_single, message, label)).otherwise(
        F.coalesce(message, single, label)
    )
    return with_short_reason(fields.withColumn("reason", reason), "reason").select(
        "run_id",
        "line_no",
        "item_no",
        "source",
        "label",
        F.coalesce("name", "title").alias("suite"),
        F.col("name").alias("test_file"),
        "reason",
    )


def _bracket(char: Column, which: str) -> Column:
    return F.when(char != "", F.instr(F.lit(which), char)).otherwise(0)


def run_outline(lines: DataFrame) -> DataFrame:
    """One row per run: event counts and the positions that order-dependent rules need."""
    v = F.col("v")
    go, nextest = _go(v)["outcome"], _nextest(v)["outcome"]
    outcome = F.when(F.col("source") == "go", go).when(F.col("source") == "nextest", nextest)
    # blank lines count nothing, but a run of blank lines only has a row as well
    text = lines.select("run_id", "line_no", utrim(F.col("line")).alias("text")).select("run_id", "line_no", "text")
    told = F.col("text") != ""
    rows = with_source(text.withColumn("v", F.when(told, json_value(F.col("text"))))).select(
        "run_id",
        "line_no",
        told.alias("told"),
        v.isNotNull().alias("valid"),
        outcome.alias("outcome"),
        _bracket(F.left("text", F.lit(1)), OPENING).alias("head"),
        _bracket(F.right("text", F.lit(1)), CLOSING).alias("tail"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    n = F.col("line_no")

    def first(cond: Column) -> Column:
        return F.min(F.when(cond, n))

    def place(bracket: str) -> Column:
        return n.cast("bigint") * BRACKETS + F.col(bracket)

    outline = rows.groupBy("run_id").agg(
        *[
            F.count_if(F.col("outcome") == o).alias(o)
            for o in ("passed", "failed", "skipped", "todo")
        ],
        first(F.col("outcome").isNotNull()).alias("first_event"),
        first(F.col("valid")).alias("first_json"),
        F.max(F.when(~F.col("valid") & F.col("told"), n)).alias("last_noise"),
        # line number and bracket in one number, so that rows need not be sorted to be folded
        F.min(F.when(F.col("told"), place("head"))).alias("start"),
        F.max(F.when(F.col("told"), place("tail"))).alias("end"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.bool_or("told"), F.lit(False)).alias("has_text"),
    )
    opened = F.col("start") % BRACKETS
    closed = (opened > 0) & (opened == F.col("end") % BRACKETS)
    whole = F.col("first_json").isNull() & closed
    return outline.select(
        "run_id",
        "passed",
        "failed",
        "skipped",
        "todo",
        "first_event",
        "first_json",
        "last_noise",
        "has_text",
        F.coalesce(whole, F.lit(False)).alias("maybe_document"),
        "bytes",
    )


def _candidates(lines: DataFrame, outline: DataFrame, which: Column, parts: int = 1) -> DataFrame:
    """Lines of runs without any JSON line, opened and closed by matching brackets; with ``parts`` the lines of a
    run meet its row in so many places."""
    wanted = outline.filter(F.col("maybe_document") & which).select("run_id")
    if parts == 1:
        return lines.join(wanted, "run_id", "left_semi")
    dealt = lines.withColumn("part", F.expr(f"line_no % {parts}"))
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(wanted, ["run_id", "part"], "left_semi").drop("part")


def _one_value(text: Column) -> Column:
    """Is the text one JSON value, whatever its size?"""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return alone & F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$").isNotNull()


def gathered_documents(lines: DataFrame, outline: DataFrame, which: Column) -> DataFrame:
    """The values of documents that are put together.  One that no VARIANT can hold is an error, not left out."""
    text_of = F.col("text")
    lost = F.col("v").isNull() & (F.octet_length(text_of) > GATHERED_BYTES) & _one_value(text_of)
    too_large = F.raise_error(F.concat(F.lit("the document is too large for one value: run "), F.col("run_id").cast("string")))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return (
        _candidates(lines, outline, which)
        .groupBy("run_id")
        .agg(text.alias("text"))
        .withColumn("text", utrim(F.col("text")))
        .select(
            "run_id",
            F.lit(DOCUMENT_LINE).alias("line_no"),
            "text",
            F.explode(F.array(json_value(text_of))).alias("v"),
        )
        .filter(F.when(lost, too_large).otherwise(F.col("v").isNotNull()))
        .drop("text")
    )


def long_documents(lines: DataFrame, outline: DataFrame) -> ScannedDocuments | None:
    """Documents above ``GATHERED_BYTES``, read line by line; None where there is none."""
    long = F.col("bytes") > GATHERED_BYTES
    if not any_row(outline.filter(F.col("maybe_document") & long)):
        return None
    scanned = scan_documents(_candidates(lines, outline, long, LONG_PARTS).select("run_id", "line_no", "line"))
    return ScannedDocuments(materialize(scanned.values), materialize(scanned.entries))


def whole_documents(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """The whole value of runs whose text is one document spread over many lines, whatever its size."""
    return gathered_documents(lines, outline, F.lit(True))


def document_heads(lines: DataFrame, outline: DataFrame, scanned: ScannedDocuments | None) -> DataFrame:
    """What states and events are read from in documents spread over many lines; the entries of ``scanned``
    documents stand in a table of their own."""
    found = gathered_documents(lines, outline, F.col("bytes") <= GATHERED_BYTES)
    if scanned is None:
        return found
    line = F.lit(DOCUMENT_LINE).alias("line_no")
    return found.unionByName(scanned.values.select("run_id", line, "v"))


def json_values(lines: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Every JSON value of every run, whole: value lines, else the whole text."""
    if outline is None:
        outline = materialize(run_outline(lines))
    by_line = parse_lines(lines)
    return by_line.unionByName(whole_documents(lines, outline))


def _applied_docs(lines: DataFrame, outline: DataFrame, documents: DataFrame) -> DataFrame:
    """Summary documents that come before the run's first counted event."""
    line = F.col("line")
    candidates = lines.filter(
        F.contains(line, F.lit('Tests"')) | F.contains(line, F.lit('"stats"')) | F.contains(line, F.lit("\\"))
    )
    by_line = parse_lines(candidates)
    docs = summary_docs(by_line.unionByName(documents))
    seen = outline.select("run_id", "first_event")
    return docs.join(seen, "run_id").filter(
        F.col("first_event").isNull() | (F.col("line_no") < F.col("first_event"))
    )


def _document_events(documents: DataFrame) -> DataFrame:
    """A whole document may itself be a single event."""
    return json_events(documents).filter(F.col("outcome").isNotNull())


def json_run_state(lines: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """State of every JSON run.

    Event counts add up on top of the last summary document before the first
    event; a Vitest document leaves the todo count of an earlier Jest document.
    """
    if outline is None:
        outline = materialize(run_outline(lines))
    documents = materialize(document_heads(lines, outline, long_documents(lines, outline)))
    docs = _applied_docs(lines, outline, documents)
    is_jest = F.col("source") == "jest"
    last = docs.groupBy("run_id").agg(
        F.max_by(F.struct("total", "passed", "failed", "skipped"), "line_no").alias("doc"),
        F.max_by("todo", F.when(is_jest, F.col("line_no"))).alias("doc_todo"),
    )
    single = _document_events(documents).groupBy("run_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"one_{o}") for o in ("passed", "failed", "skipped", "todo")]
    )
    parsed = documents.select("run_id", F.lit(True).alias("parsed")).distinct()
    noisy = F.col("last_noise") > F.col("first_json")
    unreadable = F.col("has_text") & F.col("first_json").isNull() & F.col("parsed").isNull()
    base = (
        outline.join(last, "run_id", "left").join(single, "run_id", "left").join(parsed, "run_id", "left")
    )
    zero = F.lit(0).cast("bigint")

    def event(name: str) -> Column:
        return F.col(name) + F.coalesce(f"one_{name}", zero)

    def stated(name: str) -> Column:
        return F.coalesce(f"doc.{name}", zero)

    observed = event("passed") + event("failed") + event("skipped") + event("todo")
    return base.select(
        "run_id",
        F.lit(None).cast("bigint").alias("planned"),
        (stated("total") + observed).alias("total"),
        (stated("passed") + event("passed")).alias("passed"),
        (stated("failed") + event("failed")).alias("failed"),
        (F.coalesce("doc_todo", zero) + event("todo")).alias("todo"),
        (stated("skipped") + event("skipped")).alias("skipped"),
        F.lit(None).cast("string").alias("bailout_reason"),
        F.when(noisy | unreadable, 1).otherwise(0).cast("bigint").alias("parse_warning_count"),
        zero.alias("protocol_failures"),
    )


def json_failures(lines: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Failures of events and of the documents that apply."""
    if outline is None:
        outline = materialize(run_outline(lines))
    scanned = long_documents(lines, outline)
    documents = materialize(document_heads(lines, outline, scanned))
    by_line = parse_lines(lines)
    failed = json_events(by_line.unionByName(documents), outcome="failed")
    columns = ("run_id", "line_no", "item_no", "source", "label", "suite", "test_file", "reason")
    applied = _applied_docs(lines, outline, documents)
    found = failed.withColumn("item_no", F.lit(0)).select(*columns).unionByName(doc_failures(applied).select(*columns))
    if scanned is not None:
        found = found.unionByName(entry_failures(applied, scanned).select(*columns))
    return found
