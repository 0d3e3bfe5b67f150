"""JUnit XML reports: test cases, report states and failures.

Cases stand at any depth and below any element, in document order, which no fixed
schema can hold; so each report is read by the standard library's XML parser in Arrow
batches, report by report, and everything behind that is column expressions.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.functions.text import WHITE_SPACE

UNNAMED_CASE = "unnamed testcase"

_CASE = pa.struct(
    [(n, pa.string()) for n in ("status", "label", "suite", "test_file", "reason")]
)
_CASE_SQL = "STRUCT<status:STRING,label:STRING,suite:STRING,test_file:STRING,reason:STRING>"
_COUNTS = ("total", "passed", "failed", "skipped")


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _first_line(text: str | None) -> str | None:
    """First non-blank line, trimmed; null when there is none."""
    for line in (text or "").split("\n"):
        if line := line.strip(WHITE_SPACE):
            return line
    return None


class _NoDoctype(ET.TreeBuilder):
    """Builds the tree; a document type makes a report unreadable."""

    def doctype(self, name: str, pubid: str | None, system: str | None) -> None:
        raise ET.ParseError("document type")


def _root(content: str | None) -> ET.Element | None:
    """The report's root element, or null when the text is not well-formed."""
    parser = ET.XMLParser(target=_NoDoctype())
    try:
        parser.feed((content or "").removeprefix("﻿"))
        return parser.close()
    except (ET.ParseError, UnicodeEncodeError):
        return None


def _case(case: ET.Element, suite: str | None, file: str | None) -> dict[str, str | None]:
    kinds = [(_local(child), child) for child in case]
    problem = next((child for kind, child in kinds if kind in ("failure", "error")), None)
    if any(kind == "skipped" for kind, _ in kinds):
        status, problem = "skipped", None
    else:
        status = "passed" if problem is None else "failed"
    name = case.get("name", UNNAMED_CASE).strip(WHITE_SPACE)
    group = case.get("classname", "").strip(WHITE_SPACE)
    reason = None
    if problem is not None:
        reason = _first_line(problem.get("message")) or _first_line(problem.text)
    return {
        "status": status,
        "label": "::".join(part for part in (group, name) if part) or UNNAMED_CASE,
        "suite": suite,
        "test_file": case.get("file", file),
        "reason": reason,
    }


def _walk(root: ET.Element) -> Iterator[dict[str, str | None]]:
    """Cases in document order; suite name and file come from the nearest suite with one."""
    waiting: list[tuple[ET.Element, str | None, str | None]] = [(root, None, None)]
    while waiting:
        element, suite, file = waiting.pop()
        kind = _local(element)
        if kind == "testcase":
            yield _case(element, suite, file)
        elif kind == "testsuite":
            suite, file = element.get("name", suite), element.get("file", file)
        waiting.extend((child, suite, file) for child in reversed(element))


def _read(reports: DataFrame, with_cases: bool) -> DataFrame:
    """One row per report: malformed, counts by status and, if asked for, the cases."""
    keys = reports.select("run_id", "path")
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields]
        + ["malformed boolean", *[f"{c} long" for c in _COUNTS], f"cases array<{_CASE_SQL}>"]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            malformed, counts, listed = [], [], []
            for content in batch.column("content").to_pylist():
                root = _root(content)
                cases = list(_walk(root)) if root is not None else []
                statuses = [c["status"] for c in cases]
                malformed.append(root is None)
                counts.append([len(cases), *(statuses.count(s) for s in ("passed", "failed", "skipped"))])
                listed.append(cases if with_cases else None)
            columns = zip(*counts) if counts else [()] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("run_id"),
                    batch.column("path"),
                    pa.array(malformed, pa.bool_()),
                    *[pa.array(c, pa.int64()) for c in columns],
                    pa.array(listed, pa.list_(_CASE)),
                ],
                names=["run_id", "path", "malformed", *_COUNTS, "cases"],
            )

    return reports.select("run_id", "path", "content").mapInArrow(run, schema)


def junit_cases(reports: DataFrame) -> DataFrame:
    """Every test case of well-formed reports: status, label and failure fields.

    ``case_no`` is the place in the document.
    """
    return (
        _read(reports, with_cases=True)
        .select("run_id", "path", F.posexplode("cases").alias("case_no", "c"))
        .select("run_id", "path", "case_no", "c.*")
    )


def parse_junit(reports: DataFrame) -> DataFrame:
    """One row per report: is it well-formed, and how many cases it has."""
    return _read(reports, with_cases=False).select("run_id", "path", "malformed", "total")


def junit_report_state(reports: DataFrame) -> DataFrame:
    """State of each report; a malformed one is one parse warning and no cases."""
    zero = F.lit(0).cast("bigint")
    return _read(reports, with_cases=False).select(
        "run_id",
        "path",
        F.lit(None).cast("bigint").alias("planned"),
        "total",
        "passed",
        "failed",
        zero.alias("todo"),
        "skipped",
        F.lit(None).cast("string").alias("bailout_reason"),
        F.col("malformed").cast("bigint").alias("parse_warning_count"),
        zero.alias("protocol_failures"),
    )


def junit_run_state(reports: DataFrame) -> DataFrame:
    """States of a run's reports added up."""
    states = junit_report_state(reports)
    sums = ("total", "passed", "failed", "todo", "skipped")
    return states.groupBy("run_id").agg(
        F.lit(None).cast("bigint").alias("planned"),
        *[F.sum(c).alias(c) for c in sums],
        F.lit(None).cast("string").alias("bailout_reason"),
        F.sum("parse_warning_count").alias("parse_warning_count"),
        F.sum("protocol_failures").alias("protocol_failures"),
    )


def junit_failures(cases: DataFrame) -> DataFrame:
    """Failed cases; ``path`` and ``case_no`` give their order within a run."""
    return cases.filter(F.col("status") == "failed").select(
        "run_id", "path", "case_no", F.lit("junit").alias("source"), "label", "suite", "test_file", "reason"
    )
