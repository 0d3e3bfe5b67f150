"""Streams of short TAP runs, folded in Arrow batches.

Spark makes the tokens, deals them by run and sorts them; a task goes through its lines once, keeps the levels
of the run at hand and hands on one row per (sub)stream: the counts that ``tap.tap_stream_states`` takes from
events.  Rules and paths are those of ``tap_rules`` and ``tap``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from testlog.functions.tap import KIND
from testlog.functions.text import MAX_UNSIGNED
from testlog.operators import tap_rules as R

BATCH_STREAMS = 4096  # streams that are handed on at once

COUNTS = (
    "path array<int>, total bigint, passed bigint, failed bigint, todo bigint, skipped bigint, bailout_reason string, "
    "parse_warning_count bigint, violations bigint, versions bigint, plan_start string, plan_end string, "
    "low_id string, high_id string, ids bigint, last_state int, last_heading int, depth_exceeded bigint, "
    "parent_ok boolean, parent_directive string"
)
NUMBERS = ("plan_start", "plan_end", "low_id", "high_id")  # unsigned, given as texts
GIVEN = ("run_id", "line_no", "code", "strict", "ok", "raw_id", "directive", "plan_start", "plan_end", "reason")
KIND_CODES, TAB_CODES = 16, 2
# role, warnings and violations of an outcome, below the state
OUTCOME = R.pack(1, 0, 0, 0)
START = (R.start_state(False), R.start_state(True))  # by the strict flag


def _classes(code: int, depths: int) -> tuple[int, ...]:
    """Class of a line as seen from every depth; as ``tap._class_sql``."""
    spaces, tab, kind = code // (KIND_CODES * TAB_CODES), code // KIND_CODES % TAB_CODES, code % KIND_CODES
    found = []
    for depth in range(depths):
        n = spaces - 4 * depth
        indent = R.FOUR if n >= 4 else R.TWO if n >= 2 else R.STRAY if n == 1 or (n == 0 and tab) else R.FLUSH
        off_by_one = n == 3 and kind in (KIND["yaml_open"], KIND["yaml_close"])
        found.append(R.line_class(indent, KIND["other"] if off_by_one else kind))
    return tuple(found)


class _Stream:
    """What one (sub)stream counts."""

    __slots__ = (
        "path", "total", "passed", "failed", "todo", "skipped", "reason", "warnings", "violations", "versions",
        "start", "end", "last_id", "ids", "state", "heading", "exceeded", "parent_ok", "parent_directive",
    )

    def __init__(self, path: tuple):
        self.path = path
        self.total = self.passed = self.failed = self.todo = self.skipped = 0
        self.warnings = self.violations = self.versions = self.exceeded = self.last_id = 0
        self.reason = self.start = self.end = self.state = self.heading = None
        self.parent_ok = self.parent_directive = None
        self.ids: set[int] = set()

    def point(self, ok: bool, raw_id: str | None, directive: str | None) -> None:
        self.last_id = self.last_id + 1 if raw_id is None else int(raw_id)
        self.ids.add(min(self.last_id, MAX_UNSIGNED))
        self.total += 1
        if directive is None:
            if ok:
                self.passed += 1
            else:
                self.failed += 1
        elif directive == "TODO":
            self.todo += 1
        else:
            self.skipped += 1

    def about(self, ok: bool, directive: str | None) -> None:
        """The parent's point that stands for this stream."""
        self.parent_ok = ok or bool(self.parent_ok)
        if directive is not None:
            self.parent_directive = max(self.parent_directive or "", directive)

    def row(self, run) -> tuple:
        low, high = (str(min(self.ids)), str(max(self.ids))) if self.ids else (None, None)
        return (
            run, self.path, self.total, self.passed, self.failed, self.todo, self.skipped, self.reason,
            self.warnings, self.violations, self.versions, self.start, self.end, low, high, len(self.ids),
            self.state, self.heading, self.exceeded, self.parent_ok, self.parent_directive,
        )


class _Run:
    """Levels and streams of the run at hand."""

    def __init__(self, run, strict: bool, depths: int):
        self.run, self.depths = run, depths
        self.states = [START[strict]] + [START[False]] * (depths - 1)
        self.heads: list[int | None] = [None] * depths
        self.streams: dict[tuple, _Stream] = {}
        self.open: list[_Stream | None] = [None] * depths

    def stream(self, path: tuple) -> _Stream:
        found = self.streams.get(path)
        if found is None:
            found = self.streams[path] = _Stream(path)
        return found

    def line(self, table, line_no, classes, ok, raw_id, directive, start, end, reason) -> None:
        states, depth = self.states, 0
        while depth + 1 < self.depths and classes[depth] >= R.FIRST_FOUR and states[depth] % 5 >= R.HEADED:
            states[depth] += R.BODY - states[depth] % 5
            depth += 1
        outcome = table[classes[depth] * R.N_STATES + states[depth]]
        state, role = outcome // OUTCOME, outcome // 8 % 16
        states[depth] = state
        level = self.open[depth]
        if level is None:
            level = self.open[depth] = self.stream(tuple(self.heads[:depth]))
        level.state = state
        level.warnings += outcome // 4 % 2
        level.violations += outcome % 4
        if role == _POINT:
            level.point(ok, raw_id, directive)
        elif role == _RESOLVING:
            level.point(ok, raw_id, directive)
            self.stream((*level.path, self.heads[depth])).about(ok, directive)
        elif role == _PLAN:
            level.start, level.end = start, end
        elif role == _SUBTEST:
            level.heading = self.heads[depth] = line_no
            if depth + 1 < self.depths:
                states[depth + 1] = START[state // 20 % 2]
                self.open[depth + 1 :] = [None] * (self.depths - depth - 1)
        elif role == _VERSION:
            level.versions += 1
        elif role == _BAILOUT:
            if level.reason is None:
                level.reason = reason
        elif role == _CAPTURED:
            level.exceeded += 1


_POINT, _RESOLVING, _PLAN, _SUBTEST, _VERSION, _BAILOUT, _CAPTURED = (
    R.ROLE[r] for r in ("point", "resolving_point", "plan", "subtest", "version", "bailout", "captured")
)


def _values(column: pa.Array) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count and not pa.types.is_string(column.type):  # numbers would become fractions
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _fold(batches: Iterator[pa.RecordBatch], depths: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table, known = R.table(), {}
    rows: list[tuple] = []
    run: _Run | None = None

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for given in batches:
        for key, line_no, code, strict, *token in zip(*(_values(given.column(n)) for n in GIVEN)):
            if run is None or run.run != key:
                if run is not None:
                    rows.extend(s.row(run.run) for s in run.streams.values())
                    if len(rows) >= BATCH_STREAMS:
                        yield batch()
                        rows = []
                run = _Run(key, strict, depths)
            classes = known.get(code)
            if classes is None:
                classes = known[code] = _classes(code, depths)
            run.line(table, line_no, classes, *token)
    if run is not None:
        rows.extend(s.row(run.run) for s in run.streams.values())
    if rows:
        yield batch()


def fold_streams(tokens: DataFrame, depths: int, classes: Column) -> DataFrame:
    """``COUNTS`` of every stream of every run, ``tokens`` being in no order.

    ``classes`` orders lines of one number, as does the rest of their token.
    """
    run = StructType([tokens.schema["run_id"]])
    schema = StructType(run.fields + StructType.fromDDL(COUNTS).fields)
    arrow = to_arrow_schema(schema)
    # deeper than any level there is no difference
    spaces = F.least(F.col("spaces"), F.lit(4 * depths)).cast("bigint")
    code = (spaces * TAB_CODES + F.col("tab").cast("int")) * KIND_CODES + F.col("kind")
    token = ("ok", "raw_id", "directive", "plan_start", "plan_end", "reason")
    ordered = (
        tokens.select("run_id", "line_no", "spaces", "tab", "kind", "strict", *token)
        .repartition("run_id")
        .sortWithinPartitions("run_id", "line_no", classes, "kind", *token)
        .withColumns({"code": code, "ok": F.coalesce("ok", F.lit(False)), **{c: F.col(c).cast("string") for c in ("raw_id", "plan_start", "plan_end")}})
        .select(*GIVEN)
    )
    folded = ordered.mapInArrow(lambda batches: _fold(batches, depths, arrow), schema)
    return folded.withColumns({c: F.col(c).cast("decimal(20,0)") for c in NUMBERS})
