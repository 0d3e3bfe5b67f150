"""Whole run states at the end of a run on a stream, for TAP and JSON logs.

What a single line says is worked out on the executors' JVM side, line by line.  The state of a
run holds only what later lines can still change: for TAP the stack of open levels, for JSON the
counts, the positions that order-dependent rules need, and the lines of a document as long as no
line was a value by itself.  TAP lines that come early wait until those before them are there.
A run ends when no line of it came for a while (event time); lines that are still missing then are
passed over.

A call to the state of a key, and a key in a batch, cost far more than a line.  Runs are therefore dealt to a fixed
number of buckets, and a bucket's open runs stand in one value, read and written once in a batch.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from testlog.functions.jsonvalue import json_value
from testlog.functions.tap import KINDS, UNNAMED_TEST, tap_tokens
from testlog.functions.text import MAX_BIGINT, MAX_UNSIGNED, utrim
from testlog.operators.failures import REMEMBERED, dedup_key
from testlog.operators.jsonlog import STATED, value_facts
from testlog.operators.tap_rules import BODY, FLUSH, FOUR, HEADED, STRAY, TWO, level_at, start_state, transition
from testlog.schema import COUNTERS, RUN_STATE, STATE_COLUMNS

IDLE_MS = 3_600_000
DELAY = "10 minutes"
HELD_CHARS = 1 << 14  # characters of waiting lines in a run's own value
BUCKETS = 512  # that runs are dealt to
BUCKET_CHARS = 1 << 24  # characters in a bucket's own value from which on lines wait in rows of their own
OUT_CHARS = 1 << 23  # of documents that are handed on at once


class Ids:
    """A set of numbers kept as ranges; ids of a run mostly follow one another."""

    def __init__(self, ranges: list[list[int]]):
        self.ranges = ranges

    def add(self, n: int) -> bool:
        """Was the number there already?"""
        at = bisect_right(self.ranges, [n, MAX_UNSIGNED]) - 1
        if at >= 0 and n <= self.ranges[at][1]:
            return True
        joins_next = at + 1 < len(self.ranges) and self.ranges[at + 1][0] == n + 1
        if at >= 0 and self.ranges[at][1] == n - 1:
            self.ranges[at][1] = self.ranges[at + 1][1] if joins_next else n
            if joins_next:
                del self.ranges[at + 1]
        elif joins_next:
            self.ranges[at + 1][0] = n
        else:
            self.ranges.insert(at + 1, [n, n])
        return False


def new_level(strict: bool) -> dict:
    return {
        "at": start_state(strict), "planned": None, "bounds": None, "last": 0, "ids": [], "versions": 0, "child": None,
        "bailout": None, "warnings": 0, "failures": 0, **dict.fromkeys(COUNTERS, 0),
    }


def _good(level: dict) -> bool:
    return (
        level["failed"] == 0 and level["bailout"] is None and level["failures"] == 0
        and level["planned"] in (None, level["total"])
    )


@cache
def _step(at: int, indent: int, kind: str) -> tuple[int, str, int, int, bool, bool]:
    """``transition`` by the numbers of states; was the level in a body before, and is it strict after?"""
    before = level_at(at)
    after, role, warnings, failures = transition(before, indent, kind)
    return after.index(), role, warnings, failures, before.mode == BODY, after.strict


class TapFold:
    """The open levels of a TAP run; ``stack[0]`` is the run itself."""

    def __init__(self, stack: list[dict], enforced: bool):
        self.stack, self.enforced = stack, enforced

    def line(self, spaces: int, tab: bool, kind: str, token: dict) -> str | None:
        """Take the next line in order; the label of a failure of the run itself, if it is one."""
        if self.enforced and kind in ("strict_on", "strict_off"):
            kind = "pragma"
        depth = 0
        while True:
            level = self.stack[depth]
            left = spaces - 4 * depth
            indent = FOUR if left >= 4 else TWO if left >= 2 else STRAY if left or tab else FLUSH
            if left > 2 and kind in ("yaml_open", "yaml_close"):
                kind = "other"
            level["at"], role, warnings, failures, in_body, strict = _step(level["at"], indent, kind)
            if in_body and role != "captured":
                self._close(depth)
            level["warnings"] += warnings
            level["failures"] += failures
            if role != "captured":
                return self._act(level, role, kind, token) if depth == 0 else self._act(level, role, kind, token) and None
            if depth + 1 == len(self.stack):
                self.stack.append(new_level(strict))
            depth += 1

    def _act(self, level: dict, role: str, kind: str, token: dict) -> str | None:
        if role == "version":
            level["failures"] += level["versions"] > 0
            level["versions"] += 1
        elif role == "bailout" and level["bailout"] is None:
            level["bailout"] = token["reason"] or ""
        elif role == "plan":
            start, end = int(token["plan_start"]), int(token["plan_end"])
            level["bounds"] = [start, end]
            level["failures"] += start != 1
            if (start, end) == (1, 0):
                level["planned"] = 0
            elif start > end:
                level["failures"] += 1
            else:
                level["planned"] = end - start + 1
        elif role in ("point", "resolving_point"):
            ok, directive = bool(token["ok"]), token["directive"]
            if role == "resolving_point" and directive is None:
                level["failures"] += ok != level["child"]
            raw = token["raw_id"]
            level["last"] = min(level["last"] + 1, MAX_UNSIGNED) if raw is None else int(raw)
            level["failures"] += Ids(level["ids"]).add(level["last"])
            outcome = {"TODO": "todo", "SKIP": "skipped"}.get(directive, "passed" if ok else "failed")
            level["total"] += 1
            level[outcome] += 1
            if outcome == "failed":
                return token["description"] or UNNAMED_TEST
        return None

    def _close(self, depth: int) -> None:
        """Finish the levels below ``depth``, deepest first."""
        while len(self.stack) > depth + 1:
            child = self.stack.pop()
            self._finish(child)
            parent = self.stack[-1]
            parent["warnings"] += child["warnings"]
            parent["failures"] += child["failures"] + (child["bailout"] is not None)
            parent["child"] = _good(child)

    def _finish(self, level: dict) -> None:
        at = level_at(level["at"])
        if at.mode == HEADED:  # a subtest that was announced and never came has no plan
            level["failures"] += 1
        level["failures"] += at.pending or at.mode in (HEADED, BODY)
        level["failures"] += level["bounds"] is None
        level["failures"] += level["planned"] == 0 and level["total"] > 0
        if level["bounds"]:
            start, end = level["bounds"]
            level["failures"] += any(low < start or high > end for low, high in level["ids"])

    def end(self) -> dict:
        self._close(0)
        run = self.stack[0]
        self._finish(run)
        planned = run["planned"]
        return {
            "planned": planned if planned is None else min(planned, MAX_BIGINT),
            **{c: run[c] for c in COUNTERS},
            "bailout_reason": run["bailout"],
            "parse_warning_count": run["warnings"],
            "protocol_failures": run["failures"],
        }


TOKEN = "spaces INT, tab BOOLEAN, kind INT, ok BOOLEAN, raw_id STRING, directive STRING, description STRING, plan_start STRING, plan_end STRING, reason STRING"
TOKEN_NAMES = [c.split()[0] for c in TOKEN.split(", ")]
TAP_ROWS = f"run_id BIGINT, event_us BIGINT, line_no BIGINT, label STRING, closed BOOLEAN, {RUN_STATE}"
TOLD_KINDS = ("bailout", "plan", "point")  # kinds of lines of which more than the kind counts
EMPTY_STATE = dict.fromkeys(STATE_COLUMNS)


def _millis(stamps: pd.Series) -> int:
    return int(stamps.max().timestamp() * 1000)


def _micros(stamp: pd.Timestamp) -> int | None:
    return None if stamp is pd.NaT else stamp.value // 1000


def _plain(value):
    return None if value is None or value is pd.NaT or value != value else value


def _packed(row: tuple) -> str:
    """A line's time and token as one text."""
    stamp, spaces, tab, kind, *rest = row
    return json.dumps([stamp, int(spaces), bool(tab), int(kind), *map(_plain, rest)])


def _unpacked(text: str) -> tuple:
    return tuple(json.loads(text))


class Room:
    """How many characters a value of the state holds, and how many it may."""

    def __init__(self, chars: int, limit: int):
        self.chars, self.limit = chars, limit


class RunRows:
    """The rows of one run in a bucket's map."""

    def __init__(self, rows, run: str):
        self.rows, self.run = rows, run

    def containsKey(self, key: tuple) -> bool:
        return self.rows.containsKey((self.run, *key))

    def getValue(self, key: tuple) -> tuple:
        return self.rows.getValue((self.run, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.rows.updateValue((self.run, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.rows.removeKey((self.run, *key))

    def iterator(self) -> Iterator[tuple]:
        return iter([(k[1:], v) for k, v in self.rows.iterator() if k[0] == self.run])

    def clear(self) -> None:
        for key, _ in self.iterator():
            self.removeKey(key)


class ReadRows(RunRows):
    """As ``RunRows``, with all rows of the bucket read once: for the end of runs."""

    def __init__(self, rows, run: str, known: dict[str, list]):
        super().__init__(rows, run)
        self.known = known

    def iterator(self) -> Iterator[tuple]:
        return iter(self.known.get(self.run, []))


class Held:
    """Texts of lines that wait, by line number: they are part of one value as long as there is ``room``,
    as every call to the state costs more than a short line; further ones are rows of a map."""

    def __init__(self, near: dict[str, str], far: int, further, room: Room):
        self.near, self.room, self.far, self.further = near, room, far, further

    def put(self, n: int, text: str) -> None:
        """A line that was there before is replaced."""
        key = str(n)
        is_far = self.far > 0 and key not in self.near and self.further.containsKey((n,))
        if key in self.near or (not is_far and self.room.chars + len(text) <= self.room.limit):
            self.room.chars += len(text)
            self.near[key] = text
        else:
            self.far += not is_far
            self.further.updateValue((n,), (text,))

    def pop(self, n: int) -> str | None:
        text = self.near.pop(str(n), None)
        if text is None and self.far and self.further.containsKey((n,)):
            text = self.further.getValue((n,))[0]
            self.further.removeKey((n,))
            self.far -= 1
        return text

    def clear(self) -> None:
        if self.far:
            self.further.clear()
        self.near, self.far = {}, 0

    def items(self) -> list[tuple[int, str]]:
        far = [(k[0], v[0]) for k, v in self.further.iterator()] if self.far else []
        return sorted([(int(n), text) for n, text in self.near.items()] + far)

    def state(self) -> tuple[str, int]:
        return json.dumps(self.near), self.far


def _read(rows, some: bool) -> dict[str, list]:
    """The rows of a bucket's map by run; nothing is read where there are none."""
    found: dict[str, list] = {}
    for key, value in rows.iterator() if some else ():
        found.setdefault(key[0], []).append((tuple(key[1:]), tuple(value)))
    return found


def _ahead(handle: StatefulProcessorHandle, timer: int, closes_at: int) -> int:
    """The run's one timer; it is not moved with every batch, but looked at again when it expires."""
    if not timer:
        handle.registerTimer(closes_at)
    return timer or closes_at


def _least_timer(handle: StatefulProcessorHandle, timer: int, closes_at: int) -> int:
    """A bucket's one timer, not later than the end of any of its runs."""
    if not timer or closes_at < timer:
        if timer:
            handle.deleteTimer(timer)
        handle.registerTimer(closes_at)
        return closes_at
    return timer


def _ended(closes_at: dict[str, int], timerValues, expired) -> list[str]:
    """The runs of a bucket that no line came to for long enough."""
    due, now = expired.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
    return [run for run, at in closes_at.items() if at <= due or at < now]


def _keep(handle: StatefulProcessorHandle, bucket, runs: dict, closes_at: list[int]) -> None:
    """What is left of a bucket after its timer."""
    if not runs:
        bucket.clear()
        return
    timer = min(closes_at)
    handle.registerTimer(timer)
    bucket.update((json.dumps(runs), timer))


def _dealt(run: Column, stamp: Column) -> list[Column]:
    """Columns by which runs are dealt to buckets and told apart in them."""
    bucket = F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")
    return [bucket.alias("bucket"), run.cast("string").alias("run"), stamp.alias("event_ts"), F.unix_micros(stamp).alias("event_us")]


def _name(run: str | None) -> str:
    return "" if _plain(run) is None else run


def _number(run: str) -> int | None:
    return int(run) if run else None


def _tap_rows(out: list[dict]) -> pd.DataFrame:
    whole = ("run_id", "event_us", "line_no", "planned", *COUNTERS, "parse_warning_count", "protocol_failures")
    return pd.DataFrame(out).astype({c: "Int64" for c in whole})


class TapRuns(StatefulProcessor):
    """Failing points as they come, ``limit`` of them at most (None: all), and the run's state at its end.

    One run is one key; ``TapBuckets`` takes many runs by the same rules.
    """

    def __init__(self, strict: bool, limit: int | None, idle_ms: int):
        self.strict, self.limit, self.idle_ms = strict, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState(
            "levels",
            "stack STRING, next_line BIGINT, sent BIGINT, closes_at BIGINT, timer BIGINT, early STRING, far BIGINT",
        )
        self.early = handle.getMapState("early", "line_no BIGINT", "row STRING")

    def _load(self) -> tuple[TapFold, Held, int, int, int, int]:
        stack, expected, sent, closes_at, timer, early, far = self.levels.get() or (None, 1, 0, 0, 0, "{}", 0)
        fold = TapFold([new_level(self.strict)] if stack is None else json.loads(stack), self.strict)
        return fold, Held(json.loads(early), far, self.early, Room(len(early), HELD_CHARS)), expected, sent, closes_at, timer

    def _save(self, fold: TapFold, held: Held, expected: int, sent: int, closes_at: int, timer: int) -> None:
        self.levels.update((json.dumps(fold.stack), expected, sent, closes_at, timer, *held.state()))

    def _take(self, fold: TapFold, run: int | None, line_no: int, row: tuple, sent: int, out: list[dict]) -> int:
        stamp, spaces, tab, kind, *rest = row
        named = KINDS[kind]
        label = fold.line(spaces, bool(tab), named, dict(zip(TOKEN_NAMES[3:], map(_plain, rest))) if named in TOLD_KINDS else {})
        if label is None or (self.limit is not None and sent >= self.limit):
            return sent
        out.append({"run_id": run, "event_us": stamp, "line_no": line_no, "label": label, "closed": False, **EMPTY_STATE})
        return sent + 1

    def _advance(self, fold: TapFold, run: int | None, held: Held, fresh: dict[int, tuple], expected: int, sent: int, out: list[dict]) -> tuple[int, int]:
        """Take the lines whose turn has come; the others wait."""
        while True:
            row, early = fresh.pop(expected, None), held.pop(expected)
            if row is None and early is not None:
                row = _unpacked(early)
            if row is None:
                break
            sent = self._take(fold, run, expected, row, sent, out)
            expected += 1
        for n, row in fresh.items():
            held.put(n, _packed(row))
        return expected, sent

    def _finish(self, fold: TapFold, run: int | None, held: Held, expected: int, sent: int, ended: int, out: list[dict]) -> None:
        """The run's last lines and its state."""
        for n, text in held.items():
            sent = self._take(fold, run, n, _unpacked(text), sent, out)
            expected = n + 1
        held.clear()
        out.append({"run_id": run, "event_us": ended * 1000, "line_no": expected - 1, "label": None, "closed": True, **fold.end()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, held, expected, sent, closes_at, timer = self._load()
        latest, fresh, out = closes_at - self.idle_ms, {}, []
        for batch in rows:
            latest = max(latest, _millis(batch["event_ts"]))
            stamps = [_micros(t) for t in batch["event_ts"]]
            columns = [batch[c].tolist() for c in TOKEN_NAMES]
            # a line that was there before is no second line
            fresh.update((int(n), tuple(row)) for n, *row in zip(batch["line_no"], stamps, *columns) if n >= expected)
        expected, sent = self._advance(fold, key[0], held, fresh, expected, sent, out)
        closes_at = latest + self.idle_ms
        timer = _ahead(self.handle, timer, closes_at)
        self._save(fold, held, expected, sent, closes_at, timer)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, held, expected, sent, closes_at, timer = self._load()
        if closes_at > timer and closes_at >= timerValues.getCurrentWatermarkInMs():
            # lines came since the timer was set
            self._save(fold, held, expected, sent, closes_at, _ahead(self.handle, 0, closes_at))
            return
        out: list[dict] = []
        self._finish(fold, key[0], held, expected, sent, closes_at - self.idle_ms, out)
        self.levels.clear()
        yield _tap_rows(out)

    def close(self) -> None:
        pass


class TapBuckets(TapRuns):
    """As ``TapRuns`` for all runs of a bucket: a key is a bucket, and its value holds every open run in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "runs STRING, timer BIGINT")
        self.early = handle.getMapState("early", "run STRING, line_no BIGINT", "row STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed, timer = self.bucket.get() or ("{}", 0)
        runs, room = json.loads(packed), Room(len(packed), BUCKET_CHARS)
        fresh: dict[str, dict[int, tuple]] = {}
        for batch in rows:
            names, numbers = batch["run"].tolist(), batch["line_no"].tolist()
            # times come as fractions where one of them is null
            stamps = [None if _plain(us) is None else int(us) for us in batch["event_us"].tolist()]
            for run, n, row in zip(names, numbers, zip(stamps, *(batch[c].tolist() for c in TOKEN_NAMES))):
                fresh.setdefault(_name(run), {}).setdefault(n, []).append(row)
        out: list[dict] = []
        for run, lines in fresh.items():
            stack, expected, sent, closes_at, near, far = runs.get(run) or ([new_level(self.strict)], 1, 0, 0, {}, 0)
            fold, held = TapFold(stack, self.strict), Held(near, far, RunRows(self.early, run), room)
            latest = max((row[0] or 0 for same in lines.values() for row in same), default=0) // 1000
            closes_at = max(closes_at, latest + self.idle_ms)
            # a line that was there before is no second line
            known = {int(n): same[-1] for n, same in lines.items() if n >= expected}
            expected, sent = self._advance(fold, _number(run), held, known, expected, sent, out)
            runs[run] = (fold.stack, expected, sent, closes_at, held.near, held.far)
        timer = _least_timer(self.handle, timer, min(runs[run][3] for run in fresh))
        self.bucket.update((json.dumps(runs), timer))
        if out:
            yield _tap_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packed, _ = self.bucket.get()
        runs, room = json.loads(packed), Room(len(packed), BUCKET_CHARS)
        over = _ended({run: state[3] for run, state in runs.items()}, timerValues, expiredTimerInfo)
        rows = _read(self.early, any(runs[run][5] for run in over))
        out: list[dict] = []
        for run in over:
            stack, expected, sent, closes_at, near, far = runs.pop(run)
            held = Held(near, far, ReadRows(self.early, run, rows), room)
            self._finish(TapFold(stack, self.strict), _number(run), held, expected, sent, closes_at - self.idle_ms, out)
        _keep(self.handle, self.bucket, runs, [state[3] for state in runs.values()])
        if out:
            yield _tap_rows(out)


def stream_tap_runs(
    lines: DataFrame, strict: bool = False, limit: int | None = None, delay: str = DELAY, idle_ms: int = IDLE_MS
) -> DataFrame:
    """Failing points of TAP runs in line order, and one row with ``closed`` and the state of each ended run.

    The session must keep streaming state in RocksDB; ``delay`` must cover how far lines of different
    runs are apart in time.
    """
    packed = lines.select(F.struct("run_id", "event_ts").alias("run_id"), "line_no", "line")
    wide = ("raw_id", "plan_start", "plan_end")
    tokens = tap_tokens(packed).select(
        *_dealt(F.col("run_id.run_id"), F.col("run_id.event_ts")), F.col("line_no").cast("bigint").alias("line_no"),
        *[F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in TOKEN_NAMES],
    )
    rows = (
        tokens.withWatermark("event_ts", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(
            TapBuckets(strict, limit, idle_ms), outputStructType=TAP_ROWS, outputMode="append", timeMode="eventTime"
        )
    )
    stamp = F.timestamp_micros("event_us").alias("event_ts")
    return rows.select("run_id", stamp, *[c for c in rows.columns if c not in ("run_id", "event_us")])


def stream_tap_close(lines: DataFrame, **options) -> DataFrame:
    """The state of each TAP run at its end."""
    return stream_tap_runs(lines, limit=0, **options).filter("closed").select("run_id", *STATE_COLUMNS)


DOC = "total BIGINT, passed BIGINT, failed BIGINT, skipped BIGINT, todo BIGINT"
OUTCOMES = ("passed", "failed", "skipped", "todo")
JSON_ROWS = (
    "run_id BIGINT, passed BIGINT, failed BIGINT, skipped BIGINT, todo BIGINT, noisy BOOLEAN, "
    "doc_total BIGINT, doc_passed BIGINT, doc_failed BIGINT, doc_skipped BIGINT, doc_todo BIGINT, document STRING, has_text BOOLEAN"
)
JSON_FACTS = ("line", "valid", "outcome", "kind", "doc")


class JsonRun:
    """Counts of a JSON run, whatever order its lines come in."""

    def __init__(self, counts=(0, 0, 0, 0), first_event=None, first_json=None, last_noise=None, closes_at=0, seen=(), docs=None, far_docs=0, text=None, far=0):
        self.counts, self.first_event, self.first_json, self.last_noise = list(counts), first_event, first_json, last_noise
        self.closes_at, self.seen = closes_at, Ids(list(seen))
        self.docs, self.far_docs, self.text, self.far = docs or {}, far_docs, text or {}, far

    def packed(self) -> tuple:
        return (
            self.counts, self.first_event, self.first_json, self.last_noise, self.closes_at, self.seen.ranges,
            self.docs, self.far_docs, self.text, self.far,
        )

    def line(self, n: int, valid: bool, outcome: str | None) -> None:
        if outcome in OUTCOMES:
            self.counts[OUTCOMES.index(outcome)] += 1
        if outcome is not None and (self.first_event is None or n < self.first_event):
            self.first_event = n
        if not valid:
            self.last_noise = n if self.last_noise is None else max(self.last_noise, n)
        elif self.first_json is None or n < self.first_json:
            self.first_json = n


class JsonRuns(StatefulProcessor):
    """Counts of a bucket's JSON runs and the documents that apply."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "runs STRING, timer BIGINT")
        self.docs = handle.getMapState("docs", "run STRING, line_no BIGINT", "doc STRING")
        self.open = handle.getMapState("open", "run STRING, line_no BIGINT", "line STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed, timer = self.bucket.get() or ("{}", 0)
        runs, room = json.loads(packed), Room(len(packed), BUCKET_CHARS)
        touched: dict[str, JsonRun] = {}
        texts: dict[str, dict[int, str]] = {}
        for batch in rows:
            columns = (batch[c].tolist() for c in ("run", "line_no", "event_us", *JSON_FACTS))
            for name, n, stamp, line, valid, outcome, kind, doc in zip(*columns):
                name, stamp = _name(name), _plain(stamp)
                run = touched.get(name)
                if run is None:
                    run = touched[name] = JsonRun(*runs.get(name, ()))
                if stamp is not None:
                    run.closes_at = max(run.closes_at, int(stamp) // 1000 + self.idle_ms)
                n = int(n)
                if run.seen.add(n):  # a line that was there before is no second line
                    continue
                run.line(n, bool(valid), _plain(outcome))
                if doc is not None:
                    docs = Held(run.docs, run.far_docs, RunRows(self.docs, name), room)
                    docs.put(n, json.dumps([kind == "jest", *json.loads(doc)]))
                    run.far_docs = docs.far
                if run.first_json is None:
                    texts.setdefault(name, {})[n] = line
        for name, run in touched.items():
            held = Held(run.text, run.far, RunRows(self.open, name), room)
            if run.first_json is None:
                for n, line in texts.get(name, {}).items():
                    held.put(n, line)
            else:
                held.clear()  # a line was a value, so the text is no document
            run.text, run.far = held.near, held.far
            runs[name] = run.packed()
        timer = _least_timer(self.handle, timer, min(run.closes_at for run in touched.values()))
        self.bucket.update((json.dumps(runs), timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packed, _ = self.bucket.get()
        runs, room = {name: JsonRun(*run) for name, run in json.loads(packed).items()}, Room(len(packed), BUCKET_CHARS)
        over = _ended({name: run.closes_at for name, run in runs.items()}, timerValues, expiredTimerInfo)
        far_docs = _read(self.docs, any(runs[name].far_docs for name in over))
        far_lines = _read(self.open, any(runs[name].far for name in over))
        out, chars = [], 0
        for name in over:
            run = runs.pop(name)
            kept = Held(run.docs, run.far_docs, ReadRows(self.docs, name, far_docs), room)
            docs = [(n, json.loads(doc)) for n, doc in kept.items()]
            applied = [d for n, d in docs if run.first_event is None or n < run.first_event]
            stated = applied[-1][1:5] if applied else (0, 0, 0, 0)
            jest = [d[5] for d in applied if d[0]]
            held = Held(run.text, run.far, ReadRows(self.open, name, far_lines), room)
            lines = [line for _, line in held.items()]
            kept.clear()
            held.clear()
            valued = run.first_json is not None
            noisy = valued and run.last_noise is not None and run.last_noise > run.first_json
            document = None if valued else "\n".join(lines)
            out.append((_number(name), *run.counts, noisy, *stated, jest[-1] if jest else 0, document, valued or bool(lines)))
            chars += len(document or "")
            if chars >= OUT_CHARS:
                yield _json_rows(out)
                out, chars = [], 0
        _keep(self.handle, self.bucket, {name: run.packed() for name, run in runs.items()}, [run.closes_at for run in runs.values()])
        if out:
            yield _json_rows(out)

    def close(self) -> None:
        pass


def _json_rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in JSON_ROWS.split(", ")]).astype({"run_id": "Int64"})


def stream_json_close(lines: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """The state of each JSON run at its end: events, summary documents and pretty-printed documents."""
    lines = lines.withWatermark("event_ts", delay)
    text = lines.select("run_id", "event_ts", F.col("line_no").cast("bigint").alias("line_no"), "line", utrim(F.col("line")).alias("text"))
    values = text.filter("text != ''").select(
        "run_id", "event_ts", "line_no", "line", F.explode(F.array(json_value(F.col("text")))).alias("v")
    )
    facts = value_facts(values.withColumn("valid", F.col("v").isNotNull()))
    rows = facts.select(
        *_dealt(F.col("run_id"), F.col("event_ts")), "line_no", "line", "valid", "outcome", "kind",
        F.when(F.col("kind").isNotNull(), F.to_json(F.array(*[f"doc_{c}" for c in STATED]))).alias("doc"),
    )
    closed = rows.groupBy("bucket").transformWithStateInPandas(
        JsonRuns(idle_ms), outputStructType=JSON_ROWS, outputMode="append", timeMode="eventTime"
    )
    # a run without any JSON line may be one document
    whole = json_value(utrim(F.coalesce("document", F.lit(""))))
    read = closed.select(
        F.struct(*closed.columns).alias("run"), F.explode(F.array(whole)).alias("v")
    ).withColumn("readable", F.col("v").isNotNull())
    facts = value_facts(read)
    run, zero = F.col("run"), F.lit(0).cast("bigint")
    event = {c: run[c] + F.when(F.col("outcome") == c, 1).otherwise(zero) for c in OUTCOMES}
    base = {c: F.coalesce(f"doc_{c}", run[f"doc_{c}"]) for c in STATED}
    unreadable = run["document"].isNotNull() & run["has_text"] & ~F.col("readable")
    return facts.select(
        run["run_id"].alias("run_id"),
        F.lit(None).cast("bigint").alias("planned"),
        (base["total"] + event["passed"] + event["failed"] + event["skipped"] + event["todo"]).alias("total"),
        *[(base[c] + event[c]).alias(c) for c in COUNTERS[1:]],
        F.lit(None).cast("string").alias("bailout_reason"),
        (run["noisy"] | unreadable).cast("int").cast("bigint").alias("parse_warning_count"),
        zero.alias("protocol_failures"),
    )


class FailurePolicy(StatefulProcessor):
    """Deduplication and limit of a run's failures, in the order they come; the first ``remembered`` keys of a
    run are known as repeats, until the run ends."""

    def __init__(self, columns: list[str], dedup: bool, limit: int | None, remembered: int, idle_ms: int):
        self.columns, self.dedup, self.limit = columns, dedup, limit
        self.remembered, self.idle_ms = remembered, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "known BIGINT, sent BIGINT, closes_at BIGINT")
        self.keys = handle.getMapState("keys", "key STRING", "seen BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, sent, closes_at = self.counts.get() if self.counts.exists() else (0, 0, 0)
        latest, parts = closes_at - self.idle_ms, []
        # the remembered keys are few: they are read once, not asked for row by row
        seen = {k[0] for k in self.keys.keys()} if self.dedup and known else set()
        for part in rows:
            latest = max(latest, _millis(part["event_ts"]))
            parts.append(part[~part["key"].isin(seen)] if seen else part)
        batch = pd.concat(parts).sort_values(["line_no", "item_no"], kind="stable")
        if self.dedup and len(batch):
            repeated = batch["key"].duplicated()
            learned = batch["key"][~repeated].iloc[: self.remembered - known]
            for name in learned:
                self.keys.updateValue((name,), (True,))
            known += len(learned)
            batch = batch[~(repeated & batch["key"].isin(learned))]
        if self.limit is not None:
            batch = batch.iloc[: max(self.limit - sent, 0)]
        sent += len(batch)
        if closes_at:
            self.handle.deleteTimer(closes_at)
        closes_at = latest + self.idle_ms
        self.handle.registerTimer(closes_at)
        self.counts.update((known, sent, closes_at))
        if len(batch):
            yield batch[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keys.clear()
        self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_policy(
    failures: DataFrame,
    dedup: bool = True,
    limit: int | None = None,
    remembered: int = REMEMBERED,
    delay: str = DELAY,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Failures of a stream as a run's policy lets them through, by the rules of the batch operators.

    ``failures`` comes in the order of its runs, as ``stream_failures`` gives it; what a run has sent is forgotten
    when it ends.
    """
    return (
        failures.withColumn("key", dedup_key())
        .withWatermark("event_ts", delay)
        .groupBy("run_id")
        .transformWithStateInPandas(
            FailurePolicy(failures.columns, dedup, limit, remembered, idle_ms),
            outputStructType=failures.schema,
            outputMode="append",
            timeMode="eventTime",
        )
    )
