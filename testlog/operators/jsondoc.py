r"""Summary documents of any size, read line by line.

A JSON string holds no line end, so every line falls into tokens by itself: strings, brackets,
commas and the text between.  The bracket depth before a block of lines is a running sum over blocks.  The
document is cut at its brackets and commas down to depth 2, that is around the members of the
top object, the members of an object in it, and the elements of a list in it; what
lies between two cuts is a *segment* and is put together by its number, a running
count of cuts.  The largest text in one place is thus one entry of ``testResults``, never
the document.

The document is valid when every segment is, given the cuts before and behind it and the kind
of bracket it stands in: a value or ``"key": value`` where one belongs, nothing where none does.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from testlog.functions.jsonvalue import json_value
from testlog.functions.text import utrim
from testlog.operators.durable import BLOCK_LINES, materialize

DEPTH = 2  # depth down to which a document is cut
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NO_BRACKET = rf'(?s){_STRING}|[^"\[\]{{}}]++|"'
SPACES = " \t\n\r"
BATCH_ROWS, BATCH_CHARS = 4096, 8 * 1024 * 1024  # of segments that are handed on at once

# The members that events and summaries are read from.
OBJECTS = ("stats", "event")
MEMBERS = (
    "numTotalTests", "numPassedTests", "numFailedTests", "numPendingTests", "numTodoTests",
    "Action", "Test", "Package", "Output", "type", "name", "test", "binary_id", "package", "test_binary",
    "message", "error", *OBJECTS,
)
LISTING = "testResults"


@dataclass
class ScannedDocuments:
    """``values(run_id, v)``: each valid document without its large parts; ``entries(run_id, place, v)``:
    the elements of its listing, in order of ``place``."""

    values: DataFrame
    entries: DataFrame


def _opens(char: Column) -> Column:
    return char.isin("{", "[")


def _closes(char: Column) -> Column:
    return char.isin("}", "]")


def _blocked(lines: DataFrame) -> DataFrame:
    rows = lines.filter(F.col("line").isNotNull())
    return rows.select("run_id", F.expr(f"(line_no - 1) div {BLOCK_LINES}").alias("block"), "line_no", "line")


def _starting_depths(rows: DataFrame) -> DataFrame:
    """(run_id, block, start): the bracket depth before each block of lines."""
    brackets = F.regexp_replace("line", NO_BRACKET, "")
    opens, closes = (F.char_length(F.translate("brackets", other, "")) for other in ("]}", "[{"))
    steps = rows.select("run_id", "block", brackets.alias("brackets")).select("run_id", "block", (opens - closes).alias("step"))
    before = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = steps.groupBy("run_id", "block").agg(F.sum("step").alias("step"))
    return whole.select("run_id", "block", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("start"))


@cache
def _to_token(end: str) -> re.Pattern:
    """Text up to a bracket or comma outside strings, or up to the end; no string goes past ``end``."""
    end = re.escape(end)
    string = rf'"[^"\\{end}]*+(?:\\[^{end}][^"\\{end}]*+)*+"'
    return re.compile(rf'(?s)(?:{string}|[^"\[\]{{}},]++|")*+(?:[\[\]{{}},]|(\Z))')


class _Block:
    """Cuts one block of lines; what it holds between calls is the segment that is still open."""

    def __init__(self, run, block, depth: int):
        self.run, self.block, self.depth = run, block, depth
        self.at, self.begin, self.begun, self.opened, self.kind = 0, None, None, None, None
        self.parts: list[str] = []

    def segment(self, end: str | None) -> tuple:
        text = "\n".join(self.parts)
        return (self.run, self.block, self.at, text, self.begin, self.begun, end, self.opened, self.kind)

    def feed(self, lines: list[str]) -> Iterator[tuple]:
        """Segments that end in these lines."""
        text, end = "\n".join(lines), "\n"
        if text.count("\n") >= len(lines):  # a line holds a line feed itself: lines end by another character
            end = next(c for c in map(chr, range(sys.maxunicode)) if c not in text and c not in "\\\"[]{},")
            text = end.join(lines)
        depth, begin = self.depth, 0
        for found in _to_token(end).finditer(text):
            if found[1] is not None:
                break
            place = found.end() - 1
            token = text[place]
            if token == ",":
                if depth > DEPTH:
                    continue
            elif token in "{[":
                depth += 1
                if depth > DEPTH:
                    continue
            else:
                depth -= 1
                if depth >= DEPTH:
                    continue
            self.parts.append(text[begin:place].replace(end, "\n"))
            yield self.segment(token)
            begin = place + 1
            self.at, self.begin, self.begun, self.parts = self.at + 1, token, depth, []
            if depth == DEPTH and token != ",":
                self.opened, self.kind = self.at, token
        self.depth = depth
        self.parts.append(text[begin:].replace(end, "\n"))


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of segments from lines in order, block by block; a block may go over several batches."""
    rows: list[tuple] = []
    size = 0
    block = None

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for given in batches:
        runs, blocks, starts, lines = (given.column(n).to_pylist() for n in ("run_id", "block", "start", "line"))
        first = 0
        while first < len(lines):
            if lines[first] is None:
                if block is not None:
                    rows.append(block.segment(None))
                block = _Block(runs[first], blocks[first], starts[first])
                first += 1
                continue
            last = first + 1
            while last < len(lines) and lines[last] is not None:
                last += 1
            for row in block.feed(lines[first:last]):
                rows.append(row)
                size += len(row[3])
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield batch()
                    rows, size = [], 0
            first = last
    if block is not None:
        rows.append(block.segment(None))
    if rows:
        yield batch()


def _segments(lines: DataFrame) -> DataFrame:
    """(run_id, place, text, begin, depth, end, parent, kind, head): the text between two cuts and the cuts around
    it; of segments at the depth ``DEPTH`` the place and the bracket that opened it; the first cut of the run.

    Blocks of lines are cut one by one from the depth that is reached before them.  Places, brackets that are open
    at the start of a block and segments that go past its end are settled between blocks.
    """
    rows = _blocked(lines)
    run = StructType([lines.schema["run_id"]])
    kind = StructType.fromDDL(
        "block bigint, at bigint, text string, begin string, depth bigint, end string, opened bigint, kind string"
    )
    schema = StructType(run.fields + kind.fields)
    arrow = to_arrow_schema(schema)
    # each block opens with a row that holds its depth, which has no line
    ordered = rows.unionByName(_starting_depths(rows), allowMissingColumns=True).repartition("run_id", "block")
    ordered = ordered.sortWithinPartitions("run_id", "block", F.asc_nulls_first("line_no"))
    ordered = ordered.select("run_id", "block", "start", "line")
    pieces = materialize(ordered.mapInArrow(lambda batches: _cut(batches, arrow), schema))

    over = W.partitionBy("run_id").orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy("run_id", "block").agg(
        F.max("at").alias("cuts"),
        F.max(F.struct("opened", "kind")).alias("top"),
        F.max(F.when(F.col("at") == 1, F.col("begin"))).alias("first_cut"),
    )
    blocks = blocks.withColumn("before", F.coalesce(F.sum("cuts").over(before), F.lit(0)))
    top = F.when(F.col("top.opened").isNotNull(), F.struct((F.col("before") + F.col("top.opened")).alias("parent"), "top.kind"))
    blocks = blocks.withColumn("top", F.last(top, ignorenulls=True).over(before)).withColumn(
        "head", F.first("first_cut", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    placed = pieces.join(blocks.drop("first_cut"), ["run_id", "block"])
    placed = placed.withColumns({
        "place": F.col("before") + F.col("at"),
        "parent": F.coalesce(F.col("before") + F.col("opened"), "top.parent"),
        "kind": F.coalesce("kind", "top.kind"),
    })
    columns = ("run_id", "place", "text", "begin", "depth", "end", "parent", "kind", "head")
    inner = (F.col("at") > 0) & (F.col("at") < F.col("cuts"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    # begin and end of a segment stand in its first and last piece; what was open before it in its first
    known = F.struct("parent", "kind", "head")
    crossing = (
        placed.filter(~inner)
        .groupBy("run_id", "place")
        .agg(
            F.array_join(texts, "\n").alias("text"),
            *[F.max(c).alias(c) for c in ("begin", "depth", "end")],
            F.min_by(known, "block").alias("known"),
        )
        .select("run_id", "place", "text", "begin", "depth", "end", "known.parent", "known.kind", "known.head")
    )
    return placed.filter(inner).select(*columns).unionByName(crossing.select(*columns))


def _member(text: Column) -> Column:
    return F.concat(F.lit("{"), text, F.lit("}"))


def _judged(segments: DataFrame) -> DataFrame:
    """Segments in their brackets, with ``ok``: does the text fit between its two cuts?  Elements of lists come as
    values ``v``, other segments as texts."""
    depth = F.coalesce("depth", F.lit(0))
    trimmed = F.when(depth < 1, utrim(F.col("text"))).otherwise(F.trim("text", F.lit(SPACES)))
    kind = F.when(F.col("depth") == 1, F.col("head")).when(F.col("depth") == DEPTH, F.col("kind"))
    rows = segments.withColumns({"text": trimmed, "kind": kind})
    text, begin, end = F.col("text"), F.col("begin"), F.col("end")
    empty, in_list = text == "", F.col("kind") == "["
    # null stands for the value that begins with a bracket: {"key":null} is valid, {"key":1null} is not
    tried = (
        F.when(in_list, text)
        .when(_opens(end), F.concat(F.lit("{"), text, F.lit("null}")))
        .otherwise(_member(text))
    )
    # the generator keeps the parse from being evaluated wherever its value is named
    rows = rows.withColumn("tried", F.when((depth >= 1) & ~empty, tried))
    rows = rows.withColumn("v", F.explode(F.array(F.when(F.col("tried").isNotNull(), json_value(F.col("tried")))))).drop("tried")
    follows = _opens(begin) | (begin == ",")  # a value or member is due
    closed = F.when(in_list, end == "]").otherwise(end == "}") | (end == ",")
    bare = F.when(_opens(end), in_list & follows).otherwise(closed & (_closes(begin) | (_opens(begin) & (end != ","))))
    filled = follows & F.col("v").isNotNull() & F.when(_opens(end), ~in_list).otherwise(closed)
    outside = empty & F.when(F.col("place") == 0, _opens(end)).otherwise((depth == 0) & end.isNull())
    ok = F.when(depth < 1, outside).otherwise(F.col("kind").isNotNull() & F.when(empty, bare).otherwise(filled))
    listed = F.coalesce(in_list, F.lit(False))
    return rows.select(
        "run_id",
        "place",
        F.when(~listed, text).alias("text"),
        "depth",
        "end",
        "parent",
        "kind",
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(listed, F.col("v")).alias("v"),
    )


def _key(member: Column) -> Column:
    return F.get(F.json_object_keys(member), F.lit(0))


def scan_documents(lines: DataFrame) -> ScannedDocuments:
    """Read the document that each run's lines (run_id, line_no, line) make up."""
    judged = materialize(_judged(_segments(lines)))
    valid = materialize(judged.groupBy("run_id").agg(F.bool_and("ok").alias("ok")).filter("ok").select("run_id"))
    full = (F.col("text") != "") & ~_opens(F.col("end"))
    # members of the top object: scalars, and the openings of lists and objects
    top = judged.filter((F.col("depth") == 1) & (F.col("kind") == "{") & (F.col("text") != ""))
    top = top.join(valid, "run_id", "left_semi")
    whole = F.when(full, _member(F.col("text"))).otherwise(F.concat(F.lit("{"), "text", F.lit("null}")))
    top = materialize(
        top.withColumn("key", _key(whole))
        .filter(F.col("key").isin(*MEMBERS, LISTING))
        .select("run_id", "place", "key", "text", "end", full.alias("full"))
    )
    inside = (
        judged.filter((F.col("depth") == DEPTH) & (F.col("kind") == "{") & full)
        .join(
            top.filter(F.col("key").isin(*OBJECTS)).select("run_id", (F.col("place") + 1).alias("parent")),
            ["run_id", "parent"],
            "left_semi",
        )
        .groupBy("run_id", "parent")
        .agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("members"))
        .select(
            "run_id",
            (F.col("parent") - 1).alias("place"),
            F.array_join(F.transform("members", lambda m: m["text"]), ",").alias("members"),
        )
    )
    shown = top.filter(F.col("key") != LISTING).join(inside, ["run_id", "place"], "left")
    member = (
        F.when(F.col("full"), F.col("text"))
        .when(F.col("end") == "[", F.concat("text", F.lit("[]")))
        .otherwise(F.concat(F.col("text"), F.lit("{"), F.coalesce("members", F.lit("")), F.lit("}")))
    )
    slim = shown.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", member.alias("member")))).alias("members"))
    joined = F.array_join(F.transform("members", lambda m: m["member"]), ",")
    values = valid.join(slim, "run_id", "left").select(
        "run_id", F.explode(F.array(json_value(_member(F.coalesce(joined, F.lit("")))))).alias("v")
    )
    listing = top.filter(F.col("key") == LISTING).groupBy("run_id").agg(F.max_by(F.struct("place", "end"), "place").alias("at"))
    listing = listing.filter("at.end = '['").select("run_id", (F.col("at.place") + 1).alias("parent"))
    entries = (
        judged.filter((F.col("depth") == DEPTH) & F.col("v").isNotNull())
        .join(listing, ["run_id", "parent"], "left_semi")
        .select("run_id", "place", "v")
    )
    return ScannedDocuments(values, entries)
