"""Line dedup by a log-template tree.

Every line goes down a tree of fixed depth: its number of tokens, then its first
``LEADING`` tokens, variable ones (with a digit, an address or a link) as a wildcard.
Below that node a line of ``GENERAL`` tokens or more belongs to three templates, each
with one third of the remaining tokens as a variable field; a shorter line has one
template, with only its variable tokens left open.  Templates need no order of arrival,
so the tree is built by one aggregation.

A template found in ``MIN_DOCS`` documents or more recurs, whatever its length.  Its lines are
dropped from all documents but the first (least id), except in documents of which recurring
lines make ``COPY_SHARE`` of the characters: that is the similarity from which documents are
near duplicates, and a step for whole documents decides on these.

Defined results: a null text stays null and has no lines; blank lines are never
dropped; rows of equal id and text are counted as documents and treated alike; rows
without an id are never the first; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.llm import prefilter
from testlog.llm.names import unused
from testlog.operators.durable import store

LEADING = 2
GENERAL = 8
FIELDS = 3
MIN_DOCS = 3
COPY_SHARE = 0.8
SLICE_ROWS = 256

VARIABLE = re.compile(r"[0-9@]|://")
_SALT = np.random.default_rng(71).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def line_templates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every non-blank line: its text's index, its number, its characters, its FIELDS keys.

    Keys of a line with one template are all equal.
    """
    tokens: list[str] = []
    owner, number, chars, sizes = [], [], [], []
    for k, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            words = line.split()
            if not words:
                continue
            if VARIABLE.search(line):
                words = ["\0" if VARIABLE.search(w) else w for w in words]
            tokens.extend(words)
            owner.append(k)
            number.append(i)
            chars.append(len(line))
            sizes.append(len(words))
    count = len(sizes)
    if not count:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, FIELDS), np.int64)
    size = np.array(sizes, np.int64)
    heads = np.cumsum(size) - size
    place = (np.arange(len(tokens)) - np.repeat(heads, size)).astype(np.uint64)
    hashed = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(_mix(hashed + place * _SALT[0]), out=sums[1:])
        total = sums[heads + size] - sums[heads]
        leaf = size.astype(np.uint64) * _SALT[1]
        keys = np.empty((count, FIELDS), np.uint64)
        long = size >= GENERAL
        rest = np.maximum(size - LEADING, 0)
        for field in range(FIELDS):
            low = heads + np.minimum(LEADING, size) + rest * field // FIELDS
            high = heads + np.minimum(LEADING, size) + rest * (field + 1) // FIELDS
            open_part = sums[high] - sums[low]
            keys[:, field] = _mix(total - open_part + leaf + np.uint64(field + 1) * _SALT[2])
        keys[~long] = _mix(total[~long] + leaf[~long])[:, None]
    return np.array(owner), np.array(number), np.array(chars, np.int64), keys.view(np.int64)


def _body(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(id_col).cast("long"), F.col("text").cast("string")).alias("row_key"),
        F.col("text").cast("string").alias("text"),
    )


def recurring_templates(docs: DataFrame, id_col: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """(template, n_docs, first_id) of the templates of ``min_docs`` documents or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                owner, _, _, keys = line_templates(part.column("text").to_pylist())
                flat, whose = keys.reshape(-1), np.repeat(owner, FIELDS)
                # a template counts once per document
                order = np.lexsort((flat, whose))
                flat, whose = flat[order], whose[order]
                new = np.ones(len(flat), bool)
                new[1:] = (flat[1:] != flat[:-1]) | (whose[1:] != whose[:-1])
                ids = part.column("id").take(pa.array(whose[new]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(flat[new])], names=["id", "template"])

    # minima and counts of numbers combine before the shuffle, so a common line is cheap
    return (
        _body(docs, id_col).select("id", "text").mapInArrow(run, "id long, template long")
        .groupBy("template")
        .agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"))
        .filter(F.col("n_docs") >= min_docs)
    )


def marked_lines(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(row_key, lines, lost_lines, recurring_chars) of documents with recurring lines.

    ``lines`` are the numbers of all recurring lines, ``lost_lines`` of those that are
    not the first of their template.
    """
    table = docs.sparkSession.sparkContext.broadcast(
        prefilter.bit_table(templates.select(F.pmod("template", F.lit(prefilter.BITS)).alias("slot")))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                owner, number, chars, keys = line_templates(part.column("text").to_pylist())
                once = np.ones(keys.shape, bool)
                once[:, 1:] = keys[:, 1:] != keys[:, :1]
                once &= prefilter.in_table(table.value, keys & (prefilter.BITS - 1))
                row, field = np.nonzero(once)
                whose = pa.array(owner[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(whose),
                        part.column("row_key").take(whose),
                        pa.array(number[row], pa.int64()),
                        pa.array(chars[row], pa.int64()),
                        pa.array(keys[row, field], pa.int64()),
                    ],
                    names=["id", "row_key", "line", "chars", "template"],
                )

    lines = _body(docs, id_col).mapInArrow(run, "id long, row_key long, line long, chars long, template long")
    hits = lines.join(templates.select("template", "first_id"), "template")
    is_first = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False))
    per_line = hits.groupBy("row_key", "line").agg(
        F.max("chars").alias("chars"), F.min(is_first.cast("int")).alias("kept")
    )
    return per_line.groupBy("row_key").agg(
        F.sort_array(F.collect_list("line")).alias("lines"),
        F.sort_array(F.collect_list(F.when(F.col("kept") == 0, F.col("line")))).alias("lost_lines"),
        F.sum("chars").alias("recurring_chars"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with ``text`` rewritten and n_lines, n_recurring, n_dropped, is_copy added."""
    added = ("n_lines", "n_recurring", "n_dropped", "is_copy")
    base = docs.select(*[c for c in docs.columns if c not in added])
    templates = store(recurring_templates(docs, id_col, min_docs))
    marks = store(marked_lines(docs, templates, id_col))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col("text").cast("string"))
    row, all_lines, lost_lines, in_lines = (unused(base.columns, n) for n in ("__row", "__lines", "__lost", "__chars"))
    joined = (
        base.withColumn(row, key)
        .join(marks.select(F.col("row_key").alias(row), F.col("lines").alias(all_lines),
                           F.col("lost_lines").alias(lost_lines), F.col("recurring_chars").alias(in_lines)),
              row, "left")
        .drop(row)
    )
    names = base.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, found, dropped, copies = [], [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", all_lines, lost_lines, in_lines)))
            for text, lines, lost, chars in rows:
                parts = (text or "").split("\n")
                copy = bool(lines) and chars >= COPY_SHARE * sum(map(len, parts))
                gone = set(lost or ()) if not copy else set()
                if gone:
                    text = "\n".join([p for i, p in enumerate(parts) if i not in gone])
                texts.append(text)
                totals.append(sum(1 for p in parts if p.strip()))
                found.append(len(lines or ()))
                dropped.append(len(gone))
                copies.append(copy)
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(found, pa.int64()),
                 pa.array(dropped, pa.int64()), pa.array(copies, pa.bool_())],
                names=[*names, *added],
            )

    schema = ", ".join(
        [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in base.schema.fields]
        + ["n_lines long", "n_recurring long", "n_dropped long", "is_copy boolean"]
    )
    return joined.mapInArrow(run, schema)
