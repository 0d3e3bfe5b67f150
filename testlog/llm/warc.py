"""WARC archives: writing records of pages and reading them back in parallel.

Writing.  Every page is one record; of the records with equal payloads of at least
``LEAST_REVISIT`` bytes the one with the least page id is the response, the others
revisit it.  Spark's text writer makes the files, so any store Spark can write to
will do.

Reading.  Files are read in splits, cut at the magic line that opens a record.  A
payload may hold that line as well, so each occurrence is only a candidate: it names a
successor, the offset where its record ends by its own Content-Length.  Each task follows
these links inside its split and reports for every candidate where its chain leaves the
split.  Pointer jumping over these exits, from the start of each file, finds where the
true chain enters each split; a second pass over the splits then follows the chain from
there and returns the records.  A record that runs over the end of a split is put
together from its pieces.

The driver gets one entry offset per split, as it has one file status per split.

Defined results: a null html is an empty payload; a null page id is written and read as
null; line breaks in a URL become spaces; rows with equal page ids are records of their
own; an empty table gives empty archives; where a chain ends at a place that is neither a
candidate nor the end of the file (a damaged file), the records before it are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.operators.durable import any_row, store

# The format's magic line, ends and header names.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """(record) text of every page without its closing line ends."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    copies = store(
        body.filter(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("digest", "first_id")
    )
    joined = body.join(copies, "digest", "left")
    revisits = F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisits, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: " + DATE),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            revisits,
            F.concat(
                F.lit("\r\nWARC-Refers-To: <urn:page:"),
                F.col("first_id").cast("string"),
                F.lit(">\r\nWARC-Profile: " + PROFILE),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    return joined.withColumn("block", block).select(F.concat(header, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", END).text(path)


def _fields(row: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and where the block starts; None if this is no record header."""
    stop = row.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in row[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, stop + 4


class _Splits:
    """Walks over batches of rows in file order: (path, split, offset of the row, row, starts a candidate).

    Offsets are relative to the first row of the split.
    """

    def __init__(self, batches: Iterable[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[str, int, int, bytes, bool]]:
        current, at = None, 0
        for batch in self.batches:
            columns = (batch.column(c) for c in ("path", "split", "row"))
            for path, split, row in zip(*(c.to_pylist() for c in columns)):
                first = (path, split) != current
                if first:
                    current, at = (path, split), 0
                # only the text before a file's first magic line has none in front
                yield path, split, at, row, not (first and split == 0)
                at += len(row) + len(MAGIC)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("value").cast("binary").alias("row"),
        )
    )


def split_chains(rows: DataFrame) -> DataFrame:
    """One row per split: path, split, file_size, length, and candidates (at, exit)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}

        def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes.update(zip(batch.column("path").to_pylist(), batch.column("file_size").to_pylist()))
                yield batch

        def finish(path: str, split: int, length: int, found: list[tuple[int, int]]) -> pa.RecordBatch:
            exits: dict[int, int] = {}
            for at, successor in reversed(found):
                exits[at] = exits.get(successor, successor)
            chains = [{"at": at, "exit": exits[at]} for at, _ in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([path]),
                    pa.array([split], pa.int64()),
                    pa.array([sizes[path]], pa.int64()),
                    pa.array([length], pa.int64()),
                    pa.array([chains], pa.list_(pa.struct([("at", pa.int64()), ("exit", pa.int64())]))),
                ],
                names=["path", "split", "file_size", "length", "chains"],
            )

        current, length, found = None, 0, []
        for path, split, at, row, candidate in _Splits(told(batches)):
            if (path, split) != current:
                if current:
                    yield finish(*current, length, found)
                current, found = (path, split), []
            length = at + len(row) + len(MAGIC)
            if candidate and (parsed := _fields(row)):
                fields, start = parsed
                successor = at + start + int(fields["content-length"]) + len(END)
                found.append((at - len(MAGIC), successor))
        if current:
            yield finish(*current, length, found)

    return rows.mapInArrow(
        run, "path string, split long, file_size long, length long, chains array<struct<at:long,exit:long>>"
    )


def entries(splits: DataFrame) -> DataFrame:
    """(path, split, entry): the first record of the true chain in each split that has one."""
    before = "PARTITION BY path ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # paths are long and repeat; a hash of the path stands for the file
    based = store(
        splits.withColumn("base", F.expr(f"coalesce(sum(length) OVER ({before}), 0L)")).withColumn(
            "file", F.xxhash64("path")
        )
    )
    nodes = store(
        based.select("file", "base", "split", F.explode("chains").alias("c")).select(
            "file", "split", (F.col("base") + F.col("c.at")).alias("node"),
            (F.col("base") + F.col("c.exit")).alias("next"),
        )
    )
    jumps = nodes.select("file", "node", "next")
    # the chain starts at the first record, which stands at the start of the file
    reached = nodes.filter("node = 0").select("file", "node")
    while True:
        hop = reached.join(jumps, ["file", "node"]).select("file", F.col("next").alias("node"))
        new = store(
            hop.join(nodes.select("file", "node"), ["file", "node"], "left_semi")
            .distinct()
            .join(reached, ["file", "node"], "left_anti")
        )
        if not any_row(new):
            break
        reached = store(reached.unionByName(new))
        further = jumps.select("file", F.col("node").alias("next"), F.col("next").alias("beyond"))
        jumps = store(
            jumps.join(further, ["file", "next"], "left").select(
                "file", "node", F.coalesce("beyond", "next").alias("next")
            )
        )
    found = reached.join(nodes, ["file", "node"]).groupBy("file", "split").agg(F.min("node").alias("node"))
    return found.join(based.select("file", "split", "path", "base"), ["file", "split"]).select(
        "path", "split", "base", (F.col("node") - F.col("base")).alias("entry")
    )


SCHEMA = (
    "kind string, path string, split long, at long, until long, "
    "headers map<string,string>, block binary"
)


def _follow(rows: DataFrame, starts: dict[tuple[str, int], int]) -> DataFrame:
    """Records of each split from its entry on; heads of records that run on; pieces before the entry."""
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        magic = MAGIC.encode()

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out))
            out, size = [], 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
                    pa.array(columns[5], pa.map_(pa.string(), pa.string())), pa.array(columns[6], pa.binary()),
                ],
                names=["kind", "path", "split", "at", "until", "headers", "block"],
            )

        current, expected, open_record, pieces = None, None, None, []

        def close_split() -> None:
            nonlocal size
            if open_record:
                path, split, at, until, fields, block = open_record
                out.append(("head", path, split, at, until, fields, bytes(block)))
            if pieces:
                out.append(("piece", *current, 0, None, None, b"".join(pieces)))
            size += 1

        for path, split, at, row, candidate in _Splits(batches):
            if (path, split) != current:
                if current:
                    close_split()
                current, open_record, pieces = (path, split), None, []
                expected = shared.value.get(current)
            if open_record is None and (expected is None or at - len(magic) < expected):
                # before the entry: the rest of a record of an earlier split
                pieces.append((magic if candidate else b"") + row)
                continue
            if open_record is None and candidate and at - len(magic) == expected:
                fields, start = _fields(row)
                until = at + start + int(fields["content-length"])
                block = bytearray(row[start : start + int(fields["content-length"])])
                open_record = (path, split, at, until, fields, block)
                expected = until + len(END)
            elif open_record is not None:
                until, block = open_record[3], open_record[5]
                wanted = until - open_record[2]
                more = magic + row
                room = until - (at - len(magic))
                block += more[: max(0, room)]
            if open_record is not None and at + len(row) >= open_record[3]:
                _, _, begun, until, fields, block = open_record
                out.append(("record", path, split, begun, until, fields, bytes(block)))
                size += len(block)
                open_record = None
            if size > 1 << 22:
                yield flush()
        if current:
            close_split()
        if out:
            yield flush()

    return rows.drop("file_size").mapInArrow(run, SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(headers, http_headers, payload) of every record on the true chains."""
    rows = _rows(spark, path)
    splits = store(split_chains(rows))
    found = store(entries(splits))
    starts = {(r.path, r.split): r.entry for r in found.collect()}
    walked = _follow(rows, starts)
    whole = walked.filter("kind = 'record'").select("headers", "block")
    every = splits.select("path", "split").join(found.select("path", "split", "entry"), ["path", "split"], "left")
    # a chain that enters a later split behind its first magic line has crossed the border
    crossing = every.filter((F.col("split") > 0) & (F.col("entry").isNull() | (F.col("entry") != -len(MAGIC))))
    if any_row(crossing):
        whole = whole.unionByName(_joined(store(walked.filter("kind <> 'record'")), splits))
    # the block holds the HTTP headers, an empty line, and the payload
    head = F.expr("instr(decode(substring(block, 1, 65536), 'ISO-8859-1'), '\r\n\r\n')")
    return whole.select("headers", "block", head.alias("cut")).select(
        "headers",
        F.expr("decode(substring(block, 1, greatest(cut - 1, 0)), 'ISO-8859-1')").alias("http_headers"),
        F.expr("substring(block, IF(cut = 0, 1, cut + 4), octet_length(block))").alias("payload"),
    )


def _joined(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Records that run over a split's end, from their head and the pieces behind it."""
    before = "PARTITION BY path ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    bases = splits.select("path", "split", F.expr(f"coalesce(sum(length) OVER ({before}), 0L)").alias("base"))
    placed = pieces.join(bases, ["path", "split"]).withColumn("first", F.col("base") + F.col("at"))
    heads = placed.filter("kind = 'head'").select(
        "path", "first", (F.col("base") + F.col("until")).alias("last"), "headers", F.col("block").alias("begun")
    )
    # the piece of a split opens with the magic line that ended the split before
    rest = placed.filter("kind = 'piece'").select("path", (F.col("base") - len(MAGIC)).alias("piece_at"), "block")
    together = (
        heads.join(rest, "path")
        .filter((F.col("piece_at") > F.col("first")) & (F.col("piece_at") < F.col("last")))
        .groupBy("path", "first")
        .agg(
            F.first("headers").alias("headers"),
            F.first("begun").alias("begun"),
            F.array_sort(F.collect_list(F.struct("piece_at", "block"))).alias("pieces"),
        )
    )
    whole = "concat(begun, aggregate(pieces, CAST('' AS BINARY), (a, p) -> concat(a, p.block)))"
    return together.select("headers", F.expr(whole).alias("block")).select(
        "headers", F.expr("substring(block, 1, CAST(headers['content-length'] AS INT))").alias("block")
    )


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, refers_to, url, payload, payload_bytes, payload_digest.

    A revisit has no payload of its own; its headers tell size and digest.
    """
    page = lambda name: F.regexp_extract(F.col("headers")[name], "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    revisit = F.col("headers")["warc-type"] == "revisit"
    told = F.regexp_extract("http_headers", "(?i)content-length: *([0-9]+)", 1).try_cast("long")
    return read_archives(spark, path).select(
        page("warc-record-id").alias("page_id"),
        F.col("headers")["warc-type"].alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
        F.col("headers")["warc-target-uri"].alias("url"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha256:", ""))
        .otherwise(F.sha2("payload", 256))
        .alias("payload_digest"),
    )
