"""From output chunks to lines, and from lines to the format of each run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from testlog.functions.text import ultrim, unsigned
from testlog.operators.durable import any_row, exceeds, materialize

CHUNK_BLOCK = 4096

# How many bytes may pass before a run's format must be known.
DETECTION_BYTES = 64 * 1024
# Every line before the deciding one takes a byte at least.
DETECTION_LINES = DETECTION_BYTES + 1

FORMATS = ("json", "tap", "bun")

# Line signals of each format.
TAP_SIGNALS = ("TAP version", "ok ", "not ok ", "Bail out!")
BUN_SIGNALS = ("bun test ", "(pass)", "(fail)", "Ran ")
BUN_SECTION = "failures:"
DOT_PROGRESS = r"(?U)\A[.FfSs\s]+\z"
PLAN_SIGNAL = r"(?U)\A([+]?[0-9]+)\s*\.\.\s*([0-9]+)"


def chunks_to_lines(
    chunks: DataFrame,
    block: int = CHUNK_BLOCK,
    long_runs: bool | None = None,
    width: Callable[[str], Column] = F.octet_length,
) -> DataFrame:
    r"""Join each run's chunks in ``seq`` order and cut at ``\n``, ``\r\n`` or ``\r``.

    The text of a run is never put together as a whole: a chunk's lines are
    numbered from the count of line ends before it, and only the pieces of lines
    that cross a chunk border are collected, per line.  Chunks are ordered in
    blocks of ``block`` sequence numbers; counts reached before a block are
    carried in.  ``bytes`` is what a line took in the run's output, its end included; ``width`` measures
    a text.
    """
    timed = "event_ts" in chunks.columns
    raw = F.col("chunk")
    flat = F.when(F.contains(raw, F.lit("\r")), F.regexp_replace(raw, r"\r\n?", "\n")).otherwise(raw)
    if long_runs is None:
        long_runs = exceeds(chunks, "seq", block - 1)
    keys = ["run_id", "block"] if long_runs else ["run_id"]
    cut = chunks.filter(raw != "").select(
        "run_id",
        "seq",
        *(["event_ts"] if timed else []),
        *([F.expr(f"seq div {block}").alias("block")] if long_runs else []),
        flat.alias("text"),
        F.when(F.contains(raw, F.lit("\r\n")), F.regexp_extract_all(raw, F.lit(r"\r\n|\r|\n"), F.lit(0))).alias("ends"),
        raw.startswith("\n").alias("opens_nl"),
        raw.endswith("\r").alias("ends_cr"),
        (raw.endswith("\r") | raw.endswith("\n")).alias("ends_line"),
    )
    order = W.partitionBy(*keys).orderBy("seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # A line feed after a carriage return that ended the chunk before is no new end.
    joined = F.col("opens_nl") & F.coalesce(F.lag("ends_cr").over(order), F.lit(False))
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = (
        cut.withColumn("joined", joined)
        .withColumn("after_line", F.lag("ends_line").over(order))
        .withColumn("next_nl", F.lead("opens_nl").over(order))
        .withColumn("breaks", breaks - F.col("joined").cast("int"))
        .withColumn("offset", F.coalesce(F.sum("breaks").over(before), F.lit(0)))
    )
    if long_runs:
        runs = W.partitionBy("run_id").orderBy("block")
        carried = (
            rows.groupBy(*keys)
            .agg(
                F.sum("breaks").alias("n"),
                F.min_by("opens_nl", "seq").alias("opens_nl"),
                F.max_by("ends_cr", "seq").alias("ends_cr"),
                F.max_by("ends_line", "seq").alias("ends_line"),
                F.min("seq").alias("first_seq"),
                F.max("seq").alias("last_seq"),
            )
            .withColumn(
                "fix", F.col("opens_nl") & F.coalesce(F.lag("ends_cr").over(runs), F.lit(False))
            )
            .withColumn("line_before", F.lag("ends_line").over(runs))
            .withColumn("nl_after", F.lead("opens_nl").over(runs))
            .withColumn("n", F.col("n") - F.col("fix").cast("int"))
            .select(
                *keys,
                "first_seq",
                "last_seq",
                "fix",
                "line_before",
                "nl_after",
                F.coalesce(
                    F.sum("n").over(runs.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
                ).alias("start"),
            )
        )
        first = F.col("seq") == F.col("first_seq")
        rows = (
            rows.join(carried, keys)
            .withColumn("joined", F.when(first, F.col("fix")).otherwise(F.col("joined")))
            .withColumn("after_line", F.when(first, F.col("line_before")).otherwise(F.col("after_line")))
            .withColumn("next_nl", F.when(F.col("seq") == F.col("last_seq"), F.col("nl_after")).otherwise(F.col("next_nl")))
            .withColumn(
                "offset",
                F.col("offset") + F.col("start") - F.when(~first, F.col("fix").cast("int")).otherwise(0),
            )
        )
    text = F.when(F.col("joined"), F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    stamp = ["event_ts"] if timed else []
    pieces = (
        rows.select(
            "run_id",
            "seq",
            *stamp,
            "offset",
            F.coalesce("after_line", F.lit(True)).alias("fresh"),
            # the line feed that a following chunk opens with belongs to the carriage return that ends this one
            (F.col("ends_cr") & F.coalesce("next_nl", F.lit(False))).cast("int").alias("late_nl"),
            F.when(F.col("joined"), F.slice("ends", 2, 2**31 - 1)).otherwise(F.col("ends")).alias("ends"),
            F.split(text, "\n", -1).alias("parts"),
        )
        .select(
            "run_id",
            "seq",
            *stamp,
            "offset",
            "fresh",
            "late_nl",
            "ends",
            (F.size("parts") - 1).alias("last"),
            F.posexplode_outer("parts").alias("pos", "piece"),
        )
        .filter((F.col("pos") < F.col("last")) | (F.col("piece") != ""))
        .select(
            "run_id",
            "seq",
            *stamp,
            (F.col("offset") + F.col("pos") + 1).cast("int").alias("line_no"),
            "piece",
            (
                width("piece")
                + F.when(F.col("pos") < F.col("last"), F.coalesce(F.octet_length(F.get("ends", F.col("pos"))), F.lit(1))).otherwise(0)
                + F.when(F.col("pos") == F.col("last") - 1, F.col("late_nl")).otherwise(0)
            )
            .cast("bigint")
            .alias("bytes"),
            (F.col("pos") < F.col("last")).alias("ended"),
            ((F.col("pos") > 0) | F.col("fresh")).alias("begun"),
        )
    )
    whole = F.col("ended") & F.col("begun")
    columns = ["run_id", "line_no", F.col("piece").alias("line"), *stamp, "bytes"]
    ends_line = raw.endswith("\r") | raw.endswith("\n")
    if not any_row(chunks.filter((raw != "") & ~ends_line)):  # no line goes past the end of its chunk
        return pieces.filter(whole).select(*columns)
    crossing = (
        pieces.filter(~whole)
        .groupBy("run_id", "line_no")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]
                ),
                "",
            ).alias("piece"),
            F.sum("bytes").alias("bytes"),
            *([F.max("event_ts").alias("event_ts")] if timed else []),
        )
    )
    return pieces.filter(whole).select(*columns).unionByName(crossing.select(*columns))


def stored_lines(chunks: DataFrame, **options) -> DataFrame:
    """Lines of a chunk table, written once for the several passes made over them."""
    return materialize(chunks_to_lines(materialize(chunks), **options))


def binary_chunks_to_lines(chunks: DataFrame, **options) -> DataFrame:
    """As ``chunks_to_lines`` for BINARY chunks, with a ``valid`` UTF-8 flag per line.

    Bytes are cut as single-byte text, so a character split over two chunks is
    whole again before it is checked.
    """
    as_text = chunks.withColumn("chunk", F.decode("chunk", "ISO-8859-1"))
    lines = chunks_to_lines(as_text, width=F.char_length, **options)
    text = F.encode("line", "ISO-8859-1").cast("string")
    return lines.withColumn("line", text).withColumn("valid", F.is_valid_utf8("line"))


def valid_utf8_runs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of runs that are valid UTF-8 throughout, and the ids of the others."""
    rejected = lines.filter(~F.col("valid")).select("run_id").distinct()
    good = lines.join(rejected, "run_id", "left_anti").drop("valid")
    return good, rejected


def line_signal(t: Column) -> Column:
    """Format a left-trimmed line gives away, or null."""
    first = F.left(t, F.lit(1))
    plan = (
        first.between("+", "9")
        & t.rlike(PLAN_SIGNAL)
        & unsigned(F.regexp_extract(t, PLAN_SIGNAL, 1)).isNotNull()
        & unsigned(F.regexp_extract(t, PLAN_SIGNAL, 2)).isNotNull()
    )

    def any_prefix(prefixes: tuple[str, ...]) -> Column:
        found = t.startswith(prefixes[0])
        for p in prefixes[1:]:
            found = found | t.startswith(p)
        return found

    return (
        F.when(t == "", F.lit(None))
        .when(first.isin("{", "["), F.lit("json"))
        .when(any_prefix(TAP_SIGNALS) | plan, F.lit("tap"))
        .when(
            any_prefix(BUN_SIGNALS)
            | (F.lower(t) == BUN_SECTION)
            | (first.isin(".", "F", "f", "S", "s") & t.rlike(DOT_PROGRESS)),
            F.lit("bun"),
        )
    )


def detect_format(lines: DataFrame) -> DataFrame:
    """Format of every run from its first telling line, else TAP.

    Only lines within the byte budget count, hence only the first
    ``DETECTION_LINES`` lines of a run are looked at, however long it is.  Lines without ``bytes``
    count as ended by a line feed.
    """
    taken = F.col("bytes") if "bytes" in lines.columns else F.octet_length("line") + 1
    head = (
        lines.filter(F.col("line_no") <= DETECTION_LINES)
        .select(
            "run_id",
            "line_no",
            taken.cast("bigint").alias("bytes"),
            ultrim(F.col("line")).alias("t"),
        )
        .select("run_id", "line_no", "bytes", line_signal(F.col("t")).alias("signal"))
    )
    before = W.partitionBy("run_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    read = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    # line number and signal in one number, so that the least needs no string
    code = F.expr("CASE signal " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(FORMATS)) + " END")
    telling = F.when(F.col("read") <= DETECTION_BYTES, F.col("line_no").cast("bigint") * len(FORMATS) + code)
    first = head.withColumn("read", read).groupBy("run_id").agg(F.min(telling).alias("first"))
    found = F.expr(f"CASE first % {len(FORMATS)} " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FORMATS)) + " END")
    return first.select("run_id", F.coalesce(found, F.lit("tap")).alias("format"))


def choose_format(detected: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """An explicit format setting overrides detection; 'auto' does not."""
    if settings is None:
        return detected
    explicit = settings.select("run_id", F.nullif("input_format", F.lit("auto")).alias("explicit"))
    return detected.join(explicit, "run_id", "left").select(
        "run_id", F.coalesce("explicit", "format").alias("format")
    )


def route(lines: DataFrame, formats: DataFrame) -> dict[str, DataFrame]:
    """Lines of each format, ready for that format's operators."""
    tagged = lines.join(formats.select("run_id", "format"), "run_id")
    return {
        name: tagged.filter(F.col("format") == name).drop("format")
        for name in ("tap", "json", "bun")
    }
