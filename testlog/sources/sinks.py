"""Writing run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.operators.runs import is_success
from testlog.schema import STATE_COLUMNS


def text_summary() -> Column:
    """``status=.. total=.. ... parse_warnings=..`` for a state row."""
    pairs = [("status", F.when(is_success(), "success").otherwise("failure"))]
    pairs += [(c, F.col(c)) for c in ("total", "passed", "failed", "todo", "skipped")]
    pairs += [("parse_warnings", F.col("parse_warning_count"))]
    return F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in pairs])


def json_summary() -> Column:
    """The nine state fields as a JSON object, nulls kept."""
    return F.to_json(F.struct(*STATE_COLUMNS), {"ignoreNullFields": "false"})


def summaries(states: DataFrame, mode: str) -> DataFrame:
    """(run_id, summary) in ``text`` or ``json``; ``none`` gives no rows."""
    if mode == "none":
        return states.limit(0).select("run_id", F.lit("").alias("summary"))
    render = {"text": text_summary, "json": json_summary}[mode]
    return states.select("run_id", render().alias("summary"))


def routed_summaries(states: DataFrame, settings: DataFrame) -> DataFrame:
    """(run_id, summary_file, summary): each run in the format its settings ask for.

    ``summary_file`` is null for the common output, which is also what "-" stands for.
    """
    wanted = settings.select("run_id", "summary_format", F.nullif("summary_file", F.lit("-")).alias("summary_file"))
    text = F.when(F.col("summary_format") == "text", text_summary()).when(
        F.col("summary_format") == "json", json_summary()
    )
    rows = states.select("run_id", *STATE_COLUMNS).join(wanted, "run_id")
    return rows.select("run_id", "summary_file", text.alias("summary")).filter(F.col("summary").isNotNull())


def write_routed(summaries: DataFrame, path: str) -> None:
    """Summaries below ``path``, a folder for each summary file; the common output is in ``summary_file=-``."""
    target = F.coalesce("summary_file", F.lit("-"))
    rows = summaries.select(target.alias("summary_file"), "summary")
    rows.write.mode("overwrite").partitionBy("summary_file").text(path)


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """(summary_file, summary) as ``write_routed`` left them."""
    found = spark.read.schema("value STRING, summary_file STRING").text(path)
    return found.select("summary_file", F.col("value").alias("summary"))


def write_summary(states: DataFrame, mode: str, path: str) -> None:
    """One summary line per run as text files."""
    if mode != "none":
        summaries(states, mode).select("summary").write.mode("overwrite").text(path)
