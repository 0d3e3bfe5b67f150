"""Reading run output as chunks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_log_chunks(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A stored table of chunks: run_id, seq, chunk and, if present, event_ts."""
    table = spark.read.format(format).load(path)
    wanted = [c for c in ("run_id", "seq", "chunk", "event_ts") if c in table.columns]
    return table.select(*wanted)


def read_log_files(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)\.[^./]*$") -> DataFrame:
    """Log files, one run each; ``run_pattern`` takes the run id out of the file path.

    Files stay splittable.  A file's splits hold its lines in order, and a line takes a byte at least, so the
    start of a split and the number of a line in it make a place: unique in the file, and in order.  The
    number is the row's number in its task less that of the split's first row, one row per split.
    """
    table = spark.read.option("lineSep", "\n").text(path)
    rows = table.select("value", "_metadata.*").withColumn("row", F.monotonically_increasing_id())
    split = ["file_path", "file_block_start"]
    firsts = rows.groupBy(*split).agg(F.min("row").alias("first"))
    later = (F.col("file_block_start") > 0).cast("bigint")  # the first split's last line may begin at its very end
    return rows.join(firsts, split).select(
        F.regexp_extract("file_path", run_pattern, 1).alias("run_id"),
        (F.col("file_block_start") + later + F.col("row") - F.col("first")).alias("seq"),
        F.concat("value", F.lit("\n")).alias("chunk"),
        F.col("file_modification_time").alias("event_ts"),
    )
