"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # JIT compilers skip methods over 8000 bytes; split such expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated key in a JSON object is legal; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Intermediate tables compress so well that sizes of files, shared out by column widths, say little:
    # joins are planned as shuffles, and only what a shuffle has really measured as small is broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # A side of a few rows leaves most shuffle partitions empty; it is to be broadcast all the same, or the lines
    # of a few large runs meet it in as few tasks.
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
}


# For small inputs only, set by whoever owns the session: log text compresses well, so a
# small shuffle partition still means much work; keep such partitions apart.
SMALL_INPUTS = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
