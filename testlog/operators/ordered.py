"""Ordered look-back over the lines of a run, cut in blocks when runs are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from testlog.operators.durable import BLOCK_LINES


def last_before(
    df: DataFrame,
    value: Column,
    name: str,
    long_runs: bool,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Add the last non-null ``value`` of the earlier lines of the same run.

    With ``long_runs`` each window covers one block; what earlier blocks leave
    behind is one row per block and is joined in.
    """
    df = df.withColumn(name, value)
    if not long_runs:
        w = W.partitionBy("run_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.last(name, ignorenulls=True).over(w))
    df = df.withColumn("block", F.expr(f"(line_no - 1) div {block_lines}"))
    inside = W.partitionBy("run_id", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        df.groupBy("run_id", "block")
        .agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias("left_behind"))
        .select("run_id", "block", F.last("left_behind", ignorenulls=True).over(across).alias("carried"))
        .filter(F.col("carried").isNotNull())
    )
    return (
        df.withColumn(name, F.last(name, ignorenulls=True).over(inside))
        .join(carried, ["run_id", "block"], "left")
        .withColumn(name, F.coalesce(name, "carried"))
        .drop("block", "carried")
    )


def running_total(
    df: DataFrame, value: Column, name: str, order: str = "line_no", block_size: int = BLOCK_LINES
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same run.

    ``order`` numbers the rows of a run, with gaps or without.  Each window covers one block of
    numbers; the sums of whole blocks are one row per block.
    """
    df = df.withColumns({name: value, "block": F.expr(f"{order} div {block_size}")})
    inside = W.partitionBy("run_id", "block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        df.groupBy("run_id", "block")
        .agg(F.sum(name).alias("whole"))
        .select("run_id", "block", F.sum("whole").over(across).alias("carried"))
        .filter(F.col("carried").isNotNull())
    )
    zero = F.lit(0)
    return (
        df.withColumn(name, F.coalesce(F.sum(name).over(inside), zero))
        .join(carried, ["run_id", "block"], "left")
        .withColumn(name, F.col(name) + F.coalesce("carried", zero))
        .drop("block", "carried")
    )
