"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source has a weight and a share of the total size in proportion to it, but no more
than ``epochs`` times its own size.  What the clamped sources cannot take goes to the others,
by weight, until none is above its cap: sources in the order of cap / weight are filled one
after another, so running sums of caps and weights tell where the clamped ones end.

A source then takes ``whole`` repetitions of every document and a fraction of one more.
For the fraction its documents stand in a seeded random order, the order of a digest
of seed, id and text: the documents before a border are taken once more, the one at the
border in part, so that a source meets its target to the word.  The border is found without
sorting a source: sums by the first digits of the digest say in which part of the order it
lies, sums by the next digits narrow that down, and only the few documents left are ordered.
A source that holds a third of all rows is thus never in one task.

Defined results: a null text has size 0; a null source is a source of its own, the last
one; sources and documents of size 0 take nothing; rows equal in id and text share
the border, and each takes the same part of it, rounded down; rows without an id are told
apart by their texts; reruns agree, however rows are partitioned; an empty table gives
an empty table.  Added columns replace input columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testlog.operators.durable import store

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20240817
SPACE = r"\x20\x09-\x0D"
DIGITS = 3  # hexadecimal digits of a digest by which a part of the order is narrowed down
P = "__mix_"


def n_words(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")
    return F.size(words).cast("long")


def _measured(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """Add the source, the size and the place in the random order to every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        *[F.col(c) for c in docs.columns if not c.startswith(P)],
        F.col(source).cast("string").alias(P + "source"),
        n_words(F.col(text).cast("string")).alias(P + "size"),
        F.sha2(F.concat_ws(":", F.lit(str(seed)), name, body), 256).alias(P + "key"),
    )


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add running sums, without the row itself, over all rows of a table.

    Rows are dealt out by range; sums before a partition come from one row per partition.
    """
    dealt = store(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(f"{c}_part") for c in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select("part", *[F.coalesce(F.sum(f"{c}_part").over(before), zero).alias(f"{c}_part") for c in sums])
    return (
        dealt.join(parts, "part")
        .withColumns({out: F.col(f"{c}_part") + F.coalesce(F.sum(c).over(inside), zero) for c, out in sums.items()})
        .drop("part", *[f"{c}_part" for c in sums])
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row a source.

    Weights are given to the sources in the order of their names, null last, and repeat.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = _running(sizes.withColumn("one", F.lit(1).cast("long")), by_name, {"one": "place"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    common = math.lcm(*weights)
    weighed = store(
        named.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    )
    # a handful of numbers over all sources
    total = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total.size is None:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    level = F.expr(f"cap * ({common} DIV weight)")  # cap / weight, in whole numbers
    filled = _running(
        weighed.withColumn("level", level),
        [F.col("level"), F.col("source").asc_nulls_last()],
        {"cap": "caps_before", "weight": "weights_before"},
    )
    wide = "CAST({} AS DECIMAL(19, 0))"
    clamped = F.expr(
        f"{wide.format('cap')} * {wide.format(f'{total.weight} - weights_before')}"
        f" <= {wide.format('weight')} * {wide.format(f'{total.size} - caps_before')}"
    )
    filled = store(filled.withColumn("clamped", clamped))
    held = filled.filter("clamped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    left, weight_left = total.size - (held.cap or 0), total.weight - (held.weight or 0)
    share = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(max(weight_left, 1)).cast("double")
    return filled.select(
        "source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def plan(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """What each source takes: source, source_size, target, ``whole`` repetitions of all rows, one more of
    the rows before ``border``, and ``rest`` words of the ``border_size`` words at it.

    ``rows`` has (source, size, key), ``goals`` comes from ``targets``.
    """
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.expr("IF(source_size = 0, 0L, goal DIV source_size)")
    goals = goals.withColumn("goal", goal).withColumn("whole", whole)
    goals = store(goals.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")))
    # parts of the order in which the border lies: (of, prefix, rest)
    border = goals.filter("rest > 0").select(F.col("source").alias("of"), F.lit("").alias("prefix"), "rest")
    for known, digits in ((0, DIGITS), (DIGITS, 2 * DIGITS), (2 * DIGITS, 64)):
        here = _same("source", "of") & (F.substring("key", 1, known) == F.col("prefix"))
        # the first sums are over all rows, so they are made before the join
        sums = rows if known else rows.groupBy("source", F.substring("key", 1, digits).alias("key")).agg(F.sum("size").alias("size"))
        sums = (
            sums.join(border.select("of", "prefix", "rest"), here)
            .groupBy("of", F.substring("key", 1, digits).alias("part"))
            .agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        )
        order = Window.partitionBy("of").orderBy("part")
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        border = store(
            sums.withColumn("upto", upto)
            .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
            .select("of", F.col("part").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), "size")
        )
    found = border.select("of", F.col("prefix").alias("border"), F.col("rest").alias("part"), F.col("size").alias("border_size"))
    return store(
        goals.join(found, _same("source", "of"), "left").select(
            "source",
            "source_size",
            "target",
            "whole",
            F.coalesce("border", F.lit("")).alias("border"),
            F.coalesce("part", F.lit(0)).cast("long").alias("rest"),
            F.coalesce("border_size", F.lit(1)).cast("long").alias("border_size"),
        )
    )


def _planned(measured: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """``measured`` with the plan of its source and the words that each row gives."""
    rows = measured.select(
        F.col(P + "source").alias("source"), F.col(P + "size").alias("size"), F.col(P + "key").alias("key")
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = plan(rows, targets(sizes, weights, epochs))
    found = found.select(*[F.col(c).alias(P + "of" if c == "source" else P + "plan_" + c) for c in found.columns])
    key, border, size = F.col(P + "key"), F.col(P + "plan_border"), F.col(P + "size")
    share = F.expr(
        f"CAST(CAST({P}plan_rest AS DECIMAL(19, 0)) * CAST({P}size AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"
        f" DIV CAST({P}plan_border_size AS DECIMAL(38, 0))"
    )
    more = F.when(key < border, size).when(key == border, share).otherwise(F.lit(0))
    return measured.join(found, _same(P + "source", P + "of")).withColumn(
        P + "taken", F.col(P + "plan_whole") * size + more
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: its id, source, size, source_size, target of its source, and taken, the words that
    the mix takes of it with repeats counted."""
    measured = _measured(docs, id_col, text, source, seed)
    measured = store(measured.select(F.col(id_col).alias(P + "id"), P + "source", P + "size", P + "key"))
    return _planned(measured, weights, epochs).select(
        F.col(P + "id").alias(id_col),
        F.col(P + "source").alias("source"),
        F.col(P + "size").alias("size"),
        F.col(P + "plan_source_size").alias("source_size"),
        F.col(P + "plan_target").alias("target"),
        F.col(P + "taken").alias("taken"),
    )


def repetitions(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: each document once per repetition, with ``epoch`` from 1; the last text of a document
    that is taken in part has its first words only, with single spaces between them."""
    planned = _planned(_measured(docs, id_col, text, source, seed), weights, epochs)
    size, taken = F.col(P + "size"), F.col(P + "taken")
    copies = F.expr(f"({P}taken + {P}size - 1) DIV {P}size")
    rows = planned.filter(taken > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.least(size, taken - (F.col("epoch") - 1) * size)
    cut = F.array_join(F.slice(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), F.lit(1), words.cast("int")), " ")
    kept = [c for c in docs.columns if c not in (text, "epoch") and not c.startswith(P)]
    return rows.select(*kept, F.when(words < size, cut).otherwise(F.col(text)).alias(text), "epoch")
