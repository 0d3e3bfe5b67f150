"""Connected components of a table of links by minimum labels and pointer jumping.

Each round gives a node the least among its label, its neighbours' labels, and the label
of its label.  Rounds are written tables; links and labels never leave the
executors.  A node with very many links is aggregated map-side, and its joins are
left to Spark's splitting of skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.operators.durable import any_row, store


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label: least node of its component."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("peer"))
    ends = store(ends.unionByName(ends.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct())
    labels = store(
        ends.groupBy("node").agg(F.min("peer").alias("least")).select("node", F.least("node", "least").alias("label"))
    )
    while True:
        offered = (
            ends.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("near")), "peer")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = store(
            labels.join(offered, "node", "left")
            .join(further, "label", "left")
            .select(
                "node",
                F.col("label").alias("old"),
                F.least("label", F.coalesce("near", "label"), F.coalesce("further", "label")).alias("label"),
            )
        )
        labels = new.select("node", "label")
        if not any_row(new.filter(F.col("old") != F.col("label"))):
            return labels
