"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import scratch_table


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every endpoint of ``edges`` (a, b): c is the smallest endpoint
    of its component.  Each round takes the smallest label among a vertex and
    its neighbours, then the label of that label; it ends when none changes.
    Rounds are written tables, so lineage stays short and survives lost
    executors; nothing but a count comes to the driver."""
    both = scratch_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                         .distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")) \
        .select("v", F.least("v", "m").alias("c"))
    labels = scratch_table(labels, "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("c").alias("m")))
        step = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("n"))
        jump = labels.select(F.col("v").alias("n"), F.col("c").alias("j"))
        step = scratch_table(step.join(jump, "n").select("v", F.least("n", "j").alias("c"),
                                                         (F.least("n", "j") != F.col("c")).alias("moved")), "labels")
        labels = step.select("v", "c")
        if step.where("moved").limit(1).count() == 0:
            return labels
