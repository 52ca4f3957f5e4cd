"""Connected components of an edge list by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.joins import gathered, look_up
from quartergrid.session import durable, tidy


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``edges(a, b)``: the smallest id connected with each.

    Every round joins edges with labels on a salted key, so a hub with very many edges is
    spread over tasks, and halves the longest chain of labels; the rounds end when no
    label changes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    # Not a union of both ways, which would work out the edges twice.
    both = durable(edges.where("a <> b").select(F.inline(ways)).distinct())
    n = both.count()
    both = gathered(both, n)
    least = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    labels = durable(gathered(least, n))
    while True:
        near = (
            gathered(look_up(both.withColumnRenamed("a", "key"), labels), n)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("found").alias("near"))
        )
        closer = labels.join(near.hint("merge"), "node").select("node", "component", F.least("component", "near").alias("key"))
        found = look_up(gathered(closer, n), labels).select("node", F.col("found").alias("new"), "component")
        jumped = durable(gathered(found, n))
        moved = jumped.where("new <> component").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("component"))
        tidy(edges.sparkSession)
        if not moved:
            return labels
