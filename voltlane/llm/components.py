"""Connected components of a graph too large for one task, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) of every node in `edges` (a, b), the component named by its smallest node.

    In each round every node points to its smallest neighbour, or itself, and then to that one's choice. As pointers
    only go down, nodes with a common pointer belong together; edges are then drawn between what they point to, and
    those inside one group go. A hub costs its neighbours one partial minimum each. Rounds are written, so a lost
    executor repeats no earlier round, and only the number of edges left reaches the driver. Nulls and self-loops
    take no part.
    """
    links = stages(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        down = links.groupBy(col("b").alias("node")).agg(F.min("a").alias("to"))
        up = links.groupBy(col("a").alias("node")).agg(F.min("b").alias("to"))
        chosen = down.unionByName(up).groupBy("node").agg(F.least(col("node"), F.min("to")).alias("to"))
        chosen = stages(chosen, "chosen")
        second = chosen.select(col("node").alias("to"), col("to").alias("then"))
        pointers = stages(chosen.join(second, "to").select("node", col("then").alias("to")), "pointers")
        if labels is None:
            labels = pointers.select("node", col("to").alias("component"))
        else:
            step = pointers.select(col("node").alias("component"), "to")
            labels = stages(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left = pointers.select(col("node").alias("a"), col("to").alias("x"))
        right = pointers.select(col("node").alias("b"), col("to").alias("y"))
        again = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = stages(again.distinct(), "links")
    return labels if labels is not None else links.select(col("a").alias("node"), col("b").alias("component"))
