"""Connected components by contraction: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the edges (a, b); root is the component's smallest node.

    Each round every node hooks to its smallest neighbour, chains are halved until
    each node points at the end of its chain, and the graph shrinks to those ends. At least half
    of the nodes go in a round, so long chains of links take few rounds. Nothing but
    "is any left" reaches the driver.
    """
    live = checkpointed(_both_ways(edges))
    found = None
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = checkpointed(hook)
        while True:
            after = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = checkpointed(hook.join(after, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            hook = jumped.select("a", "to")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            step = hook.withColumnRenamed("a", "root")
            found = checkpointed(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = hook.select(F.col("a").alias("b"), F.col("to").alias("end_b"))
        live = live.join(hook, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("end_b").alias("b"))
        live = checkpointed(_both_ways(live))
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
