"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b).

    Each round passes the smaller label along every link to the node and to the
    node's present label, then follows labels one step. Rounds grow with the
    logarithm of a component's size; each is written before the next, so lost
    executors repeat one round at most. Nothing is gathered but a count. Both sides of
    every join are written tables or the rows of one, so a label that a third of all
    nodes share is split by the skew join.
    """
    both = store.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = store.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        of = lambda c, at, to: c.join(labels.select(F.col("node").alias(at), F.col("label").alias(to)), at)  # noqa: E731, B023
        passed = of(of(both, "a", "la"), "b", "lb").where("lb < la")
        better = passed.select(F.explode(F.array("a", "la")).alias("node"), "lb").groupBy("node").agg(F.min("lb").alias("new"))
        hooked = store.write(labels.join(better, "node", "left").select("node", F.least("label", "new").alias("label"), F.col("label").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = store.write(hooked.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        same = stepped.where("label <> old").limit(1).count() == 0
        new = stepped.select("node", "label")
        store.drop(labels)
        store.drop(hooked)
        labels = new
        if same:
            store.drop(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
