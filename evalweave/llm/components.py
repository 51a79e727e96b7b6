"""Connected components of an undirected edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every end of ``edges (a, b)``; ``comp`` is the component's smallest node.

    Each round points every node at its smallest neighbour, follows pointers to their ends, and
    replaces nodes by those ends; edges inside a component vanish. Every node that is not the
    smallest around it merges, so the rounds are logarithmic in number. Only (partially aggregated)
    minima and joins run, which adaptive execution splits for nodes with very many edges.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stage(both.filter("a <> b").distinct(), "links")
    labels = stage(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while not links.isEmpty():
        lowest = links.groupBy("a").agg(F.min("b").alias("low"))
        parents = stage(lowest.select("a", F.least("a", "low").alias("parent")), "parents")
        while True:
            upper = parents.select(F.col("a").alias("parent"), F.col("parent").alias("higher"))
            top = parents.select(F.col("a").alias("higher"), F.col("parent").alias("top"))
            moved = stage(parents.join(upper, "parent").join(top, "higher").select("a", "parent", "top"), "parents")
            parents = moved.select("a", F.col("top").alias("parent"))
            if moved.filter("parent <> top").isEmpty():
                break
        to = parents.withColumnsRenamed({"a": "comp", "parent": "next"})
        labels = stage(
            labels.join(to, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels"
        )
        ends = [parents.withColumnsRenamed({"a": c, "parent": f"{c}_to"}) for c in ("a", "b")]
        moved = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = stage(moved.filter("a <> b").distinct(), "links")
    return labels
