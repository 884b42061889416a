"""Connected components of a link table, by minimum labels and pointer jumping in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stage


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long, any number of rows and directions. Gives (v, c): each vertex of a link, and the least vertex of its component.

    Each round takes the least label among neighbours, then the label of that
    label, so a path of n vertices needs about log n rounds. Every round is a
    written table: lost executors cost one round at most.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stage(both, "edges")
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).select(F.col("a").alias("v"), "c"), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), F.col("c").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        least = labels.join(near.select(F.col("a").alias("v"), "n"), "v", "left").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("u"))
        new = stage(least.join(up, "c", "left").select("v", "old", F.least("c", "u").alias("c")), "labels")
        done = new.where("old <> c").isEmpty()
        labels = new.select("v", "c")
        if done:
            return labels
