"""Connected components of a table of links, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def connected_components(links: DataFrame, work: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of ``links`` (a, b).

    Each step takes the smallest label among neighbours and then the label of that
    label, so long chains shorten by doubling.  Labels live in tables of the shared
    folder between steps; only one count per step reaches the driver.
    """
    both = work.table(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        parents = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = work.table(hooked.join(parents, "component", "left").select("node", "old", F.least("component", "root").alias("component")))
        labels = moved.select("node", "component")
        if not moved.filter("component <> old").limit(1).count():
            return labels
