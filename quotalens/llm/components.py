"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quotalens.llm.store import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach.  Nodes without a link are not listed.

    Every round takes the least label among neighbours and then the label of that label, so chains
    halve; rounds go on until nothing changes.  Aggregates combine before the shuffle, so a node with
    very many links is no hot group.
    """
    edges = saved(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")).withColumn("changed", F.lit(True)), "labels")
    while not labels.where("changed").isEmpty():
        near = edges.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = lower.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was")
        labels = saved(new.select("node", "component", (F.col("component") != F.col("was")).alias("changed")), "labels")
    return labels.select("node", "component")
