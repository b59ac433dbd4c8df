"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of distinct edges (a > b).

    large: every node links its larger neighbours to the smallest node around it.
    Otherwise: every node links its smaller neighbours, and itself, to the smallest of them.
    The smallest is an aggregate and joined back, so a node with many links is never gathered.
    """
    around = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = around.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("node", "low"))
    linked = around.join(least, "node")
    if large:
        out = linked.where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
    return out.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for every node of links (a, b).

    Each round writes its edges to the shared folder, which cuts the lineage. It ends when a
    round changes nothing: then every edge leads from a node to its root.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(pairs, "component-edges")
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
        edges = materialise(star(star(edges, large=True), large=False), "component-edges")
