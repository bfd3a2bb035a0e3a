"""Connected components by labels that travel along edges and then jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm.common import spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (columns ``a`` and ``b``): the smallest node reachable.

    Callers give edges in which no node has very many, such as trees of bounded fan-out. Every round
    halves the way to the smallest label by jumping, and is written to the shared folder.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = written(
            spread_join(moved, roots, "component", ["node"]).select(
                "node", F.coalesce(F.least("component", "root"), "component").alias("component"), "was"
            ),
            "labels",
        )
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
