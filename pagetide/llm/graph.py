"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node), for every node of `edges` (a, b).

    Every node takes the smallest label among its neighbours and its own, then
    the label of its label; rounds go on until nothing changes.  Each round is a
    table in the shared folder; the driver sees one count a round.  Nulls are no nodes.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        moved = stored(hooked.join(above, "next").select("node", F.least("next", "above").alias("label"), (F.least("next", "above") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
