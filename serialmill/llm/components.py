"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two bigint columns a, b. Returns (node, label): the smallest node of the component, for each node of an edge.

    Each round is a few joins and a map-side combined minimum; labels are written to the shared folder after
    every round, so a lost executor costs one round at most. No edge or label reaches the driver but a count.
    Rows with a null end are ignored; an empty table gives no nodes.
    """
    e = edges.select("a", "b").where("a <> b")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = materialise(e.select(ends.alias("e")).select("e.*").distinct())  # one pass over what made the edges
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("bigint").alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        least = own.unionByName(near).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = materialise(least.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "was"))
        moved = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
