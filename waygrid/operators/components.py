"""Connected components of small and large edge tables by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node of the component. Each round every node takes the least label around it, then that label's label."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = stage(e.union(e.select("v", "u")).distinct(), "component-edges")
    labels = stage(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "component-labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.least("root", "m").alias("l"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("l"), F.col("root").alias("r"))
        new = stage(least.join(jump, "l").select("node", F.least("l", "r").alias("root"), "old"), "component-labels")
        if new.where("root != old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
