"""Polygon tables: which polygon covers a point, by cells of the bounding boxes and then exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def covering(points: DataFrame, polygons: DataFrame, cell: float = 0.1) -> DataFrame:
    """(point_id, polygon_id) of the first polygon, by id, that covers a point; points that none covers are not there.

    points: point_id, x, y; polygons: polygon_id, ring array<struct<x, y>>, closed.
    """
    low, high = (lambda f: F.array_min(F.transform("ring", lambda p: p[f]))), (lambda f: F.array_max(F.transform("ring", lambda p: p[f])))
    span = lambda f: F.explode(F.sequence(F.floor(low(f) / cell), F.floor(high(f) / cell)))
    boxes = polygons.select("polygon_id", "ring", span("x").alias("cx")).select("polygon_id", "cx", span("y").alias("cy"))  # a ring is not copied into its cells
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    inside = at.join(boxes, ["cx", "cy"]).join(polygons.select("polygon_id", "ring"), "polygon_id").where(geo.winding("x", "y", F.col("ring")) != 0)
    return inside.groupBy("point_id").agg(F.min("polygon_id").alias("polygon_id"))
