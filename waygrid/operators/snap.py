"""Snapping points to the graph: cells as the join key, rings of cells that grow only for points not yet sure of their answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .storage import stage

CELL = 0.05


def _cell(df: DataFrame, size: float) -> DataFrame:
    """With the row and column of the cell; columns go round the globe."""
    return df.withColumn("r", F.floor(F.col("lat") / size)).withColumn("k", F.pmod(F.floor(F.col("lon") / size), F.lit(round(360 / size))))


def _by_rings(points: DataFrame, cells: DataFrame, distance, id_col: str, extra: list[str], cell: float, cutoff_m: float) -> DataFrame:
    """(point_id, id_col, extra, meters) of the nearest row of cells (r, k, id_col, ...) for each point; distance: the join -> with meters.

    A ring of cells is only searched for points whose best distance so far is more than what the rings before it are sure to cover, so
    each point meets what is near it, never all. Rings end at the cutoff, which takes more of them where meridians are close.
    Points at one place are searched once.
    """
    spots = stage(points.groupBy("lat", "lon").agg(F.min("point_id").alias("spot")), "snap-spots")
    open_points, best, ring = stage(_cell(spots.withColumnRenamed("spot", "point_id"), cell), "snap"), None, 0
    columns = F.greatest(geo.meters_per_degree_lon("lat"), F.lit(geo.METERS_PER_DEGREE_LAT * 0.01))
    while True:
        around = [(i, j) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1) if max(abs(i), abs(j)) == ring]
        steps = F.explode(F.array(*[F.struct((F.col("r") + i).alias("r"), F.pmod(F.col("k") + j, F.lit(round(360 / cell))).alias("k")) for i, j in around]))
        near = open_points.select("point_id", "lat", "lon", steps.alias("c")).select("point_id", "lat", "lon", "c.r", "c.k").join(cells, ["r", "k"])
        near = distance(near).select("point_id", id_col, *extra, "meters")
        best = near if best is None else best.unionByName(near)
        best = stage(best.groupBy("point_id").agg(F.min(F.struct("meters", id_col, *extra)).alias("b")).select("point_id", *[F.col(f"b.{x}").alias(x) for x in (id_col, *extra, "meters")]), "snap")
        sure = F.least(columns, F.lit(geo.METERS_PER_DEGREE_LAT)) * (ring * cell)
        rest = open_points.join(best.select("point_id", "meters"), "point_id", "left").where((F.col("meters").isNull() | (F.col("meters") > sure * 0.99)) & (sure < cutoff_m)).drop("meters")
        open_points, ring = stage(rest, "snap"), ring + 1
        if open_points.isEmpty():
            near = best.where(F.col("meters") <= cutoff_m).withColumnRenamed("point_id", "spot")
            return points.select("point_id", "lat", "lon").join(spots, ["lat", "lon"]).join(near, "spot").select("point_id", id_col, *extra, "meters")


def nearest_nodes(points: DataFrame, nodes: DataFrame, cell: float = CELL, cutoff_m: float = 35_000.0) -> DataFrame:
    """(point_id, node_id, meters): the nearest node of each point, the smallest id of equals; points with none within cutoff_m have no row.

    points: point_id, lat, lon; nodes: node_id, lat, lon. Of nodes at one place only the smallest is met.
    """
    n = _cell(nodes.groupBy("lat", "lon").agg(F.min("node_id").alias("node_id")), cell).select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), "r", "k")
    return _by_rings(points, n, lambda x: x.withColumn("meters", geo.haversine("lat", "lon", "nlat", "nlon")), "node_id", [], cell, cutoff_m)


def nearest_edges(points: DataFrame, segments: DataFrame, cell: float = CELL, cutoff_m: float = 35_000.0) -> DataFrame:
    """(point_id, edge_id, share, meters): the nearest straight edge of each point; points with none within cutoff_m have no row.

    segments: edge_id, lat1, lon1, lat2, lon2. An edge is in the cells that it runs through.
    """
    at = F.explode(geo.cells_on_segment("lat1", "lon1", "lat2", "lon2", cell))
    e = segments.withColumn("c", at).withColumn("r", F.col("c.row")).withColumn("k", F.pmod(F.col("c.col"), F.lit(round(360 / cell)))).drop("c")

    def distance(x: DataFrame) -> DataFrame:
        x = x.withColumn("share", geo.project_share("lon", "lat", "lon1", "lat1", "lon2", "lat2", F.cos(F.radians("lat"))))
        place = lambda v: F.col(f"{v}1") + (F.col(f"{v}2") - F.col(f"{v}1")) * F.col("share")
        return x.withColumn("meters", F.sqrt(geo.approx_squared("lat", "lon", place("lat"), place("lon"))))

    return _by_rings(points, e, distance, "edge_id", ["share"], cell, cutoff_m)
