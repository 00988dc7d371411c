"""Elevation rasters of one degree (N43E007.hgt: square, big-endian 16-bit metres, -32768 without data) and samples from them."""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shape
from ..functions.geo import c

NO_DATA = -32768


def tile_name(lat, lon) -> Column:
    """The name of the raster that holds a point."""
    a, b = F.floor(c(lat)).cast("int"), F.floor(c(lon)).cast("int")
    pad = lambda x, n: F.lpad(F.abs(x).cast("string"), n, "0")
    return F.concat(F.when(a >= 0, "N").otherwise("S"), pad(a, 2), F.when(b >= 0, "E").otherwise("W"), pad(b, 3))


def corner(name: str) -> tuple[int, int]:
    m = re.fullmatch(r"([NS])(\d{2})([EW])(\d{3})", name)
    return int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)


def grid(raw: bytes) -> np.ndarray:
    """Rows from north to south; a raster that is not square is an error."""
    side = math.isqrt(len(raw) // 2)
    if side * side * 2 != len(raw) or side < 2:
        raise ValueError("a raster that is not square")
    return np.frombuffer(raw, ">i2").reshape(side, side)


def sample(points: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(point_id, elevation): metres between the four cells around each point, null where there is no raster or no data.

    A task holds the raster of one tile and the points of that tile in batches.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    shape._by_value()
    rasters = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select(F.regexp_extract("path", r"([NS]\d{2}[EW]\d{3})\.hgt$", 1).alias("tile"), "content")
    at = points.select("point_id", "lat", "lon", tile_name("lat", "lon").alias("tile"))
    both = at.groupBy("tile", F.pmod(F.xxhash64("point_id"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("point_id", "lat", "lon")).alias("points")).join(rasters, "tile", "left")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, found = [], []
                g = grid(row["content"]) if row["content"] is not None else None
                for p in row["points"]:
                    ids.append(p["point_id"])
                    if g is None:
                        found.append(None)
                    else:
                        south, west = corner(row["tile"])
                        found.append(shape.bilinear(g, (south + 1 - p["lat"]) * (len(g) - 1), (p["lon"] - west) * (len(g) - 1), NO_DATA))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], names=["point_id", "elevation"])

    return both.mapInArrow(run, "point_id long, elevation double")
