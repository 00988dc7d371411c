"""Historical speeds: CSV lines of edge, free-flow and constrained km/h and a week's profile as base64 of 200 big-endian 16-bit coefficients."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, shape
from ..functions.geo import c

SCHEMA = "edge string, free string, constrained string, profile string, _bad string"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edge_id, free_kph, constrained_kph, profile binary), and the lines that are not such rows, with their file.

    An empty profile is null. The edge is level/tile/index text.
    """
    raw = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").csv(path).withColumn("file", F.col("_metadata.file_path"))
    rows = raw.withColumn("edge_id", keys.parse_id("edge")).withColumn("free_kph", F.col("free").try_cast("int")).withColumn("constrained_kph", F.col("constrained").try_cast("int")).withColumn("bytes", F.try_to_binary(F.nullif(F.col("profile"), F.lit("")), F.lit("base64")))
    sizes = F.coalesce(F.octet_length("bytes") == 400, F.nullif(F.col("profile"), F.lit("")).isNull())
    good = F.coalesce(F.col("_bad").isNull() & F.col("edge_id").isNotNull() & F.col("free_kph").between(0, 255) & F.col("constrained_kph").between(0, 255) & sizes, F.lit(False))
    return rows.where(good).select("edge_id", "free_kph", "constrained_kph", F.col("bytes").alias("profile")), rows.where(~good).select("file", "edge", "free", "constrained")


def encode(coefficients: np.ndarray) -> str:
    return base64.b64encode(np.asarray(coefficients).astype(">i2").tobytes()).decode()


def speed_at(profile, second) -> Column:
    """km/h of a profile at a second of the week; null without a profile."""
    shape._by_value()

    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else shape.profile_speed(np.frombuffer(b, ">i2").astype(float), int(k)) for b, k in zip(p, s, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(c(profile), c(second))


def apply(edges: DataFrame, speeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with the speeds that the data set has for them, and the ids of the data set that are no edge."""
    own = speeds.select("edge_id", "free_kph", "constrained_kph", "profile")
    return edges.join(own, "edge_id", "left"), own.join(edges.select("edge_id"), "edge_id", "left_anti").select("edge_id")
