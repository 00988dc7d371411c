"""Places of rows in a sorted order, without a task that has a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage


def places(rows: DataFrame, order: list[Column], key: str | None = None, name: str = "place") -> DataFrame:
    """rows with their place, from 1, among those of the same key (of all rows if none). order must tell all rows of a key apart.

    A range sort deals even a single key to many tasks; what comes before a task's rows follows from a count for each task and key.
    """
    first = [F.col(key)] if key else []
    own = stage(rows.orderBy(*first, *order).withColumn("_wg_part", F.spark_partition_id()), "sorted")
    keys = [key] if key else []
    sums = own.groupBy(*keys, "_wg_part").agg(F.count(F.lit(1)).alias("n"))
    w = (Window.partitionBy(*keys) if key else Window.partitionBy(F.lit(0))).orderBy("_wg_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_wg_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_wg_base"))  # a row for each task and key
    within = F.row_number().over(Window.partitionBy("_wg_part", *keys).orderBy(*order))
    return own.withColumn(name, within).join(before, [*keys, "_wg_part"]).withColumn(name, (F.col(name) + F.col("_wg_base")).cast("long")).drop("_wg_part", "_wg_base")
