"""Live feeds as Structured Streaming: refresh of a snapshot by micro-batch, last known state, event-time windows.

A snapshot is a set of versions, each a whole Parquet folder; the pointer, a one-row Parquet folder of its own per version, names
the newest whole one. A batch writes its version first and its pointer last, so a reader never sees half of one, and a batch that
runs again after a failure writes the same version anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import traffic
from ..operators.storage import new_path

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events file of a folder as a stream, with event time `at`."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the whole versions of a snapshot, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/pointer")
    f = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in f.listStatus(p) if _exists(spark, f"{x.getPath()}/_SUCCESS")) if f.exists(p) else []


def current(spark: SparkSession, at: str) -> DataFrame | None:
    found = versions(spark, at)
    return spark.read.parquet(f"{at}/version/{found[-1]}") if found else None


def publish(df: DataFrame, at: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{at}/version/{version}")
    df.sparkSession.createDataFrame([(version,)], "version long").write.mode("overwrite").parquet(f"{at}/pointer/{version}")


def vacuum(spark: SparkSession, at: str, keep: int, pinned: set[int] = frozenset()) -> list[int]:
    """Removes all versions but the newest `keep` and the pinned ones; gives what it removed."""
    found = versions(spark, at)
    gone = [v for v in found[:-keep] if v not in pinned]
    for v in gone:
        for part in ("pointer", "version"):  # the pointer first: no reader may find a version that is going
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{part}/{v}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def merge_latest(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by order."""
    rows = new if old is None else old.unionByName(new.select(old.columns))
    other = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("b")).select(*keys, *[F.col(f"b.{x}").alias(x) for x in other])


def refresh(stream: DataFrame, at: str, keys: list[str], order: list[str], checkpoint: str):
    """Keeps a snapshot of the last row of each key; runs until all that is there is read."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        older = [v for v in versions(spark, at) if v < number + 1]
        old = spark.read.parquet(f"{at}/version/{older[-1]}") if older else None
        publish(merge_latest(old, df, keys, order), at, number + 1)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def last_known(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and kind, kept by a stream."""
    at = new_path(spark, "snapshot")
    refresh(read_events(spark, folder).select("user_id", "event_type", "event_id", "at", "value"), at, ["user_id", "event_type"], ["at", "event_id"], new_path(spark, "offsets"))
    return current(spark, at)


def _collected(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there, by way of Parquet."""
    spark, at = stream.sparkSession, new_path(stream.sparkSession, "stream")
    q = stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", new_path(spark, "offsets")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def fresh(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Events without those repeated within the watermark."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def unique_events(spark: SparkSession, folder: str) -> DataFrame:
    return _collected(fresh(read_events(spark, folder)), "append")


def windows(spark: SparkSession, folder: str, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by kind and tumbling window. A batch writes the windows that it changed; of each the last state counts.

    The stream keeps windows within the delay only, and a batch that runs again writes the same.
    """
    at = new_path(spark, "windows")
    by = read_events(spark, folder).withWatermark("at", delay).groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("events"))

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/delta/{number}")

    by.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    deltas = spark.read.schema(T.StructType([*by.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/delta/*")
    return deltas.groupBy("window", "event_type").agg(F.max_by("events", "batch").alias("events"))


def unexpired(updates: DataFrame, now) -> DataFrame:
    """Updates that are valid at a time; a successful empty feed gives none, which is not the same as a feed that failed."""
    return updates.where(traffic.expiry(F.lit(None).cast("timestamp"), "freshness", "kind") > now)


def or_last_known(feed: DataFrame, available: DataFrame, previous: DataFrame) -> DataFrame:
    """The feed's rows, and for sources (provider_id, kind) that were not available the rows they last had.

    available: provider_id, kind, ok. A source that was available and gave nothing has nothing.
    """
    lost = available.where("not ok").select("provider_id", "kind")
    good = feed.join(lost, ["provider_id", "kind"], "left_anti")
    return good.unionByName(previous.join(lost, ["provider_id", "kind"], "left_semi").select(feed.columns))
