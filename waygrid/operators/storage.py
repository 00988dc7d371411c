"""Tables of a running job in the shared folder: they cut the lineage of loops and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs in one process, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see, as a URI."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = DEFAULT_SHARED
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waygrid/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written and read back."""
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop(df: DataFrame) -> None:
    """Removes the files of a table that stage() made and no later plan reads."""
    spark = df.sparkSession
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/waygrid/" in at:
            p = spark._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
