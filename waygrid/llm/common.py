"""What the operators share: the shared folder, stage tables, shipping of this package, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import drop as drop_table
from ..operators.storage import new_path  # noqa: F401  for the operators
from ..operators.storage import stage as stage_table

#: Text bytes handled at once inside a Python task.
CHUNK_BYTES = 1 << 20
#: Narrow rows (a few numbers each) that may be broadcast; beyond, a join is a shuffle.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Stage tables that go when drop() is called, but for those that it is told to keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out = stage_table(df, name)
        self.made.append(out)
        return out

    def drop(self, *keep: DataFrame) -> None:
        for df in self.made:
            if not any(df is k for k in keep):
                drop_table(df)
        self.made = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, and keeps Arrow batches small."""
    sc = spark.sparkContext
    if not getattr(sc, "_waygrid_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        at = os.path.join(tempfile.mkdtemp(), "waygrid_pkg.zip")  # read by the driver alone, which serves it
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(at)
        sc._waygrid_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns only, whatever else df has: doc_id long and text string, null text as ''."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def held_out(doc_id):
    """Rows that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def schema_with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """df's columns but for those of the same name (case aside), then fields."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """As schema_with(), for a batch."""
    new = {k.lower() for k in columns}
    keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(columns.values()), names=[n for n, _ in keep] + list(columns))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, null as ''. No copy where there are no nulls."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of about `most` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df of narrow rows, to be broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
