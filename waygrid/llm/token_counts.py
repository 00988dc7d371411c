"""Token counts by a separator scan over flat token files.

A token file is a bare run of unsigned integers, each document's ids followed by the end-of-document id; nothing else is stored.
Blocks of a fixed size are searched with NumPy, each on its own; what a block cannot know, where its first document began and
which number it has, comes from a prefix scan over the blocks' sums in two levels, so no task sees more than SUPER blocks of a
file or as many sums of such runs.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, files
from .common import new_path, stage_table

SEPARATOR = 50_256
FILE_BYTES, BLOCK_BYTES, SUPER = 64 << 20, 1 << 20, 1024
#: Blocks of a task: a search takes milliseconds.
TASK_BLOCKS = 16


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, dtype: str = "<u2", path: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encodes all texts into flat files. Gives (file, bytes), and the manifest (file, ordinal, doc_id) in file order.

    A task that runs again writes files of another name; only those that its last, finished run names are read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    make, folder = bpe.sender(docs, path, public_tokenizers.PATTERN), new_path(docs.sparkSession, "tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        out, name, size, n = None, "", 0, 0
        arrow = None

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([None], arrow), pa.array([size], pa.int64())], names=["file", "ordinal", "doc_id", "bytes"])

        for b, found in bpe.encoded(make(), batches, "text"):
            arrow = b.schema.field(0).type
            at: list[int] = []
            ids = b.column(0)
            done = 0
            for k, own in enumerate(found):
                if out is None:
                    name, size, n = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    out = files.create(name)
                raw = np.append(own, separator).astype(dtype).tobytes()
                out.write(raw)
                at.append(n)
                size, n = size + len(raw), n + 1
                if size >= file_bytes or k + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), ids.slice(done, len(at)), pa.array([None] * len(at), pa.int64())], names=["file", "ordinal", "doc_id", "bytes"])
                    done, at = k + 1, []
                    if size >= file_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    made = stage_table(rows.mapInArrow(run, f"file string, ordinal long, doc_id {kind}, bytes long"), "token-manifest")
    return made.where("ordinal < 0").select("file", "bytes"), made.where("ordinal >= 0").select("file", "ordinal", "doc_id")


def block_sums(token_files: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each block: file, block, n_sep, first_sep, last_sep (places in the file, null if none), inner (lengths between them), tokens."""
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    blocks = token_files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes})")).alias("block"))
    n = token_files.select(F.sum(F.ceil(F.col("bytes") / block_bytes))).first()[0] or 0
    spread = blocks.repartition(max(1, min(n // TASK_BLOCKS, 20_000)), "file", "block")  # rows of few bytes, whose size says nothing of the work

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                at = r["block"] * block_bytes
                with files.open_input(r["file"]) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, r["bytes"] - at), at), dtype=dtype)
                seps = np.flatnonzero(ids == separator) + at // width
                out.append((r["file"], r["block"], len(seps), int(seps[0]) if len(seps) else None, int(seps[-1]) if len(seps) else None, np.diff(seps) - 1, len(ids)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["file", "block", "n_sep", "first_sep", "last_sep", "inner", "tokens"])

    return spread.mapInArrow(run, "file string, block long, n_sep long, first_sep long, last_sep long, inner array<long>, tokens long")


def count_tokens(token_files: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) for every document of files (file, bytes).

    Tokens after a file's last separator are one more document; none there, no document. Two separators in a row hold an empty
    document. Empty files have none. A file's bytes must be a whole number of ids.
    """
    sums = stage_table(block_sums(token_files, separator, dtype, block_bytes).withColumn("super", F.expr(f"block div {SUPER}")), "token-blocks")
    small = sums.select("file", "super", "block", "n_sep", "last_sep", "tokens")
    above = small.groupBy("file", "super").agg(F.sum("n_sep").alias("n"), F.max("last_sep").alias("last"), F.sum("tokens").alias("t"))
    w = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("file", "super", "n", "last", "t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.max("last").over(w).alias("last0"))
    v = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.select("file", "super", "n_sep", "first_sep", "inner", F.coalesce(F.sum("n_sep").over(v), F.lit(0)).alias("n1"), F.max("last_sep").over(v).alias("last1"))
    known = inside.where("n_sep > 0").join(above.select("file", "super", "n0", "last0"), ["file", "super"])
    before = F.coalesce("last1", "last0", F.lit(-1))
    lengths = known.select("file", (F.col("n0") + F.col("n1")).alias("base"), F.concat(F.array(F.col("first_sep") - before - 1), "inner").alias("lengths"))
    found = lengths.select("file", "base", F.posexplode("lengths").alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")
    ends = above.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.sum("t") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens"))
    return found.unionByName(ends.where("n_tokens > 0"))


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in flat token files written for them; null and empty texts have 0."""
    token_files, manifest = write_tokens(docs, id_col, text_col, path=path)
    return manifest.join(count_tokens(token_files), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
