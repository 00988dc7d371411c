"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

The directory maps the top bits of a 64-bit hash of the normalised text to buckets. It starts with one bucket and doubles as long
as a bucket has over `capacity` different hashes; such a bucket is split by more bits. Every row finds its bucket through the
directory and its entry in the bucket; owner tasks take ranges of buckets. An entry of several rows is a chain: its texts are
compared by their bytes. Copies of one text cannot be split by more bits: they are summed before the shuffle, one row for each task
and text. A text whose entry has one row has no copy, and its bytes are not moved.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage_table

#: Different hashes of a bucket; bits that one pass over the overfull buckets adds at most.
CAPACITY, STEP = 65_536, 8


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is ''. lower() does the same, faster, on texts that are all ASCII."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


def _cell(h: Column, depth: int) -> Column:
    """The top bits of a hash; beyond a shift of 63 a JVM would start again at 0."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell long, bucket long, local_depth int) for those of the 2**depth cells that occur, and depth. hashes: a column h long.

    A bucket's number is the first of its cells. A pass splits all buckets of more than `capacity` different hashes by as many bits
    as they need, STEP at most, which doubles the directory as often; passes go on until none is overfull or all 64 bits are used,
    so a bucket over capacity holds one hash. An empty table gives no cells.
    """
    full = stage_table(hashes.select("h").distinct(), "xh-hashes")  # a hash is one entry however many rows have it
    left, depth, found = full, 0, None
    while True:
        deep = min(depth + STEP, 64)
        cells = left.groupBy(_cell(F.col("h"), deep).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(depth + 1 if depth else 0), F.lit(deep))).alias("local_depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deep} - local_depth)"))
        totals = levels.groupBy("local_depth", "prefix").agg(F.sum("n").alias("total"))
        fits = levels.join(totals, ["local_depth", "prefix"]).where((F.col("total") <= capacity) | (F.col("local_depth") == 64))
        done = cells.join(fits.groupBy("cell").agg(F.min("local_depth").alias("local_depth")), "cell", "left")
        done = stage_table(done.select("cell", "local_depth", F.lit(deep).alias("deep")), "xh-level")
        own = done.where("local_depth is not null")
        found = own if found is None else found.union(own)
        over = done.where("local_depth is null").select("cell")
        n = over.count()
        if not n:
            break
        left, depth = left.withColumn("cell", _cell(F.col("h"), deep)).join(small(over, n), "cell", "left_semi").select("h"), deep
    depth = found.agg(F.max("local_depth")).first()[0] or 0
    at = [r[0] for r in found.select("deep").distinct().collect()]  # eight at most
    out = None
    for deep in at:
        here = full.select(_cell(F.col("h"), depth).alias("cell"), _cell(F.col("h"), deep).alias("_at")).distinct()
        here = here.join(found.where(F.col("deep") == deep).select(F.col("cell").alias("_at"), "local_depth"), "_at").select("cell", "local_depth").distinct()
        out = here if out is None else out.union(here)
    if out is None:
        return full.select(F.col("h").alias("cell"), F.col("h").alias("bucket"), F.lit(0).alias("local_depth")), 0
    return out.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")).select("cell", "bucket", "local_depth"), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of shared files: the keys of all rows (doc_id, bucket, h, sha), which found their bucket in the directory; the
    index (bucket, h, n), an entry for each hash; the chains (bucket, h, sha, keep_id, group_size), a row for each text of an entry of
    several rows.

    Owner tasks have ranges of (bucket, h). Only the texts of an entry of several rows can be equal to others; these are compared by
    their bytes. Null text counts as ''. Of equal texts the largest doc_id is kept (null is the smallest). sha: SHA-256, 32 bytes.
    """
    norm = normalised(docs[text_col])
    plain = stage_table(docs.select(docs[id_col].alias("doc_id"), hashed(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha")), "xh-rows")
    cells, depth = directory(plain.select("h"), capacity)
    cells = stage_table(cells.select("cell", "bucket"), "xh-directory")
    routed = plain.withColumn("cell", _cell(F.col("h"), depth)).join(small(cells, cells.count()), "cell").select("doc_id", "bucket", "h", "sha")
    index = routed.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("n"))
    index = stage_table(index.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "xh-index")
    several = index.where("n > 1").select("bucket", "h")
    texts = docs.select(docs[id_col].alias("doc_id"), norm.alias("norm")).withColumn("h", hashed(F.col("norm")))
    chained = texts.join(small(several, several.count()), "h")
    owned = chained.groupBy("bucket", "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chains = owned.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    return routed, index, stage_table(chains.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "sha"), "xh-chains")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Only id_col and text_col are read.

    Null and empty texts are one group. Rows that repeat a kept doc_id and its text are all marked kept. No rows give no rows.
    """
    keys, _, chains = build_index(docs, id_col, text_col, capacity)
    both = keys.join(small(chains, chains.count()), ["bucket", "h", "sha"], "left")
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns. Repeated rows of the same id and text all stay if one does."""
    groups = stage_table(exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_wg_id"), F.unhex("text_sha256").alias("_wg_sha")).distinct(), "xh-dropped")
    sha = F.unhex(F.sha2(normalised(docs[text_col]), 256))
    return docs.join(small(groups, groups.count()), docs[id_col].eqNullSafe(groups["_wg_id"]) & (sha == groups["_wg_sha"]), "left_anti")
