"""Benchmark decontamination: a broadcast hash set of benchmark word windows, a scan of all document windows, and a check of each hit.

Words are as in words.py. A window is `n` consecutive words of an item; an item of fewer words, but not none, is one window.
The windows are made in tasks and broadcast in blocks of about `block_windows`, as sorted arrays of hashes and the items' words once,
so what is sent is bounded whatever the benchmark's size; each block is one scan.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, schema_with, ship, stage_table, text_buffers
from .words import words

#: A block of 250,000 windows of the usual length is 9 MB, in the driver and in each task.
N, BLOCK_WINDOWS, ITEM_WINDOWS = 10, 250_000, 20_000
_BITS = 20


class Block:
    """Windows of some items: for each length their hashes in order, whose item each is of, and its place in the items' words."""

    def __init__(self, rows: list[dict]):
        self.items = [r["item"] for r in rows]
        base = np.cumsum([0, *(len(r["words"]) for r in rows)])
        self.words, self.by = b"".join(bytes(r["words"]) for r in rows), {}
        for n in sorted({r["n"] for r in rows}):
            own = [k for k, r in enumerate(rows) if r["n"] == n]
            h = np.concatenate([np.array(rows[k]["h"], np.int64) for k in own]).view(np.uint64)
            order = np.argsort(h, kind="stable")
            size = [len(rows[k]["h"]) for k in own]
            place = lambda c: (np.concatenate([np.array(rows[k][c], np.int64) for k in own]) + np.repeat(base[own], size))[order]  # noqa: B023, E731
            self.by[n] = h[order], np.repeat(own, size)[order].astype(np.int32), place("first"), place("end")

    def known(self, n: int, h: int, text: bytes) -> list[str]:
        """The items that have a window of these words."""
        hashes, item, first, end = self.by[n]
        a = int(np.searchsorted(hashes, np.uint64(h)))
        out = []
        while a < len(hashes) and int(hashes[a]) == h:
            if self.words[first[a] : end[a]] == text:
                out.append(self.items[item[a]])
            a += 1
        return out


def windows(benchmark: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """(item, n, words, h, first, end): an item's words in a row, and of each window its hash and place; items are divided after ITEM_WINDOWS."""

    def run(batches):
        for b in batches:
            for item, text in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                w = words(data, np.array([0, len(data)]))
                if not len(w.hash):
                    continue
                length = min(n, len(w.hash))
                h, at = w.windows(length)
                size = w.end - w.start
                place = np.cumsum(size + 1) - size - 1
                for i in range(0, len(h), ITEM_WINDOWS):
                    own = at[i : i + ITEM_WINDOWS]
                    low, high = int(own[0]), int(own[-1]) + length
                    first = place[own] - place[low]
                    end = place[own + length - 1] + size[own + length - 1] - place[low]
                    columns = [[item or ""], [length], [w.text(low, high - low)], [h[i : i + ITEM_WINDOWS].view(np.int64)], [first], [end]]
                    kinds = (pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "n", "words", "h", "first", "end"])

    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, n int, words binary, h array<long>, first array<long>, end array<long>")


class Scanner:
    def __init__(self, block: Block):
        self.block, self.sieve = block, {}
        for n, (h, *_) in block.by.items():
            self.sieve[n] = np.zeros(1 << _BITS, dtype=bool)
            self.sieve[n][h >> np.uint64(64 - _BITS)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """For each row: words, runs of hit words as (first, end, first byte, end byte), items."""
        w = words(data, offsets)
        hit, items = np.zeros(len(w.hash) + 1, np.int32), defaultdict(set)
        for n, sieve in self.sieve.items():
            h, at = w.windows(n)
            near = np.flatnonzero(sieve[h >> np.uint64(64 - _BITS)])
            mine = self.block.by[n][0]
            for k in near[mine[np.minimum(mine.searchsorted(h[near]), len(mine) - 1)] == h[near]]:
                if own := self.block.known(n, int(h[k]), w.text(a := int(at[k]), n)):
                    hit[a] += 1
                    hit[a + n] -= 1
                    items[int(w.row[a])].update(own)
        mask = np.cumsum(hit[:-1]) > 0
        runs = defaultdict(list)
        if mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            base = offsets[:-1] - offsets[0]
            first = np.searchsorted(w.row, np.arange(w.n_rows))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                while a < b:  # a run of hits ends where its row ends
                    row = int(w.row[a])
                    stop = min(int(b), int(np.searchsorted(w.row, row, side="right")))
                    runs[row].append((int(a - first[row]), int(stop - first[row]), int(w.start[a] - base[row]), int(w.end[stop - 1] - base[row])))
                    a = stop
        return w.counts(), runs, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, block_windows: int):
    """Blocks of bounded size; the windows are made in tasks, and come one partition at a time, never all at once."""
    rows, size = [], 0
    for r in windows(benchmark, id_col, text_col, n).toLocalIterator():
        rows.append(r.asDict())
        size += len(rows[-1]["h"])
        if size >= block_windows:
            yield Block(rows)
            rows, size = [], 0
    yield Block(rows)


_SPAN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("first", "end", "first_byte", "end_byte")]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_ARROW_SPAN = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "end", "first_byte", "end_byte")]))


def merged(spans: list[dict | tuple]) -> list[tuple]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for s in sorted(tuple(s.values()) if isinstance(s, dict) else s for s in spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def _scan(docs: DataFrame, text_col: str, block: Block, schema: T.StructType, result) -> DataFrame:
    """docs through result(batch, words of each row, spans, items) in tasks that have the block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        scanner = Scanner(sent.value)
        for b in batches:
            data, offsets = text_buffers(b.column(b.schema.get_field_index(text_col)))
            count, spans, items = [np.zeros(0, np.int64)], [], []
            for i, j in chunks(offsets):
                c, runs, found = scanner.scan(data, offsets[i : j + 1])
                count.append(c)
                spans += [runs.get(k, []) for k in range(j - i)]
                items += [found.get(k, ()) for k in range(j - i)]
            yield result(b, np.concatenate(count), spans, items)

    return docs.mapInArrow(run, schema)


def _span_array(spans) -> pa.Array:
    return pa.array([[dict(zip(("first", "end", "first_byte", "end_byte"), s, strict=True)) for s in x] for x in spans], _ARROW_SPAN)


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS, drop: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_words, hit_spans (of words and bytes, in the text's UTF-8) and hit_items; drop: docs as they are, without rows that have a hit.
    keep_text=False: without text_col.

    Null text has no words and no hit. Items without words have no window; a null item_id counts as ''. An empty benchmark
    hits nothing. Input columns named like the new ones are replaced. For a benchmark of several blocks docs are written once with
    a row number; each further block is one scan of the texts that gives the hits alone, and these meet by that number.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = _blocks(benchmark, item_id, item_text, n, block_windows)
    block, more = next(blocks), next(blocks, None)
    several = more is not None
    if several:
        docs = stage_table(docs.withColumn("_wg_rid", F.monotonically_increasing_id()), "hits-docs")
    full = schema_with(docs, FIELDS)
    if drop and not several:
        return _scan(docs, text_col, block, docs.schema, lambda b, count, spans, items: b.filter(pa.array([not x for x in spans], pa.bool_())))
    if not keep_text:
        full = T.StructType([f for f in full.fields if f.name != text_col])
    names = full.names

    def with_hits(b, count, spans, items):
        new = {"n_words": pa.array(count), "hit_spans": _span_array(spans), "hit_items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        return append(b, new).select(names)

    out = _scan(docs, text_col, block, full, with_hits)
    if not several:
        return out

    def hits_only(b, count, spans, items):
        at = [k for k, x in enumerate(spans) if x]
        columns = [b.column(b.schema.get_field_index("_wg_rid")).take(pa.array(at, pa.int64())), _span_array([spans[k] for k in at]), pa.array([sorted(items[k]) for k in at], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["_wg_rid", "s", "i"])

    only = T.StructType([T.StructField("_wg_rid", T.LongType()), T.StructField("s", _SPAN), T.StructField("i", T.ArrayType(T.StringType()))])
    texts, found = docs.select("_wg_rid", text_col), None
    while more is not None:
        hits = stage_table(_scan(texts, text_col, more, only, hits_only), "hits")
        found, more = hits if found is None else found.unionByName(hits), next(blocks, None)
    found = found.groupBy("_wg_rid").agg(F.flatten(F.collect_list("s")).alias("_wg_s"), F.flatten(F.collect_list("i")).alias("_wg_i"))  # a row for each block
    both = out.join(found, "_wg_rid", "left")
    if drop:
        clean = both.where(F.col("_wg_s").isNull() & (F.size("hit_spans") == 0)).select("_wg_rid")
        return docs.join(clean, "_wg_rid", "left_semi").drop("_wg_rid")
    merge = F.pandas_udf(lambda s: s.map(lambda x: [dict(zip(("first", "end", "first_byte", "end_byte"), r, strict=True)) for r in merged(list(x))]), _SPAN)
    hit = F.col("_wg_s").isNotNull()
    spans = F.when(hit, merge(F.concat("hit_spans", F.coalesce("_wg_s", F.array().cast(_SPAN))))).otherwise(F.col("hit_spans"))
    items = F.when(hit, F.array_sort(F.array_distinct(F.concat("hit_items", "_wg_i")))).otherwise(F.col("hit_items"))
    return both.withColumn("hit_spans", spans).withColumn("hit_items", items).select(*[x for x in names if x != "_wg_rid"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    hits = find_hits(rows, benchmark, n=n, block_windows=block_windows, keep_text=False)
    n_hit = F.coalesce(F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.end - s.first)"), F.lit(0).cast("long"))
    items = F.sort_array("hit_items")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = N) -> DataFrame:
    """docs with the hit words, and what lies between them, cut out of text_col; clean texts stay as they are."""
    names = docs.columns
    hits = find_hits(docs, benchmark, text_col=text_col, n=n)

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            raw, at, out = t.encode(), 0, []
            for x in s:
                out.append(raw[at : x["first_byte"]])
                at = x["end_byte"]
            return b"".join([*out, raw[at:]]).decode()

        return text.combine(spans, one)

    return hits.withColumn(text_col, cut(text_col, "hit_spans")).select(*names)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
