"""MinHash near-dedup of documents by ProbMinHash on weighted shingles.

A shingle is five consecutive words (all words of a shorter text), its weight how often it occurs. Each shingle is a Poisson
process of that rate whose arrivals fall on random components of the signature; a component keeps the shingle that arrives
first, and a process ends once its time is past the last of all components' first arrivals. Two signatures agree in a component
with the texts' probability Jaccard similarity JP, which is plain Jaccard where all weights are one.

Texts of the same words are one node. Nodes that share a band are candidates; linking.py computes JP from the texts, decides all
pairs of a band's bucket without making them, and forms the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, small, stage_table, text_buffers
from .linking import buckets, link, sketches
from .words import WORD_P, Words, mix, powers, words

SHINGLE, THRESHOLD = 5, 0.8
#: At JP 0.8, 28 bands of 6 miss a pair with probability 2e-4; at 0.3 they propose 2 % of pairs.
BANDS, ROWS = 28, 6
_U = np.uint64
_SEED = _U(0x5851F42D4C957F2D)


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (row, hash, weight), in order of row and hash."""
    h, at = w.windows(n)
    row = w.row[at]
    counts = w.counts()
    if len(short := np.flatnonzero((counts > 0) & (counts < n))):
        first = np.cumsum(counts) - counts
        more = np.array([mix(np.add.reduce(w.hash[first[r] : first[r] + counts[r]] * powers(WORD_P, n)[counts[r] - 1 :: -1][: counts[r]], keepdims=True))[0] for r in short], dtype=_U)
        row, h = np.concatenate([row, short]), np.concatenate([h, more])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    edges = np.searchsorted(row, np.arange(w.n_rows + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        h[a:b].sort()
    if not len(h):
        return row, h, np.zeros(0)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures [n_rows, m] of the elements that arrive first; rows without elements are 0."""
    time, z = np.full(n_rows * m, np.inf), np.zeros(n_rows * m, dtype=_U)
    last = np.full(n_rows, np.inf)
    x, t = np.zeros(len(row)), 0
    while len(row):
        t += 1
        r = mix(element + _U(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log1p(-((r >> _U(11)) * 2.0**-53)) / weight
        k = row * m + (((mix(r ^ _SEED) >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        np.minimum.at(time, k, x)
        won = time[k] == x
        z[k[won]] = element[won]
        alive = np.unique(row)
        last[alive] = time.reshape(n_rows, m)[alive].max(axis=1)
        on = x < last[row]
        row, element, weight, x = row[on], element[on], weight[on], x[on]
    return z.reshape(n_rows, m)


def band_keys(z: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n, bands] keys, a different one for each band."""
    z = z.reshape(len(z), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _SEED, z.shape[:2]).copy()
    for j in range(rows):
        out = mix(out ^ z[:, :, j])
    return out


def sequence_hash(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's sequence of words; 0 without words."""
    counts = w.counts()
    out = (np.zeros(w.n_rows, _U), np.zeros(w.n_rows, _U))
    if len(w.hash):
        first = np.cumsum(counts) - counts
        place = np.arange(len(w.hash)) - first[w.row]
        full = np.flatnonzero(counts)
        for o, p in zip(out, (WORD_P, _SEED | _U(1)), strict=True):
            o[full] = mix(np.add.reduceat(mix(w.hash ^ p) * powers(p, int(counts.max()))[place], first[full]) + counts[full].astype(_U))
    return out


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """JP of two weighted sets, elements sorted: sum over common d of 1 / sum over d' of max(wa[d'] / wa[d], wb[d'] / wb[d])."""
    if not len(ha) or not len(hb):
        return 0.0
    place = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[place] == ha
    if not both.any():
        return 0.0
    ca, cb = wa[both], wb[place[both]]
    only_a, only_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    order = np.argsort(ca / cb, kind="stable")
    ca, cb = ca[order], cb[order]
    up, down = only_a + np.cumsum(ca[::-1])[::-1], only_b + np.cumsum(cb) - cb
    return float((1 / (up / ca + down / cb)).sum())


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """docs (doc_id, text, th) -> doc_id, th, s1, s2, n_words, sketch, bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            s1, s2, n, keys, sketch = [], [], [], [], []
            for i, j in chunks(offsets):
                w = words(data, offsets[i : j + 1])
                p, q = sequence_hash(w)
                s1.append(p)
                s2.append(q)
                n.append(w.counts())
                z = prob_min_hash(*shingles(w), w.n_rows, bands * rows)
                sketch.append(sketches(z))
                keys.append(band_keys(z, bands, rows))
            if not n:
                continue
            count = np.concatenate(n)
            flat = np.concatenate(keys)[count > 0].ravel().view(np.int64)
            ends = np.concatenate(([0], np.cumsum(count > 0) * bands))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(s1).view(np.int64)), pa.array(np.concatenate(s2).view(np.int64)), pa.array(count), pa.array(np.concatenate(sketch)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "th", "s1", "s2", "n_words", "sketch", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, s1 long, s2 long, n_words long, sketch long, bands array<long>")


def weighted_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, sorted, and their weights."""
    raw = [t.encode() for t in texts]
    row, h, weight = shingles(words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    cut = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    return [(h[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def weighted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    return weighted_sets([text])[0]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, th (xxhash64 of the text), class_id (least doc_id of the class), class_size, n_words, kept.

    Classes are the components of the candidate pairs with JP >= threshold. A text without words (null, empty) is alone. Null
    doc_ids come last in a class. Rows that repeat a class's least doc_id and its text are all marked kept.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sig = stage_table(_signatures(plain, bands, rows), "near-signatures")
    full = sig.where("n_words > 0")
    first = full.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    nodes = stage_table(first.select("s1", "s2", F.col("k.doc_id").alias("doc_id"), F.col("k.th").alias("th"), F.monotonically_increasing_id().alias("nid")), "near-nodes")
    own = full.select("doc_id", "th", "s1", "s2", "sketch", "bands").join(nodes.select("nid", "s1", "s2", F.col("doc_id").alias("d"), F.col("th").alias("h")), ["s1", "s2"])
    own = own.where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("nid", "sketch", "bands")
    members = buckets(stage_table(own, "near-bands"), "near")

    wanted = stage_table(members.select("nid", "sketch").distinct().join(nodes.select("nid", "doc_id", "th"), "nid"), "near-wanted")
    n = wanted.count()
    some = small(wanted.select("nid", "sketch", F.col("doc_id").alias("d"), F.col("th").alias("h")), n)
    texts = stage_table(plain.join(some, (plain["th"] == some["h"]) & plain["doc_id"].eqNullSafe(some["d"])).select("nid", "text", "sketch"), "near-texts")
    if texts.count() > n:  # rows that repeat an id and its text
        texts = stage_table(texts.dropDuplicates(["nid"]), "near-texts")
    known = link(members, texts, weighted_sets, probability_jaccard, threshold)
    by_node = nodes.select("s1", "s2", "nid").join(known, "nid", "left").select("s1", "s2", F.coalesce("root", "nid").alias("root"))
    each = stage_table(full.select("doc_id", "th", "s1", "s2", "n_words").join(by_node, ["s1", "s2"]).select("doc_id", "th", "n_words", "root"), "near-rows")
    best = each.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    each = each.join(best, "root").select("doc_id", "th", F.col("k.doc_id").alias("class_id"), "class_size", "n_words", (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))).alias("kept"))
    alone = sig.where("n_words = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_words", F.lit(True).alias("kept"))
    return each.union(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, all columns; of rows that repeat it in id and text, all that are equal stay."""
    found = stage_table(near_classes(docs, id_col, text_col, threshold), "near-classes")
    gone = found.where("not kept").select(F.col("doc_id").alias("_wg_d"), F.col("th").alias("_wg_t")).distinct()
    gone = small(gone, found.where("not kept").count())
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_wg_d"]) & (th == gone["_wg_t"]), "left_anti")
