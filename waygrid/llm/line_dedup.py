"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find, one line per component.

A line is compared in lower case with runs of white space made one space; blank lines are none. A shingle is five characters
(a shorter line is one shingle). Signatures are one-permutation MinHash: each shingle is hashed once, its hash picks the bin and
the value, and empty bins copy from others by a fixed chain of hashes. A line of few shingles fills too few bins for that, and would
agree with many lines that share a shingle; it has a MinHash with a hash function for each place instead. Lines between, which can
be similar to either kind, have both. Lines that share a band are candidates; linking.py computes the Jaccard similarity of their
shingle sets from the texts and forms the components.

A line is known by a 64-bit hash of its characters in order; a second one, of its shingles, tells apart lines whose first collides:
of such, that of the least second hash takes part in fuzzy links and each other is a component of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, small, stage_table
from .linking import buckets, link, sketches
from .words import mix, powers

SHINGLE, THRESHOLD = 5, 0.8
#: At Jaccard 0.8, 16 bands of 5 miss a pair with probability 2e-3, at 0.85 with 8e-5; at 0.1 they propose 2e-4 of pairs.
BANDS, ROWS = 16, 5
#: Distinct shingles from which on a line has one-permutation bands, and below which it has bands of independent hashes.
BINS_FROM, HASHES_BELOW = 24, 30
#: Bins that a line has filled at least if its signature makes a sketch: with fewer, too many places are copies of others.
SKETCH_BINS = 48
#: Lines whose signature a task need not compute again.
SEEN = 200_000
#: Characters handled at once: their arrays stay in the cache.
CHUNK_CHARS = 1 << 18
#: Hashes of independent places made at once.
PLACE_HASHES = 1 << 15
_U = np.uint64
#: Fills up lines of fewer characters than a shingle; no character.
_PAD = "\U0010ffff"
#: In a bin without a shingle.
_NONE = np.uint32(0xFFFFFFFF)
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def normalised_lines(text: str) -> list[str]:
    """normalised() of each line. A text without odd white space, which is most, is lower-cased as a whole."""
    low = text.lower()
    if "  " in low or " \n" in low or "\n " in low or low[:1] == " " or low[-1:] == " " or not low.replace("\n", "").isprintable():
        return [normalised(x) for x in text.split("\n")]
    return low.split("\n")


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and where each begins."""
    ends = np.cumsum([0, *map(len, lines)])
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1), ends


_POWERS: dict[int, np.ndarray] = {}


def _powers(p: np.uint64, n: int) -> np.ndarray:
    if int(p) not in _POWERS or len(_POWERS[int(p)]) < n:
        _POWERS[int(p)] = powers(p, max(n, 1 << 22))
    return _POWERS[int(p)][:n]


def line_hashes(codes: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each line; no line is empty. One run of powers serves all lines, taken back by the inverse power at each start."""
    inverse = _U(pow(int(_P), -1, 1 << 64))
    sums = np.add.reduceat(codes * _powers(_P, len(codes)), ends[:-1])
    return mix(sums * _powers(inverse, int(ends[-1]) + 1)[ends[:-1]] + size.astype(_U))


def shingle_hashes(codes: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle, repeats included, in the order of lines. A line of fewer than n characters is one shingle."""
    size = np.diff(ends)
    short = np.flatnonzero(size < n)
    if len(short):  # lengthened by zeros, which no character is
        longer = np.maximum(size, n)
        at = np.cumsum(longer) - longer
        wide = np.zeros(int(longer.sum()), _U)
        wide[np.arange(len(codes)) + np.repeat(at - ends[:-1], size)] = codes
        codes, ends, size = wide, np.concatenate([at, [len(wide)]]), longer
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = codes[:m] + _U(0)
    for j in range(1, n):
        h *= _P
        h += codes[j : j + m]
    inside = np.ones(m, bool)
    for k in range(1, n):
        inside[ends[1:-1] - k] = False
    return np.repeat(np.arange(len(size)), size - n + 1), mix(h[inside])


def window_hashes(codes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of n consecutive characters, from each character on; arithmetic of this width is the fastest."""
    m = len(codes) - n + 1
    h = codes[:m].copy()
    for j in range(1, n):
        h *= np.uint32(0x9E3779B1)
        h += codes[j : j + m]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


_SOURCES: dict[tuple[int, int], np.ndarray] = {}


def _sources(m: int, t: int) -> np.ndarray:
    """The bin that each of m empty bins copies from at its attempt t."""
    if (m, t) not in _SOURCES:
        b = np.arange(m, dtype=_U)
        _SOURCES[m, t] = (((mix(b * _P + _U(t)) >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    return _SOURCES[m, t]


def signatures(line: np.ndarray, h: np.ndarray, inside: np.ndarray, n_lines: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash [n_lines, m], and how many bins have a shingle; the others have _NONE.

    The upper half of a hash picks the bin, its rotation is the value. Hashes that are not inside a line do not count.
    """
    z = np.full(n_lines * m, _NONE, dtype=np.uint32)
    at = line * m
    at += ((h >> np.uint32(16)) * np.uint32(m)) >> np.uint32(16)
    value = (h << np.uint32(16) | h >> np.uint32(16)) & np.uint32(0x7FFFFFFF)
    value[~inside] = _NONE
    np.minimum.at(z, at, value)
    z = z.reshape(n_lines, m)
    return z, (z != _NONE).sum(axis=1)


def densified(z: np.ndarray) -> np.ndarray:
    """Signatures with the bins without a shingle filled from others. Each has a bin with one; the fewer it has, the longer this takes."""
    m = z.shape[1]
    start, place = np.nonzero(z == _NONE)
    start *= m
    full, z, t = z.ravel().copy(), z.ravel(), 0
    while len(place):
        t += 1
        v = z[start + _sources(m, t)[place]]
        full[start + place] = v
        left = v == _NONE
        start, place = start[left], place[left]
    return full.reshape(-1, m)


def independent_signatures(line: np.ndarray, h: np.ndarray, n_lines: int, m: int) -> np.ndarray:
    """MinHash [n_lines, m] with a hash function for each place. line: in order, every line has a shingle."""
    first = np.searchsorted(line, np.arange(n_lines))
    out, seeds, h = np.empty((n_lines, m), np.uint32), np.arange(1, m + 1, dtype=_U) * _P, h.astype(_U)
    step = max(1, PLACE_HASHES // max(1, len(h)))
    for j in range(0, m, step):
        out[:, j : j + step] = np.minimum.reduceat((mix(h ^ seeds[j : j + step, None]) >> _U(32)).astype(np.uint32), first, axis=1).T
    return out


def band_keys(z: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    z = z.reshape(len(z), bands, rows)
    out = np.broadcast_to(np.arange(seed, bands + seed, dtype=_U) * _Q, z.shape[:2]).copy()
    for j in range(rows):
        out = mix(out ^ z[:, :, j].astype(_U))
    return out


def signed(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """Of normalised lines: h1, h2; the band keys of all in a row, and how many each has; their sketches, and which lines have one.

    Lines of BINS_FROM distinct shingles or more have one-permutation bands, lines of fewer than HASHES_BELOW independent ones. As
    HASHES_BELOW * 0.8 is BINS_FROM, similar lines of which one has only one kind both have that kind.
    """
    n, size = len(texts), np.array([len(t) for t in texts])
    codes = np.frombuffer("".join([t if len(t) >= SHINGLE else t.ljust(SHINGLE, _PAD) for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = np.maximum(size, SHINGLE)
    ends = np.append(0, np.cumsum(wide))
    h1 = line_hashes(codes.astype(_U) + _U(1), ends, size)
    h, line = window_hashes(codes), np.repeat(np.arange(n), wide)[: len(codes) - SHINGLE + 1]
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[ends[1:-1] - k] = False
    h2 = np.add.reduceat(np.where(inside, h, np.uint32(0)), ends[:-1], dtype=_U)
    z, filled = signatures(line, h, inside, n, bands * rows)
    few = filled < HASHES_BELOW  # only these can have so few shingles
    distinct = np.full(n, HASHES_BELOW)
    if few.any():
        own = few[line] & inside
        v = line[own].astype(_U) << _U(32) | h[own]
        v.sort()
        distinct[few] = np.bincount((v[np.append(True, v[1:] != v[:-1])] >> _U(32)).astype(np.int64), minlength=n)[few]
    binned, hashed = distinct >= BINS_FROM, distinct < HASHES_BELOW
    z, sketch = densified(z[binned]), np.zeros(n, np.int64)
    sketch[binned], sketched = sketches(z), filled >= SKETCH_BINS  # which are binned
    count = (binned.astype(np.int64) + hashed) * bands
    out = np.empty(int(count.sum()), np.uint64)
    at = np.cumsum(count) - count
    out[(at[binned, None] + np.arange(bands)).ravel()] = band_keys(z, bands, rows).ravel()
    if hashed.any():
        own = hashed[line] & inside
        z = independent_signatures((np.cumsum(hashed) - 1)[line[own]], h[own], int(hashed.sum()), bands * rows)
        out[(at[hashed, None] + np.arange(bands) + (count[hashed, None] - bands)).ravel()] = band_keys(z, bands, rows, bands + 1).ravel()
    return h1, h2, out, count, sketch, sketched


def shingle_sets(texts: list[str]) -> list[tuple[np.ndarray]]:
    """The distinct shingles of each line, sorted."""
    texts = [normalised(t) for t in texts]
    full = [t for t in texts if t]
    if not full:
        return [(np.zeros(0, _U),) for _ in texts]
    line, h = shingle_hashes(*_codes(full))
    cut = np.searchsorted(line, np.arange(len(full) + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[a:b].sort()
    other = np.append(True, h[1:] != h[:-1])
    other[cut[:-1]] = True
    ends, h = np.append(0, np.cumsum(other))[cut].tolist(), h[other]
    sets = iter([h[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return [(next(sets) if t else np.zeros(0, _U),) for t in texts]


def shingle_set(text: str) -> tuple[np.ndarray]:
    return shingle_sets([text])[0]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b.take(b.searchsorted(a), mode="clip") == a))
    return both / (len(a) + len(b) - both)


def _lines(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """docs (doc_id, text, th) -> doc_id, th, lines (line_no, h1, h2), fresh (h1, sketch, bands) of the lines that the task has not had before."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    line_type = pa.struct([("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        seen: set[int] = set()

        def made(texts):
            """h1, h2, which lines are fresh; of these the keys, how many each has, sketches, and which have one."""
            h1, h2, keys, count, sketch, sketched = signed(texts, bands, rows)
            if len(seen) > SEEN:
                seen.clear()
            new = np.zeros(len(texts), bool)
            for k, known in enumerate(h1.tolist()):
                if known not in seen:
                    seen.add(known)
                    new[k] = True
            return h1, h2, new, keys[np.repeat(new, count)], count[new], sketch[new], sketched[new]

        nothing = (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for b in batches:
            texts, own, numbers, size, parts = [], [0], [], 0, []
            for t in b.column(1).to_pylist():
                full = normalised_lines(t)
                if "" in full:
                    numbers += [n for n, x in enumerate(full) if x]
                    full = [x for x in full if x]
                else:
                    numbers += range(len(full))
                own.append(len(full))
                for part in [full] if len(t) <= CHUNK_CHARS else ([x] for x in full):
                    texts += part
                    size += sum(map(len, part))
                    if size > CHUNK_CHARS:
                        parts.append(made(texts))
                        texts, size = [], 0
            if texts:
                parts.append(made(texts))
            h1, h2, new, keys, count, sketch, sketched = (np.concatenate(x) for x in zip(*(parts or [nothing]), strict=True))
            ends = np.cumsum(own)
            fresh_ends = pa.array(np.append(0, np.cumsum(new))[ends], pa.int32())
            ends = pa.array(ends, pa.int32())
            lines = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], fields=list(line_type))
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(keys.view(np.int64)))
            fresh = pa.StructArray.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(sketch, pa.int64(), mask=~sketched), listed], names=["h1", "sketch", "bands"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(ends, lines), pa.ListArray.from_arrays(fresh_ends, fresh)], names=["doc_id", "th", "lines", "fresh"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, lines array<struct<line_no:int,h1:long,h2:long>>, fresh array<struct<h1:long,sketch:long,bands:array<long>>>")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, lines, fresh, rid) of each row, rid its number; (rid, line_no, first_doc, first_line) of the lines that are not kept."""
    spark = docs.sparkSession
    ship(spark)
    s = Scratch(spark)
    plain = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    read = stage_table(_lines(plain, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "lines")
    banded = read.select(F.explode("fresh").alias("f")).select(F.col("f.h1").alias("nid"), "f.sketch", "f.bands")
    members = buckets(banded, "line")
    s.made.append(members)

    each = read.select("rid", "doc_id", "th", F.explode("lines").alias("l")).select("rid", "doc_id", "th", "l.line_no", "l.h1", "l.h2")
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "th")
    lines = s(each.groupBy("h1").agg(F.min(where).alias("k"), F.count(F.lit(1)).alias("n"), F.min("h2").alias("h2"), F.max("h2").alias("x")), "line-distinct")
    odd = s(lines.where("h2 != x").select("h1", F.col("h2").alias("m")), "line-collisions")
    apart = s(each.join(small(odd, odd.count()), "h1").groupBy("h1", "h2", "m").agg(F.min(where).alias("k"), F.count(F.lit(1)).alias("n")), "line-apart")
    lines = lines.where("h2 = x").select("h1", "h2", "k", "n", F.lit(True).alias("fuzzy")).unionByName(apart.select("h1", "h2", "k", "n", (F.col("h2") == F.col("m")).alias("fuzzy")))

    wanted = s(members.groupBy(F.col("nid").alias("h1")).agg(F.max("sketch").alias("sketch")), "line-nodes")
    firsts = lines.where("fuzzy").join(small(wanted, wanted.count()), "h1").groupBy(F.col("k.doc_id").alias("d"), F.col("k.th").alias("h")).agg(F.collect_list(F.struct("h1", "sketch", F.col("k.line_no").alias("n"))).alias("takes"))  # lines of one text
    firsts = s(firsts, "line-wanted")
    n = firsts.select(F.sum(F.size("takes"))).first()[0] or 0
    taken = plain.join(small(firsts, n), (plain["th"] == firsts["h"]) & plain["doc_id"].eqNullSafe(firsts["d"]))
    taken = taken.select("takes", F.split("text", "\n", -1).alias("all")).select(F.explode(F.expr("transform(takes, x -> struct(x.h1 as nid, x.sketch as sketch, all[x.n] as text))")).alias("r"))
    texts = s(taken.select("r.nid", "r.text", "r.sketch"), "line-texts")
    if texts.count() > n:  # rows that repeat an id and its text give a line twice
        texts = s(texts.dropDuplicates(["nid"]), "line-texts")
    roots = s(link(members, texts, shingle_sets, jaccard, threshold), "line-roots")

    near = lines.join(small(roots.select(F.col("nid").alias("h1"), "root", F.lit(True).alias("fuzzy")), roots.count()), ["h1", "fuzzy"], "left")
    near = s(near.where("root is not null or n > 1"), "line-repeated")
    best = s(near.where("root is not null").groupBy("root").agg(F.min("k").alias("b")), "line-best")
    first = near.join(small(best, best.count()), "root", "left").select("h1", "h2", F.coalesce("b", "k").alias("k"))
    first = s(first, "line-firsts")
    gone = each.join(small(first, first.count()), ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("line_no") == F.col("k.line_no")) & (F.col("th") == F.col("k.th"))))
    gone = stage_table(gone.select("rid", "line_no", F.col("k.doc_id").alias("first_doc"), F.col("k.line_no").alias("first_line")), "line-gone")
    s.drop()
    return read, gone


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for every line that is not blank: doc_id, th (xxhash64 of the text), line_no from 0, first_doc, first_line, kept.

    The first line of a component, by doc_id (null last) and line_no, is kept; the others name it. Null and empty texts have no
    lines. Of rows that repeat a doc_id and its text, both keep the line.
    """
    read, gone = _classes(docs, id_col, text_col, threshold, bands, rows)
    each = read.select("rid", "doc_id", "th", F.explode("lines.line_no").alias("line_no")).join(gone, ["rid", "line_no"], "left")
    kept = F.col("first_line").isNull()
    return each.select("doc_id", "th", "line_no", F.when(kept, F.col("doc_id")).otherwise(F.col("first_doc")).alias("first_doc"), F.coalesce("first_line", "line_no").alias("first_line"), kept.alias("kept"))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (not blank), n_dropped, dropped (line numbers in order).

    Rows that repeat a doc_id and its text have equal results.
    """
    read, gone = _classes(docs, id_col, text_col, threshold, bands, rows)
    by = gone.groupBy("rid").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))  # lines of one row
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return read.select("rid", "doc_id", F.size("lines").cast("long").alias("n_lines")).join(by, "rid", "left").select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the lines that are not kept taken out of text_col; all rows and columns stay."""
    gone = line_classes(docs, id_col, text_col, threshold).where("not kept").groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("_wg_gone"))
    gone = stage_table(gone.select(F.col("doc_id").alias("_wg_d"), F.col("th").alias("_wg_h"), "_wg_gone"), "line-dropped")
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_wg_d"]) & (th == gone["_wg_h"]), "left")
    left = F.array_join(F.filter(F.split(docs[text_col].cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col("_wg_gone"), i)), "\n")
    return out.select(*[F.when(F.col("_wg_gone").isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns])
