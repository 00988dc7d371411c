"""OpenStreetMap PBF: blobs to tables of nodes, ways and relations. A file's blobs are found by their length prefixes, read and decoded in tasks.

The wire format is the public one: a stream of (length, BlobHeader, Blob); a blob's primitive block holds a string table and groups
of dense nodes (deltas), plain nodes, ways and relations.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<type:string,ref:long,role:string>>"
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))])
_MEMBER = ("node", "way", "relation")


def varint(raw: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = raw[at]
        at += 1
        v |= (b & 0x7F) << shift
        if b < 0x80:
            return v, at
        shift += 7


def fields(raw: bytes):
    """(number, value) of a message: whole numbers, or bytes of length-delimited fields."""
    at, n = 0, len(raw)
    while at < n:
        key, at = varint(raw, at)
        if key & 7 == 0:
            v, at = varint(raw, at)
        elif key & 7 == 2:
            size, at = varint(raw, at)
            v, at = raw[at : at + size], at + size
        elif key & 7 == 1:
            v, at = struct.unpack_from("<q", raw, at)[0], at + 8
        elif key & 7 == 5:
            v, at = struct.unpack_from("<i", raw, at)[0], at + 4
        else:
            raise ValueError("a field of unknown kind")
        yield key >> 3, v


def packed(raw: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = varint(raw, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def running(deltas: list[int]) -> list[int]:
    out, total = [], 0
    for x in deltas:
        total += x
        out.append(total)
    return out


def blobs(raw: bytes):
    """(type, bytes) of each blob of a file, inflated; a file that breaks off is an error."""
    at = 0
    while at < len(raw):
        size = struct.unpack_from(">I", raw, at)[0]
        head = dict(fields(raw[at + 4 : at + 4 + size]))
        at += 4 + size
        body = raw[at : at + head[3]]
        if len(body) != head[3]:
            raise ValueError("a blob ends early")
        at += head[3]
        b = dict(fields(body))
        yield head[1].decode(), zlib.decompress(b[3]) if 3 in b else b[1]


def entities(block: bytes, kinds: frozenset[str] = frozenset(_MEMBER)):
    """Rows of one primitive block, in file order, of the kinds asked for."""
    table, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            table = [s.decode() for j, s in fields(v) if j == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k in (19, 20):
            lat0, lon0 = (v, lon0) if k == 19 else (lat0, v)
    place = lambda x, base: (base + granularity * x) * 1e-9
    tags_of = lambda f: list(zip((table[x] for x in packed(f.get(2, b""))), (table[x] for x in packed(f.get(3, b""))), strict=True))
    signed = lambda v: (v >> 1) ^ -(v & 1)
    for g in groups:
        for k, v in fields(g):
            if k > 4 or _MEMBER[max(k - 2, 0)] not in kinds:
                continue
            f = dict(fields(v))
            if k == 1:
                yield "node", signed(f[1]), place(signed(f[8]), lat0), place(signed(f[9]), lon0), tags_of(f), None, None
            elif k == 2:
                keys, at = packed(f.get(10, b"")), 0
                for i, la, lo in zip(running(packed(f[1], True)), running(packed(f[8], True)), running(packed(f[9], True)), strict=True):
                    tags = []
                    while at < len(keys) and keys[at]:
                        tags.append((table[keys[at]], table[keys[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, place(la, lat0), place(lo, lon0), tags, None, None
            elif k == 3:
                yield "way", f[1], None, None, tags_of(f), running(packed(f.get(8, b""), True)), None
            elif k == 4:
                parts = zip(packed(f.get(10, b"")), packed(f.get(8, b"")), running(packed(f.get(9, b""), True)), strict=True)
                yield "relation", f[1], None, None, tags_of(f), None, [{"type": _MEMBER[t], "ref": r, "role": table[s]} for t, s, r in parts]


def _open(uri: str):
    """A file of any file system, read by places."""
    local = re.match(r"file:/+(.*)", uri)
    system, at = fs.FileSystem.from_uri(f"/{local[1]}" if local else uri)
    return system.open_input_file(at)


def _by_value() -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, size, kind) of the blobs of all files of a path: only lengths and blob headers are read, whatever the files' size.

    A file that breaks off is an error.
    """
    _by_value()

    def run(batches):
        for b in batches:
            for uri, length in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True):
                out, at = [], 0
                with _open(uri) as f:
                    while at < length:
                        size = struct.unpack(">I", f.read_at(4, at))[0]
                        head = dict(fields(f.read_at(size, at + 4)))
                        at += 4 + size
                        if at + head[3] > length:
                            raise ValueError("a blob ends early")
                        out.append((uri, at, head[3], head[1].decode()))
                        at += head[3]
                        if len(out) == 4096:
                            yield batch(out)
                            out = []
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "offset", "size", "kind"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # no contents
    return files.repartition("path").mapInArrow(run, "file string, offset long, size long, kind string")


def read(spark: SparkSession, path: str, kinds: tuple[str, ...] = _MEMBER, tasks: int | None = None) -> DataFrame:
    """Entities of all files of a path, as ENTITY; groups of kinds that are not asked for are not decoded.

    The blobs of one file are dealt to many tasks, each of which holds one decoded blob at a time.
    """
    _by_value()
    wanted = frozenset(kinds)

    def run(batches):
        for b in batches:
            opened, f = None, None
            for uri, offset, size in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                if uri != opened:
                    f, opened = _open(uri), uri
                body = dict(fields(f.read_at(size, offset)))
                rows = list(entities(zlib.decompress(body[3]) if 3 in body else body[1], wanted))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_ARROW)], schema=_ARROW)

    blocks = index(spark, path).where("kind = 'OSMData'").select("file", "offset", "size")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartitionByRange(n, "file", "offset").mapInArrow(run, ENTITY)


def header(spark: SparkSession, path: str) -> DataFrame:
    """(file, left, right, top, bottom) in degrees, null where the header has no box."""
    _by_value()

    def run(batches):
        for b in batches:
            out = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = next((dict(fields(x)) for kind, x in blobs(raw) if kind == "OSMHeader"), {})
                box = dict(fields(h[1])) if 1 in h else {}
                out.append((name, *[((box[k] >> 1) ^ -(box[k] & 1)) * 1e-9 if k in box else None for k in (1, 2, 3, 4)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if not k else pa.float64()) for k in range(5)], names=["file", "left", "right", "top", "bottom"])

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(run, "file string, left double, right double, top double, bottom double")
