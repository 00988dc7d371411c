"""WARC archives: monolithic gzip files made into one gzip member per record, with a sidecar offset index.

write_archives() makes what crawlers without per-record compression make: one gzip stream per file. normalise() inflates such a
stream once, rewrites each record as a member of its own and writes `<file>.idx`; read_records() then reads any record by offset.
A gzip stream can only be inflated from its start, so one file is one task's work; files are written by task and stay small.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import new_path, ship, small, stage_table

LEVEL, READ_BYTES = 4, 1 << 20
_END = b"\r\n\r\n"


def _header(*lines: str) -> bytes:
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def urn(page_id) -> str:
    """The name of a page's record; a null id has a name of its own."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record (the HTTP header alone) if refers_to is given."""
    http = _header("HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}")
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return _header(*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}") + block + _END


def fields(head: bytes) -> dict[str, str]:
    """Header lines by name in lower case; the first line is left out."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members; a truncated one is an error."""
    d, fresh = zlib.decompressobj(31), True
    for c in chunks:
        while c:
            fresh = False
            yield d.decompress(c, READ_BYTES)  # a small piece may inflate to very much
            c = d.unconsumed_tail
            if d.eof:
                c, d, fresh = d.unused_data, zlib.decompressobj(31), True
    while not fresh and (rest := d.decompress(b"", READ_BYTES)):
        yield rest
        fresh = d.eof
    if not fresh:
        raise ValueError("gzip stream ends early")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header with its blank line, block) of each record of an uncompressed stream, holding one record at a time."""
    buffer, at = bytearray(), 0
    source = iter(chunks)

    def more(n: int) -> bool:
        nonlocal at
        while len(buffer) - at < n:
            piece = next(source, None)
            if piece is None:
                return False
            del buffer[:at]
            at = 0
            buffer.extend(piece)
        return True

    while more(1):
        seen = 0
        while (end := buffer.find(_END, at + seen)) < 0:
            seen = max(0, len(buffer) - at - 3)
            if not more(len(buffer) - at + 1):
                raise ValueError("a record's header ends early")
        head = bytes(buffer[at : end + 4])
        length = int(fields(head)["content-length"])
        if not more(len(head) + length + 4):
            raise ValueError("a record ends early")
        block = bytes(buffer[at + len(head) : at + len(head) + length])
        if buffer[at + len(head) + length : at + len(head) + length + 4] != _END:
            raise ValueError("a record's length is wrong")
        at += len(head) + length + 4
        yield head, block


def _read(uri: str) -> Iterator[bytes]:
    with files.open_input(uri) as f:
        while piece := f.read(READ_BYTES):
            yield piece


def tasks(n: int) -> int:
    """Tasks for n files: rows that name files are few bytes each, so their size says nothing of the work."""
    return max(1, min(n, 20_000))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One gzip stream for each task that has rows. pages: page_id, url, html, digest, refers_to. Gives (file)."""
    ship(pages.sparkSession)

    def run(batches):
        out, name = None, ""
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, z = f"{folder}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, wbits=31)
                    out = files.create(name)
                out.write(z.compress(record(r["page_id"], r["url"] or "", (r["html"] or "").encode(), r["digest"], r["refers_to"])))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives: (file), of any gzip layout. Gives the index (file, record_id, record_type, offset, length) of new files in folder.

    The same index lies beside each file, as lines of offset, length, type and record id in `<file>.idx`. A file that breaks off
    is an error.
    """
    ship(archives.sparkSession)

    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                name, at, index = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                with files.create(name) as out, files.create(f"{name}.idx") as side:
                    for head, block in records(inflate(_read(source))):
                        z = zlib.compressobj(LEVEL, wbits=31)
                        member = z.compress(head) + z.compress(block) + z.compress(_END) + z.flush()
                        out.write(member)
                        f = fields(head)
                        row = (at, len(member), f["warc-type"], f["warc-record-id"])
                        side.write(("\t".join(map(str, row)) + "\n").encode())
                        index.append(row)
                        at += len(member)
                        if len(index) >= 2000:
                            yield batch(name, index)
                            index = []
                yield batch(name, index)

    def batch(name, index):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(index), pa.string()), *(pa.array([x[k] for x in index], t) for k, t in ((3, pa.string()), (2, pa.string()), (0, pa.int64()), (1, pa.int64())))], names=["file", "record_id", "record_type", "offset", "length"])

    return archives.repartition(tasks(archives.count()), "file").mapInArrow(run, "file string, record_id string, record_type string, offset long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """The records at (file, offset, length): record_id, url, record_type, refers_to (record id), payload_bytes, payload_digest, payload.

    A payload that does not have its record's digest is an error; a revisit's payload is null, its size that of the full payload.
    """
    ship(index.sparkSession)

    def run(batches):
        for b in batches:
            out, opened, f = [], None, None
            for r in b.to_pylist():
                if opened != r["file"]:
                    f, opened = files.open_input(r["file"]), r["file"]
                (head, block), = records(inflate(iter([f.read_at(r["length"], r["offset"])])))
                h = fields(head)
                http, _, payload = block.partition(_END)
                digest, size, revisit = h["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"]), h["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{r['file']} at {r['offset']}: the payload does not match its digest")
                out.append((h["warc-record-id"], h["warc-target-uri"], h["warc-type"], h.get("warc-refers-to"), size, digest, None if revisit else payload))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return index.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def base32(hexed) -> F.Column:
    """Upper-case base32 of a column of 40 hex digits (20 bytes, so without padding): four letters for each five digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = lambda i: F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
    one = lambda n, k: F.substring(F.lit(letters), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[one(part(i), k) for i in range(8) for k in range(4)])


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of min_bytes or more, all but the smallest page_id revisit that one.

    Payloads of equal SHA-1 are equal if their SHA-256 is too. Null html is an empty payload. A null page_id is the largest; if all of a group are null, all are responses. Rows that repeat
    the smallest page_id are responses too.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("sha2", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha", "sha2").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stage_table(first, "warc-repeated")
    both = rows.join(small(first, first.count()), ["sha", "sha2"], "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return both.select("page_id", "url", "html", base32(F.hex("sha")).alias("digest"), refers.alias("refers_to"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes all pages as monolithic archives, normalises those, and reads every record back by its offset.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url. No pages give no files and no rows.
    """
    spark = pages.sparkSession
    archives = stage_table(write_archives(with_revisits(pages, id_col, url_col, html_col, min_bytes), new_path(spark, "warc-stream")), "warc-files")
    index = stage_table(normalise(archives, new_path(spark, "warc")), "warc-index")
    kind = pages.schema[id_col].dataType
    page = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.expr(f"substring({c}, 11, length({c}) - 11)"))).cast(kind)
    back = read_records(index.repartitionByRange(tasks(archives.count()), "file", "offset")).drop("payload")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "url")
