"""Byte-level BPE by a hierarchical-bitmap rank queue, over many pre-tokens at once.

The bytes of many pre-tokens lie in one linked list, cut at their borders. Every adjacent pair whose bytes are a token waits in the
bucket of that token's rank, as the position of its left part. A bitmap of three levels of 64-bit words marks the buckets in use, so
find-first-set gives the next rank in three steps whatever the length. All of a bucket's live positions are merged in one NumPy
step, of overlapping ones the leftmost; entries whose pair has changed since are stale and skipped. Pre-tokens do not touch each
other, so each is merged in the order it would be alone. Cost: a step for each rank in use, and O(n log n) for n bytes, so a
pre-token of megabytes is no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, schema_with, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that are encoded at once, and bytes of pre-tokens that are merged at once; one text or pre-token is not divided.
TEXT_BYTES, MERGE_BYTES = 8 << 20, 1 << 20
#: Pre-tokens whose ids a task remembers, none longer than KNOWN_CHARS.
KNOWN, KNOWN_CHARS = 200_000, 64


class RankQueue:
    """Positions in buckets by rank, under a bitmap of three levels: ranks below 64 ** 3."""

    def __init__(self, n: int):
        if n > 64**3:
            raise ValueError("at most 262,144 ranks")
        self.low, self.mid, self.top = [0] * ((n >> 6) + 1), [0] * ((n >> 12) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, ranks: list[int], at: list[int]) -> None:
        buckets = self.buckets
        for rank, k in zip(ranks, at, strict=True):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [k]
                self.mark(rank)
            else:
                bucket.append(k)

    def mark(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its bucket, which is emptied; -1 if none."""
        if not self.top:
            return -1, []
        i = (self.top & -self.top).bit_length() - 1
        x = self.mid[i]
        j = i << 6 | (x & -x).bit_length() - 1
        x = self.low[j]
        rank = j << 6 | (x & -x).bit_length() - 1
        self.low[j] = x = x & (x - 1)
        if not x:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        """raw: a rank file, a line each of base64 bytes and rank."""
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.bytes = {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.size = max(self.bytes) + 1
        self.none = self.size  # the token behind the last one
        pairs = [(x * (self.size + 1) + y, r) for b, r in ranks.items() for i in range(1, len(b)) if (x := ranks.get(b[:i])) is not None and (y := ranks.get(b[i:])) is not None]
        self.pairs, self.merged = np.array([*sorted(pairs), (1 << 62, -1)], np.int64).T.copy()
        self.byte = np.array([ranks.get(bytes((b,)), -1) for b in range(256)], np.int64)
        self.two = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int64)
        left, right = np.divmod(self.pairs[:-1], self.size + 1)
        #: Ranks of tokens that can be part of a pair of lower rank; their positions in one pre-token merge one by one.
        self.early = set(np.concatenate([left[self.merged[:-1] < left], right[self.merged[:-1] < right]]).tolist())

    def merge(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in a row, none empty, and how many each has. data: their bytes; first: where each begins."""
        n, wide, q = len(data), self.size + 1, RankQueue(self.size)
        token = np.append(self.byte[data], self.none)
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.append(first[1:], n) - 1], before[first] = n, -1
        alive = np.ones(n, bool)
        wait = np.full(n + 1, -1)  # the rank under which a position waits; other entries in buckets are stale
        wait[: n - 1] = self.two[data[:-1], data[1:]]
        wait[first[1:] - 1] = -1
        at = np.flatnonzero(wait >= 0)
        at = at[np.argsort(wait[at], kind="stable")]
        edge = np.flatnonzero(np.diff(wait[at], prepend=-1))
        for rank, own in zip(wait[at[edge]].tolist(), np.split(at, edge[1:]), strict=False):
            q.buckets[rank] = own.tolist()
            q.mark(rank)
        pairs, merged, early = self.pairs, self.merged, self.early
        rank, bucket = q.pop()
        while rank >= 0:
            at = np.array(bucket)
            at = at[wait[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                if rank in early:
                    mine = np.searchsorted(first, at, side="right")
                    now = np.diff(mine, prepend=0) > 0
                    if not now.all():
                        q.push([rank] * int((~now).sum()), at[~now].tolist())
                        at = at[now]
                else:
                    over = after[at[:-1]] == at[1:]
                    if over.any():  # of a run of overlapping pairs every second one merges
                        k = np.arange(len(at))
                        start = np.maximum.accumulate(np.where(np.append(False, over), 0, k))
                        at = at[(k - start) & 1 == 0]
            if len(at):
                gone = after[at]
                end = after[gone]
                after[at], before[end], wait[gone], token[at], alive[gone] = end, at, -1, rank, False
                left = before[at]
                both = np.concatenate((left, at))
                key = np.concatenate((token[left] * wide + rank, rank * wide + token[end]))
                place = pairs.searchsorted(key)
                new = np.where(pairs[place] == key, merged[place], -1)
                wait[both] = new
                hit = np.flatnonzero(new >= 0)
                if len(hit):
                    q.push(new[hit].tolist(), both[hit].tolist())
            rank, bucket = q.pop()
        return token[:n][alive].astype(np.int32), np.add.reduceat(alive, first, dtype=np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in a row, and how many each has."""
        ids, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        get, i = self.ranks.get, 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + len(pieces[j]) <= MERGE_BYTES):
                size += len(pieces[j])
                j += 1
            whole = np.array([get(p, -1) for p in pieces[i:j]], np.int32)
            parts = [p for p, w in zip(pieces[i:j], whole.tolist(), strict=True) if w < 0]
            n = np.ones(j - i, np.int64)
            if parts:
                own, n[whole < 0] = self.merge(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts[:-1])]))
                out = np.empty(int(n.sum()), np.int32)
                known = np.repeat(whole >= 0, n)
                out[known], out[~known] = whole[whole >= 0], own
            else:
                out = whole
            ids.append(out)
            count.append(n)
            i = j
        return np.concatenate(ids), np.concatenate(count)

    def encode(self, text: str) -> list[int]:
        return Encoder(self).many([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Numbers(dict):
    """Numbers of pre-tokens in the order in which they are first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes texts, remembering the ids of pre-tokens met before: KNOWN at most besides those of the texts at hand."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.end = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _numbers(self, text: str) -> np.ndarray:
        if len(text) <= TEXT_BYTES >> 4:
            return np.array(list(map(self.number.__getitem__, self.codec.pattern.findall(text))), np.int32)
        found, parts = (m[0] for m in self.codec.pattern.finditer(text)), []
        while part := list(map(self.number.__getitem__, islice(found, 1 << 18))):
            parts.append(np.array(part, np.int32))
        return np.concatenate(parts)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > KNOWN:
            self.forget()
        numbers = [self._numbers(t) for t in texts]
        new = list(islice(self.number, len(self.end) - 1, None))
        ids, count = self.codec.encode_pieces([p.encode() for p in new])
        self.ids, self.end = np.concatenate([self.ids, ids]), np.concatenate([self.end, self.end[-1] + np.cumsum(count)])
        size = np.diff(self.end)
        out = []
        for w in numbers:
            n = size[w]
            shift = self.end[w] - np.cumsum(n) + n
            out.append(self.ids[np.arange(int(n.sum())) + np.repeat(shift, n)])
        if any(len(p) > KNOWN_CHARS for p in new):
            self.forget()
        return out


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One for each worker and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def sender(df: DataFrame, path: str | None, pattern: str):
    """The rank file (its size is fixed by the vocabulary) to all workers; gives a function that makes the codec there."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(rank_file(path))
    return lambda: codec(sent.value, pattern)


def encoded(c: Codec, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with the ids of its rows' texts; null is ''. Batches of TEXT_BYTES together are encoded at once."""
    e = Encoder(c)

    def made(held):
        texts = [t or "" for b in held for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
        ids, at = e.many(texts), 0
        for b in held:
            yield b, ids[at : at + b.num_rows]
            at += b.num_rows

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(text_col)).nbytes
        if size >= TEXT_BYTES:
            yield from made(held)
            held, size = [], 0
    yield from made(held)


def lists(ids: list[np.ndarray]) -> pa.Array:
    ends = pa.array([0, *accumulate(map(len, ids))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ids array<int>; null and empty texts have no ids. An input column ids is replaced. Special tokens are plain text."""
    make, schema = sender(docs, path, pattern), schema_with(docs, [IDS])

    def run(batches):
        for b, ids in encoded(make(), batches, text_col):
            yield append(b, {"ids": lists(ids)})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with decoded binary; null ids are no bytes. An id outside the vocabulary is an error."""
    make = sender(encoded, path, public_tokenizers.PATTERN)
    schema = schema_with(encoded, [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        c = make()
        for b in batches:
            yield append(b, {"decoded": pa.array([c.decode(x or ()) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()], pa.binary())})

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    Encoding and decoding in one pass, so the ids need not leave the worker; keep_ids: they do, as a column ids array<int>.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    make = sender(docs, path, pattern)
    schema = T.StructType([rows.schema["doc_id"], *DIGEST, *[IDS] * keep_ids])

    def run(batches):
        c = make()
        text = [str(i) for i in range(c.size)].__getitem__
        for b, ids in encoded(c, batches, "text"):
            n, x, y = [], [], []
            for own in ids:
                own = own.tolist()
                n.append(len(own))
                x.append(hashlib.sha256(" ".join(map(text, own)).encode()).hexdigest())
                y.append(hashlib.sha256(c.decode(own)).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[lists(ids)] * keep_ids], names=schema.names)

    return rows.mapInArrow(run, schema)
