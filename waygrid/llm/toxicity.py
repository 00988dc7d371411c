"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings counts the subsequences of three letters that they share, each with LAMBDA for every letter that it
skips, over at most SPAN letters, normalised to 1 for equal strings; so a letter put in or a gap lowers it a little only. It is
sharpened to ((k - CUT) / (1 - CUT)) ** 2, and 0 below CUT, which keeps words that merely share a syllable apart. A sentence is a
bag of strings: its words, its words without the signs inside them (i.d.i.o.t, id*iot), and its runs of single letters as one
word (i d i o t). Its score is that of its worst string, a text's that of its worst sentence.

Training is multiple-instance: the labels are of whole texts, so sentences of clean texts have clean strings only, and sentences
of toxic texts have some toxic string. Witnesses are the strings that lean to toxic texts beyond chance, and those that explain
toxic texts which no witness yet explains. They, and they with a letter put in, are the positives, the strings of clean texts
the negatives. Strings become Nystroem features k(x, L) K(L, L)^-1/2 over the landmarks L: witnesses, and in ROUNDS rounds the
clean strings that score highest. On these a linear machine with squared hinge loss is solved by Newton steps. A sigmoid fitted
on the training texts gives the probability.

A string's score is a bias plus a sum over landmarks, but not less than the bias. So one that is not within CUT of any landmark of
positive weight scores the bias; an upper bound of its kernel values, from one table of letter triples, tells most of those.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, held_out, schema_with, ship, small, stage_table

LAMBDA, SPAN, LONGEST, CUT = 0.7, 6, 24, 0.4
WITNESSES, HARD, ROUNDS, COST = 300, 200, 3, 20.0
#: Standard deviations beyond chance for a witness; least number of toxic texts that one must newly explain otherwise.
LEAN, EXPLAINS = 5.0, 2
#: Training texts of each label at most, and characters of each at most; longer ones are not learned from.
SAMPLE, SAMPLE_CHARS = 2_500, 12_000
CACHE = 400_000
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_SIGNS = bytes(b for b in range(0x21, 0x80) if not chr(b).isalpha()) + bytes(range(0x09)) + bytes(range(0x0E, 0x20))
_SPACED = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b for b in range(256))
_SINGLE = re.compile(rb"(?<![a-z\x80-\xff])(?:[a-z][\x00-\x60\x7b-\x7f]{1,3}){2,}[a-z](?![a-z\x80-\xff])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.split(text) if x.strip()]


def strings(text: str) -> set[bytes]:
    """The strings of a sentence or of a whole text, lower-cased, in UTF-8."""
    raw = text.lower().encode()
    out = set(raw.translate(None, _SIGNS).split())
    out.update(raw.translate(_SPACED).split())
    for m in _SINGLE.findall(raw):
        out.add(re.sub(rb"[^a-z]", b"", m))
    return out


def pieces(string: bytes) -> list[str]:
    """'^string$'; a long one as overlapping windows of LONGEST letters, half of one apart, which have no marks inside."""
    s = f"^{string.decode()}$"
    return [s] if len(s) <= LONGEST else [s[i : i + LONGEST] for i in range(0, len(s) - LONGEST // 2, LONGEST // 2)]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places [3, m] of all triples in n letters, and their weights."""
    if n not in _TRIPLES:
        found = [(i, i + j, i + k) for i in range(n - 2) for j, k in combinations(range(1, SPAN), 2) if i + k < n]
        _TRIPLES[n] = np.array(found, np.int64).reshape(-1, 3).T, np.array([LAMBDA ** (k - i - 2) for i, _, k in found])
    return _TRIPLES[n]


def coded(texts: list[str]):
    """Yields (places in texts, triple codes [t, m], weights [m]) for the texts of one length at a time."""
    size = np.array([len(t) for t in texts])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        codes = np.frombuffer("".join([texts[k] for k in at]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(at), n)
        place, weight = triples(int(n))
        yield at, codes[:, place[0]] << 42 | codes[:, place[1]] << 21 | codes[:, place[2]], weight


def features(texts: list[str]):
    """As coded(), and the norms [t]."""
    for at, code, weight in coded(texts):
        if not len(weight):
            yield at, code, weight, np.ones(len(at))
            continue
        order = np.argsort(code, axis=1)
        ordered = np.take_along_axis(code, order, 1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
        row = np.broadcast_to(np.arange(len(at))[:, None], code.shape)
        yield at, code, weight, np.sqrt(np.bincount(row[new], sums**2, len(at)))


def sharp(k: np.ndarray) -> np.ndarray:
    return (np.maximum(k - CUT, 0) / (1 - CUT)) ** 2


class Landmarks:
    """Kernel values against a list of strings, by the triples that occur in them."""

    def __init__(self, marks: list[str]):
        found = list(features(marks))
        keys = np.unique(np.concatenate([f[1].ravel() for f in found])) if found else np.zeros(0, np.int64)
        self.marks, mask = marks, (1 << 21) - 1
        self.letters = sorted({int(k) >> s & mask for k in keys for s in (42, 21, 0)})
        self.index = np.zeros(0x110000, np.int32)
        self.index[self.letters] = np.arange(1, len(self.letters) + 1)
        self.column = np.zeros((len(self.letters) + 1) ** 3, np.int32)
        self.column[self.place(keys)] = np.arange(1, len(keys) + 1)
        self.rows = np.zeros((len(keys) + 1, len(marks)), np.float32)
        for at, code, weight, norm in found:
            if code.size:
                np.add.at(self.rows, (self.column[self.place(code)], np.broadcast_to(at[:, None], code.shape)), weight / norm[:, None])
        self.reach = self.rows.max(axis=1) if marks else np.zeros(1, np.float32)

    def place(self, code: np.ndarray) -> np.ndarray:
        mask, side = (1 << 21) - 1, len(self.letters) + 1
        return (self.index[code >> 42] * side + self.index[code >> 21 & mask]) * side + self.index[code & mask]

    def kernel(self, texts: list[str], rows: np.ndarray | None = None) -> np.ndarray:
        """Against all marks, or those of some columns of rows."""
        rows = self.rows if rows is None else rows
        out = np.zeros((len(texts), rows.shape[1]), np.float32)
        for at, code, weight, norm in features(texts):
            for i in range(0, len(at), 64):
                own = rows[self.column[self.place(code[i : i + 64])]]
                out[at[i : i + 64]] = np.matmul(weight.astype(np.float32), own) / norm[i : i + 64, None]
        return out

    def bound(self, texts: list[str], reach: np.ndarray) -> np.ndarray:
        """No kernel value against the marks that reach was made of is larger; triples that repeat only make the norm larger."""
        out = np.zeros(len(texts))
        for at, code, weight in coded(texts):
            if len(weight):
                out[at] = (reach[self.column[self.place(code)]] @ weight) / math.sqrt((weight**2).sum())
        return out


def solve(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine, costs c, by Newton steps on the points inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    inside = np.ones(len(x), bool)
    for _ in range(30):
        xa, ca = x[inside], c[inside]
        w = np.linalg.solve(np.diag(ridge) + 2 * (xa * ca[:, None]).T @ xa, 2 * (xa * ca[:, None]).T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


class Machine:
    """Landmarks and their weights, a bias, and the sigmoid."""

    def __init__(self, marks: list[str], alpha: np.ndarray, bias: float, a: float = 4.0, b: float = 0.0):
        self.marks, self.alpha, self.bias, self.a, self.b = Landmarks(marks), alpha, bias, a, b
        self.toxic = np.ascontiguousarray(self.marks.rows[:, alpha > 0])
        self.reach = self.toxic.max(axis=1) if self.toxic.size else np.zeros(len(self.marks.rows), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.marks.marks) and texts:
            near = np.flatnonzero(self.marks.bound(texts, self.reach) > CUT)
            near = near[self.marks.kernel([texts[k] for k in near], self.toxic).max(axis=1, initial=0) > CUT]
            out[near] += np.maximum(sharp(self.marks.kernel([texts[k] for k in near])) @ self.alpha, 0)
        return out

    def probability(self, f: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.a * f + self.b))))

    def plain(self) -> tuple:
        return self.marks.marks, self.alpha, self.bias, self.a, self.b


def _with_letter(string: bytes) -> list[bytes]:
    """Two strings with a letter put in at a third and at two thirds; the letter follows from the string."""
    s = string.decode()
    return [(s[: (k := len(s) * j // 3)] + "xqz"[(len(s) + j) % 3] + s[k:]).encode() for j in (1, 2)]


def copies(bags: list[list[bytes]]) -> list[int]:
    """A number for each bag, the same for those that share half of their strings (by a bottom-8 sketch, then exactly)."""
    root, held = list(range(len(bags))), {}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for k, b in enumerate(bags):
        for h in sorted({zlib.crc32(s) for s in b})[:8]:
            other = held.setdefault(h, k)
            if find(other) != find(k):
                x, y = set(b), set(bags[other])
                if 2 * len(x & y) >= len(x | y):
                    root[find(k)] = find(other)
    return [find(k) for k in range(len(bags))]


def witnesses(toxic: list[list[bytes]], clean: list[list[bytes]]) -> Counter:
    """Strings by the number of toxic texts, copies counted once, that have them."""
    group = copies(toxic)
    toxic = [sorted({s for b, g in zip(toxic, group, strict=True) if g == k for s in b}) for k in sorted(set(group))]
    n1, n0 = len(toxic), len(clean)
    p1, p0 = Counter(s for b in toxic for s in b), Counter(s for b in clean for s in b)

    def lean(s: bytes) -> float:
        a, b = p1[s], p0.get(s, 0)
        e = (a + b) * n1 / (n1 + n0)
        return (a - e) / math.sqrt(e + 0.25) if b <= 0.02 * a else 0.0

    leaning = {s: lean(s) for s in p1 if len(s) > 1}
    chosen = {s for s, x in leaning.items() if x >= LEAN}
    left = [set(b) for b in toxic if not chosen.intersection(b)]
    count = Counter(s for b in left for s in b if leaning.get(s, 0) > 1 and s not in p0)
    while count:
        s, n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n < EXPLAINS:
            break
        chosen.add(s)
        for b in [b for b in left if s in b]:
            left.remove(b)
            count.subtract(x for x in b if x in count)
        del count[s]
    return Counter({s: p1[s] for s in chosen})


def train(texts: list[str], labels: list[int]) -> Machine:
    """From whole texts and labels 0 or 1; with one label only, or without a witness, a machine that gives one answer."""
    none = np.zeros(0, np.float64)
    if len(set(labels)) < 2:
        return Machine([], none, 1.0 if labels and labels[0] else -1.0)
    bags = [sorted(set().union(*map(strings, sentences(t)))) for t in texts]
    toxic = [b for b, y in zip(bags, labels, strict=True) if y]
    clean = sorted({s for b, y in zip(bags, labels, strict=True) if not y for s in b})
    witness = witnesses(toxic, [b for b, y in zip(bags, labels, strict=True) if not y])
    positive = [s for s, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))][:WITNESSES]
    if not positive:
        return Machine([], none, -1.0)
    clean_set = set(clean)
    more = sorted({v for s in positive if len(s) > 3 for v in _with_letter(s)} - clean_set)
    first = lambda found: [pieces(s)[0] for s in found]
    start = Landmarks(first(positive))
    flat = first(clean)
    near = np.flatnonzero(start.bound(flat, start.reach) > CUT)
    closest = start.kernel([flat[k] for k in near]).max(axis=1) if len(near) else none
    near, closest = near[closest > CUT], closest[closest > CUT]
    negative = [flat[k] for k in near]
    hard = [negative[k] for k in np.argsort(-closest, kind="stable")[:HARD]]
    sample = first(positive) + first(more) + negative
    y = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * (len(negative) + 1))
    c = np.concatenate([[min(witness[s], 50) for s in positive], np.full(len(more), 1.0), np.full(len(negative), 4.0), [1000.0]]) * COST
    for r in range(ROUNDS):
        marks = list(dict.fromkeys(first(positive) + hard))
        within = Landmarks(marks)
        values, vectors = np.linalg.eigh(sharp(within.kernel(marks)).astype(np.float64))
        good = values > 1e-4
        root = vectors[:, good] / np.sqrt(values[good])  # K(L, L)^-1/2 up to a rotation
        phi = np.vstack([sharp(within.kernel(sample)) @ root, np.zeros((1, good.sum()))])  # the last row: strings far from all landmarks
        w, bias = solve(phi, y, c)
        machine = Machine(marks, root @ w, bias)
        f = phi[:-1][len(positive) + len(more) :] @ w + bias
        worst = [negative[k] for k in np.argsort(-f, kind="stable")[: HARD // 2] if f[k] > -0.5]
        hard = list(dict.fromkeys(hard + worst))
    every = sorted({s for b in bags for s in b})
    score = dict(zip(every, string_scores(machine, every), strict=True))
    top = np.array([max((score[s] for s in b), default=machine.bias) for b in bags])
    machine.a, machine.b = sigmoid(top, np.array(labels))
    return machine


def sigmoid(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a and b for P(1) = 1 / (1 + exp(-(a f + b))), drawn a little to 2 and 0 so that they stay finite.

    Scores beyond the margins count as the margins, so that the middle stays where the machine has put it.
    """
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.ones(len(y))
    x, w = np.stack([np.clip(f, -1, 1), np.ones(len(f))], 1), np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + (w - np.array([2.0, 0.0]))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        w = w - np.linalg.solve(h, g)
    return max(float(w[0]), 1e-3), float(w[1])


def string_scores(machine: Machine, found: list[bytes]) -> list[float]:
    parts = [pieces(s) for s in found]
    flat = [x for p in parts for x in p]
    if not flat:
        return []
    scores = np.concatenate([machine.scores(flat[i : i + 20_000]) for i in range(0, len(flat), 20_000)])
    return np.maximum.reduceat(scores, np.cumsum([0, *map(len, parts)])[:-1]).tolist()


class Scorer:
    """Scores texts, remembering those of strings."""

    def __init__(self, plain: tuple):
        self.machine, self.known = Machine(*plain), {}

    def many(self, texts: list[str]) -> list[float]:
        out = []
        for i in range(0, len(texts), 200):
            bags = [strings(t) for t in texts[i : i + 200]]
            if len(self.known) > CACHE:
                self.known.clear()
            new = list(set().union(*bags).difference(self.known)) if bags else []
            self.known.update(zip(new, string_scores(self.machine, new), strict=True))
            out += [self.machine.probability(max(map(self.known.__getitem__, b), default=self.machine.bias)) for b in bags]
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple:
    """Learns from labelled rows that are not held out: `sample` of each label at most, by a hash of the id. Null labels are none."""
    own = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    own = stage_table(own.groupBy("i").agg(F.max("y").alias("y")), "toxic-labels")
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("i", F.lit(7)), 12) / float(1 << 52)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, 1.2 * sample / max(n.get(1, 0), 1)))).otherwise(F.lit(min(1.0, 1.2 * sample / max(n.get(0, 0), 1))))
    chosen = own.where(place < share).withColumn("p", place)
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t")).where(F.col("t").isNotNull() & (F.char_length("t") <= sample_chars))
    got = rows.join(small(chosen, 3 * sample), "i").select("y", "p", "t").collect()  # at most about 2.4 * sample rows of sample_chars
    kept = [r for y in (0, 1) for r in sorted((r for r in got if r["y"] == y), key=lambda r: (r["p"], r["t"]))[:sample]]
    return train([r["t"] for r in kept], [r["y"] for r in kept]).plain()


def score(docs: DataFrame, model: tuple, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5). Null and empty texts, and texts without a string, score as clean.

    The model sent to the tasks has WITNESSES + HARD * (1 + ROUNDS / 2) strings at most. Input columns of the same names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    sent, schema = spark.sparkContext.broadcast(model), schema_with(docs, FIELDS)
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])
    names = schema.names

    def run(batches):
        s = Scorer(sent.value)
        for b in batches:
            found = s.many([t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
            yield append(b, {"score": pa.array(found, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in found], pa.int32())}).select(names)

    return docs.mapInArrow(run, schema)
