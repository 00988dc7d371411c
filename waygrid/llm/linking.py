"""Classes of similar texts from buckets of candidates, for any similarity s whose 1 - s is a metric, without all pairs of a bucket.

Candidates must also agree in most of a sketch, where they have one: a word with a bit of each of 64 places of their signatures.
Texts of s = 0.8 differ in 6.4 bits on average, and with probability 2e-5 in more than MOST_APART; such of s = 0.1 differ in 29.
Nodes without such a candidate in a bucket leave it. Buckets of the same nodes are one set. A set of SET_NODES nodes and SET_BYTES bytes at most is decided in one row of a Python task:
its nodes are held against each other unless they are in one component already or the triangle inequality forbids a link.

In a larger set all nodes are first held against its most central one, which is the one that is in most larger sets: of a text and its
changed copies, the text. Sets of one such node become one. A link that this can miss is
- between a node that is further than 1 - threshold from that one, but at most twice as far, and one that is near it and, by
  the triangle inequality, no less far than the first one's distance less 1 - threshold; such pairs are held against each other
  unless they are in one component already;
- between two nodes that are both further than 1 - threshold. If these are many, all of a set
  are held against the one of them that is nearest to the central one, in the same two ways. Those that are left are held against each other, in blocks, unless the
  triangle inequality forbids a link or they are in one component already.
A block has about BLOCK nodes and BLOCK_BYTES bytes (one text is not divided), so a large set is many even rows.

So every pair that shares a bucket, agrees in the sketch and has s >= threshold is in one class; sharing one bucket is enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, small
from .components import components
from .words import mix

_EPS = 1e-9
#: A set that is decided in one row.
SET_NODES, SET_BYTES = 256, 4 << 20
#: Nodes of a side that are held against those of another at once.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Bits in which the sketches of two candidates differ at most.
MOST_APART = 18
#: Keys that a task holds at once.
RANGE_KEYS = 2_000_000
#: Rows that are far from the most central node of their set, up to which they are held against each other at once.
DIRECT_ROWS = 50_000
#: Texts whose features are made at once, in bytes.
FEATURE_BYTES = 1 << 20
#: Nodes whose components, and pairs without a link, that a task remembers.
REMEMBERED = 500_000
_LINKS = "x long, y long, s double"
_ROW = ("nid", "d", "root", "text", "sketch")


def sketches(z: np.ndarray) -> np.ndarray:
    """The lowest bits of the first 64 places of signatures [n, m], as a word each."""
    return np.packbits((z[:, :64] & z.dtype.type(1)).astype(np.uint8), axis=1).view(np.int64).ravel()


def _six(x: np.ndarray) -> bytes:
    """Words of 48 bits in six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(top), the upper 48 bits of the keys that several nodes have. nodes: (nid, bands array<long>), repeats allowed.

    A task deals its keys into ranges and sends each range as one run of bytes, so a key costs eight bytes and no row: these 48 bits
    and 16 bits of its node's hash. Equal bits of different keys or nodes cost a few rows too many, or one key in 65,536 of a pair of
    nodes. The task that has a range keeps one entry a key, the least and the largest node's hash, however many nodes have the key.
    """
    spark = nodes.sparkSession
    ship(spark)
    total = nodes.select(F.sum(F.size("bands"))).first()[0] or 0
    tasks = max(1, min(20_000, max(-(-total // RANGE_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")) * bool(total > RANGE_KEYS // 8))))
    bits = min(16, (4 * tasks - 1).bit_length())

    def deal(batches):
        keys, nodes, held = [], [], 0

        def dealt():
            k, n = np.concatenate(keys), np.concatenate(nodes)
            at = (k >> np.uint64(48 - bits)).astype(np.uint16)
            order = np.argsort(at, kind="stable")
            k, n, at = k[order], n[order], at[order]
            cut = np.flatnonzero(np.diff(at, prepend=-1, append=-1).astype(bool))[: len(at) + 1].tolist()
            for i in range(0, len(cut) - 1, 256):
                part = list(zip(cut[i : i + 257][:-1], cut[i : i + 257][1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(at[x]) for x, _ in part], pa.int32()), pa.array([_six(k[x:y]) for x, y in part], pa.binary()), pa.array([n[x:y].tobytes() for x, y in part], pa.binary())], names=["range", "keys", "nodes"])

        for b in batches:
            own = b.column(1)
            size = np.diff(own.offsets.to_numpy(zero_copy_only=False))
            keys.append(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(16))
            nodes.append(np.repeat((mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(48)).astype(np.uint16), size))
            held += len(keys[-1])
            if held >= RANGE_KEYS:
                yield from dealt()
                keys, nodes, held = [], [], 0
        if held:
            yield from dealt()

    def several(batches):
        keys, least, most, held = [], [], [], 0

        def one_each():
            k = np.concatenate(keys)
            order = np.argsort(k)
            k = k[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            return k[first], np.minimum.reduceat(np.concatenate(least)[order], first), np.maximum.reduceat(np.concatenate(most)[order], first)

        for b in batches:
            for k, n in zip(b.column(1), b.column(2), strict=True):
                keys.append(_from_six(np.frombuffer(k.as_buffer(), np.uint8)))
                least.append(np.frombuffer(n.as_buffer(), np.uint16))
                most.append(least[-1])
                held += len(keys[-1])
                if held > RANGE_KEYS + (len(keys[0]) if len(keys) > 1 else 0):
                    keys, least, most = ([x] for x in one_each())
                    held = len(keys[0])
        if held:
            k, x, y = one_each()
            k = k[x != y].view(np.int64)
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)])], names=["top"])

    dealt = nodes.select("nid", "bands").mapInArrow(deal, "range int, keys binary, nodes binary").repartition(tasks, "range")
    return dealt.mapInArrow(several, "top long")


def buckets(nodes: DataFrame, name: str) -> DataFrame:
    """(key, nid, sketch, low) of one key for each set of several candidates that some key has; low: the set's least node.

    nodes: (nid, sketch, bands array<long>), repeats allowed. A null sketch agrees with all. Keys of over SET_NODES nodes are not
    searched for nodes without a candidate.
    """
    s = Scratch(nodes.sparkSession)
    shared = s(shared_keys(nodes), f"{name}-shared")
    rows = nodes.select("nid", "sketch", F.explode("bands").alias("key"))
    rows = rows.withColumn("top", F.shiftrightunsigned("key", 16)).join(small(shared, shared.count()), "top", "left_semi").drop("top")
    own = s(rows, f"{name}-rows")
    large = s(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SET_NODES).select("key"), f"{name}-large")
    n = large.count()
    few = own.join(small(large, n), "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("nid", "sketch")).alias("r"))  # SET_NODES at most
    agree = f"x.nid != y.nid and coalesce(bit_count(x.sketch ^ y.sketch) <= {MOST_APART}, true)"
    few = few.select("key", F.explode(F.expr(f"filter(r, x -> exists(r, y -> {agree}))")).alias("x")).select("key", "x.nid", "x.sketch")
    own = s(few.union(own.join(small(large, n), "key", "left_semi").select("key", "nid", "sketch").distinct()), f"{name}-near")
    sums = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("low"), F.bit_xor(F.xxhash64("nid")).alias("p"), F.bit_xor(F.xxhash64("nid", F.lit(7))).alias("q"))
    one = s(sums.groupBy("n", "low", "p", "q").agg(F.min("key").alias("key")).select("key", "low"), f"{name}-sets")
    members = s(own.join(small(one, one.count()), "key"), f"{name}-members")
    s.drop(members)
    return members


def _elected(members: DataFrame, known: DataFrame) -> DataFrame:
    """(rep, nid) of the keys of several components: rep is the key's node that has most of these keys; keys of one rep are one set."""
    nodes = members.groupBy("nid").agg(F.collect_list("key").alias("keys"))  # a node has a key for each band at most
    each = _rooted(nodes, known).select("nid", "root", F.size("keys").alias("c"), F.explode("keys").alias("key"))
    reps = each.groupBy("key").agg(F.max(F.struct("c", "nid")).alias("r"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    reps = reps.where("r0 != r1").select("key", F.col("r.nid").alias("rep"))
    return each.join(reps, "key").select("rep", "nid").distinct()


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["x", "y", "s"])


class _Forest:
    """Components of the nodes seen so far, by union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, k: int) -> int:
        up = self.up
        while (p := up.get(k, k)) != k:
            up[k] = k = up.get(p, p)
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            if len(self.up) > REMEMBERED:  # only forgets what need not be computed again
                self.up.clear()
            self.up[a] = b
        return a != b


def _set_links(members: DataFrame, texts: DataFrame, features, similarity, threshold: float) -> DataFrame:
    """(x, y, s) of links that make the components of each key's nodes. members: (key, nid, low), of small sets.

    A node is the least of a set for each band at most, so sets dealt by it are even, and sets of one family mostly meet.
    """
    far = 1 - threshold
    rows = members.join(texts, "nid").repartition("low").groupBy("low", "key").agg(F.collect_list(F.struct("nid", "text", "sketch")).alias("rows")).select("rows")  # SET_NODES, SET_BYTES at most

    def run(batches):
        forest, unlike = _Forest(), set()  # a pair meets again in the sets of other bands
        for batch in batches:
            if len(unlike) > REMEMBERED:
                unlike.clear()
            lists = batch.column(0)
            flat = lists.flatten()
            ends = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).cumsum().tolist()
            ids, sketch = flat.field(0).to_pylist(), flat.field(2).to_pylist()
            sets = [range(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            need = {ids[k]: k for own in sets if len({forest.top(ids[k]) for k in own}) > 1 for k in own}
            made = _features_of(flat.field(1), need, features)
            out = []
            for own in sets:
                nodes = sorted((ids[k], k) for k in own)
                tops = [forest.top(x) for x, _ in nodes]
                if len(set(tops)) < 2:
                    continue
                d: list[float | None] = [None] * len(nodes)
                bits = [sketch[k] for _, k in nodes]
                for i, (x, _) in enumerate(nodes):
                    for j in range(i + 1, len(nodes)):
                        if tops[i] == tops[j] or not _agree(bits[i], bits[j]) or i and d[i] is not None and d[j] is not None and abs(d[i] - d[j]) > far + _EPS:
                            continue
                        y = nodes[j][0]
                        if (x, y) in unlike:
                            continue
                        s = similarity(*made[x], *made[y])
                        if not i:
                            d[j] = 1 - s
                        if s >= threshold - _EPS:
                            forest.join(x, y)
                            was, top = tops[i], tops[j]
                            tops = [top if t == was else t for t in tops]
                            out.append((y, x, s))
                        elif len(nodes) > 2:
                            unlike.add((x, y))
            yield _batch(out)

    return rows.mapInArrow(run, _LINKS)


def _agree(a: int | None, b: int | None) -> bool:
    return a is None or b is None or ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= MOST_APART


def _features_of(texts: pa.Array, need: dict[int, int], features) -> dict[int, tuple]:
    """The features of the texts at the places that need has by node, made FEATURE_BYTES at a time."""
    made, nodes, held, size = {}, [], [], 0
    for n, k in [*need.items(), (None, -1)]:
        if n is not None:
            nodes.append(n)
            held.append(texts[k].as_py())
            size += len(held[-1])
        if held and (n is None or size >= FEATURE_BYTES):
            made.update(zip(nodes, features(held), strict=True))
            nodes, held, size = [], [], 0
    return made


def similarities(pairs: DataFrame, texts: DataFrame, features, similarity) -> DataFrame:
    """pairs (x, y) with s, from texts (nid, text, size). features: texts -> arrays of each; similarity: their arrays -> s.

    The x of each y are dealt into blocks, a row each with the text of y, so a y of many x is many even rows.
    """
    sized = pairs.join(texts.select(F.col("nid").alias("x"), "text", "size"), "x")
    n = pairs.join(texts.select(F.col("nid").alias("x"), "size"), "x").groupBy("y").agg(_blocks().alias("n"))
    blocks = sized.join(n, "y").groupBy("y", F.pmod(F.xxhash64("x"), "n").alias("i")).agg(F.collect_list(F.struct("x", "text")).alias("rows"))
    both = blocks.join(texts.select(F.col("nid").alias("y"), F.col("text").alias("ty")), "y").select("y", "ty", "rows")

    def run(batches):
        for batch in batches:
            for one_y, one_text, one_rows in zip(*batch.columns[:3], strict=True):
                y, rows = one_y.as_py(), one_rows.as_py()
                fy, *found = features([one_text.as_py(), *[r["text"] for r in rows]])
                yield _batch([(r["x"], y, similarity(*f, *fy)) for r, f in zip(rows, found, strict=True)])

    return both.mapInArrow(run, _LINKS)


def _blocks():
    """An aggregate: how many blocks a group of rows with a column size is dealt into."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1).cast("long"))


def _rooted(members: DataFrame, known: DataFrame) -> DataFrame:
    return members.join(known, "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Those in sets of more than one component."""
    reps = placed.groupBy("rep").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("rep")
    return placed.join(reps, "rep")


def _compare(candidates, left, right, features, similarity, threshold: float, forest: _Forest) -> list[tuple]:
    """Links among candidates (i, j) of two lists of rows, in order, without those of one component. Features are made once a row."""
    made: dict[int, tuple] = {}

    def of(r):
        if r["nid"] not in made:
            made[r["nid"]] = features([r["text"]])[0]
        return made[r["nid"]]

    out = []
    for i, j in candidates:
        x, y = left[i], right[j]
        if forest.top(x["root"]) != forest.top(y["root"]) and _agree(x["sketch"], y["sketch"]) and (s := similarity(*of(x), *of(y))) >= threshold - _EPS:
            forest.join(x["root"], y["root"])
            out.append((x["nid"], y["nid"], s))
    return out


def _ring_links(placed: DataFrame, texts: DataFrame, features, similarity, threshold: float) -> DataFrame:
    """(x, y, s) of the links that a star can miss between a node apart from rep and one near it.

    placed: (rep, nid, d, root). Both sides of a rep are dealt into blocks, and each pair of blocks is one row. In such a row only
    pairs that are in different components and are allowed by the triangle inequality are computed, and only links come out.
    """
    far = 1 - threshold
    by = placed.where(F.col("d") <= 2 * far + _EPS).withColumn("apart", F.col("d") > far + _EPS).join(texts, "nid")
    n = by.groupBy("rep", "apart").agg(_blocks().alias("n"))
    n = n.where("apart").select("rep", F.col("n").alias("na")).join(n.where("not apart").select("rep", F.col("n").alias("nn")), "rep")

    def side(apart: bool, own: str, other: str) -> DataFrame:
        rows = by.where(F.col("apart") == apart).join(n, "rep").withColumn("own", F.pmod(F.xxhash64("nid"), F.col(own)))
        blocks = rows.groupBy("rep", "own", other).agg(F.collect_list(F.struct(*_ROW)).alias("rows"))
        return blocks.select("rep", "own", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("with"))

    a = side(True, "na", "nn").select("rep", F.col("own").alias("i"), F.col("with").alias("j"), F.col("rows").alias("a"))
    b = side(False, "nn", "na").select("rep", F.col("with").alias("i"), F.col("own").alias("j"), F.col("rows").alias("b"))

    def run(batches):
        for batch in batches:
            for one_a, one_b in zip(batch.column(0), batch.column(1), strict=True):
                left, right = one_a.as_py(), one_b.as_py()
                pairs = ((i, k) for i, x in enumerate(left) for k, y in enumerate(right) if y["d"] >= x["d"] - far - _EPS)
                yield _batch(_compare(pairs, left, right, features, similarity, threshold, _Forest()))

    return a.join(b, ["rep", "i", "j"]).select("a", "b").mapInArrow(run, _LINKS)


def _rest_links(rest: DataFrame, texts: DataFrame, features, similarity, threshold: float) -> DataFrame:
    """(x, y, s) of links between any two nodes of a set, of rest (rep, nid, d, root).

    Each set's nodes are dealt into blocks, and each pair of blocks is one row. A pair is computed if its components differ, links
    found in the row included, and the triangle inequality allows a link.
    """
    far = 1 - threshold
    own = rest.join(texts, "nid")
    n = own.groupBy("rep").agg(_blocks().alias("n"))
    rows = own.join(n, "rep").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("n")))
    blocks = rows.groupBy("rep", "own", "n").agg(F.collect_list(F.struct(*_ROW)).alias("rows"))
    a = blocks.select("rep", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("n") - 1)).alias("j"), F.col("rows").alias("a"))
    b = blocks.where("own > 0").select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("i"), F.col("own").alias("j"), F.col("rows").alias("b"))

    def run(batches):
        for batch in batches:
            for one_a, one_b in zip(*batch.columns[:2], strict=True):
                left, right = one_a.as_py(), one_b.as_py()
                same = right is None
                left.sort(key=lambda r: r["d"])
                right = left if same else sorted(right, key=lambda r: r["d"])

                def pairs(left=left, right=right, same=same):
                    start = 0
                    for k, x in enumerate(left):
                        while start < len(right) and right[start]["d"] < x["d"] - far - _EPS:
                            start += 1
                        for j in range(k + 1 if same else start, len(right)):
                            if right[j]["d"] > x["d"] + far + _EPS:
                                break
                            yield k, j

                yield _batch(_compare(pairs(), left, right, features, similarity, threshold, _Forest()))

    return a.join(b, ["rep", "i", "j"], "left").select("a", "b").mapInArrow(run, _LINKS)


def link(members: DataFrame, texts: DataFrame, features, similarity, threshold: float) -> DataFrame:
    """(nid, root) of all nodes that have a link. members: (key, nid, low) as buckets() makes them; texts: (nid, text, sketch).

    features: a list of texts -> a tuple of arrays for each; similarity: the arrays of two texts -> s.
    """
    far, s, members = 1 - threshold, Scratch(members.sparkSession), members.select("key", "nid", "low")
    texts = texts.withColumn("size", F.octet_length("text").cast("long"))

    def classes(links: DataFrame) -> DataFrame:
        return s(components(links.where(F.col("s") >= threshold - _EPS).select("x", "y"), "x", "y").select(F.col("node").alias("nid"), "root"), "link-labels")

    sizes = members.join(small(texts.select("nid", "size"), texts.count()), "nid").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = s(sizes.where((F.col("n") > SET_NODES) | (F.col("bytes") > SET_BYTES) & (F.col("n") > 2)).select("key"), "link-large")
    n = large.count()
    done = s(_set_links(members.join(small(large, n), "key", "left_anti") if n else members, texts, features, similarity, threshold), "link-sets")
    known = classes(done)
    if n:
        members = s(_elected(members.join(small(large, n), "key", "left_semi"), known), "link-members")
        nodes = s(members.select("nid").union(members.select("rep")).distinct(), "link-nodes")
        texts = s(texts.join(small(nodes, nodes.count()), "nid", "left_semi"), "link-texts")  # the others are not moved again
        for last in (False, True):
            tested = s(similarities(members.where("nid != rep").select(F.col("nid").alias("x"), F.col("rep").alias("y")), texts, features, similarity), "link-tested")
            done = done.union(tested)
            known = classes(done)
            placed = tested.select(F.col("y").alias("rep"), F.col("x").alias("nid"), (1 - F.col("s")).alias("d"))
            placed = placed.union(tested.select(F.col("y").alias("rep"), F.col("y").alias("nid"), F.lit(0.0).alias("d")).distinct())
            placed = s(_mixed(_rooted(placed, known)).select("rep", "nid", "d", "root"), "link-placed")
            done = done.union(s(_ring_links(placed, texts, features, similarity, threshold), "link-ring"))
            apart = s(_mixed(placed.where(F.col("d") > far + _EPS)).select("rep", "nid", "d"), "link-apart")
            if last or apart.count() <= DIRECT_ROWS:
                break
            central = apart.groupBy("rep").agg(F.min(F.struct("d", "nid")).alias("b")).select("rep", F.col("b.nid").alias("next"))
            members = s(apart.join(central, "rep").select(F.col("next").alias("rep"), "nid").distinct(), "link-members")
        rest = s(_rooted(apart, classes(done)).select("rep", "nid", "d", "root"), "link-rest")
        known = classes(done.union(s(_rest_links(rest, texts, features, similarity, threshold), "link-rest-links")))
    s.drop(known)
    return known
