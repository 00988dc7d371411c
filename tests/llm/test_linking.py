"""Links between nodes that share one bucket only and are far from its most central node, against brute force."""

import random

from pyspark.sql import functions as F

from waygrid.llm import line_dedup, linking
from waygrid.llm.common import ship


def linked(spark, texts, keys):
    ship(spark)
    rows = spark.createDataFrame([(n, own) for n, own in keys.items()], "nid long, bands array<long>").withColumn("sketch", F.lit(None).cast("long"))
    table = spark.createDataFrame(list(texts.items()), "nid long, text string").withColumn("sketch", F.lit(None).cast("long"))
    found = linking.link(linking.buckets(rows, "test"), table, line_dedup.shingle_sets, line_dedup.jaccard, 0.8)
    return {r.nid: r.root for r in found.collect()}


def test_far_nodes_that_meet_in_one_bucket(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from the farm"
    texts = {0: "an unrelated hub line of boilerplate", 1: a, 2: a + "s"}
    assert linked(spark, texts, {0: [1], 1: [1], 2: [1]}) == {1: 1, 2: 1}


def test_one_large_bucket_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    bases = [[word() for _ in range(12)] for _ in range(200)]
    texts = {}
    for n in range(600):
        t = list(rng.choice(bases))
        if rng.random() < 0.5:
            t[rng.choice([0, -1])] = word()
        texts[n] = " ".join(t)
    keys = {n: [7] + ([8] if n % 2 else []) for n in texts}
    sets = {n: line_dedup.shingle_set(t) for n, t in texts.items()}
    root = {n: n for n in texts}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for x in texts:
        for y in range(x):
            if line_dedup.jaccard(*sets[x], *sets[y]) >= 0.8:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    want = {}
    for n in texts:
        want.setdefault(top(n), set()).add(n)
    got = {}
    for n, r in linked(spark, texts, keys).items():
        got.setdefault(r, set()).add(n)
    assert got == {r: c for r, c in want.items() if len(c) > 1}


def test_small_and_large_sets_give_the_same(spark, monkeypatch):
    """Families of changed copies that meet in many overlapping buckets, as sets of one row and as blocks."""
    rng = random.Random(9)
    texts, keys = {}, {}
    for f in range(6):
        base = [rng.choice("abcdefghijkl") for _ in range(120)]
        for k in range(25):
            t = list(base)
            for _ in range(rng.randrange(9)):
                t[rng.randrange(120)] = rng.choice("xyz")
            texts[f * 100 + k] = "".join(t)
            keys[f * 100 + k] = [f * 10 + b for b in range(4) if rng.random() < 0.7] or [f * 10]
    small = linked(spark, texts, keys)
    monkeypatch.setattr(linking, "SET_NODES", 3)
    assert linked(spark, texts, keys) == small and len(set(small.values())) >= 6
