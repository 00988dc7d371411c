"""Connected components of an edge table by distributed union-find.

Each task first makes a forest of its own edges, which drops those that close a circle. The forests' edges then meet in rounds of
alternating large-star and small-star; when LOCAL_EDGES or fewer are left, one task ends the work, in arrays of 16 bytes an edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, ship, stage_table

LOCAL_EDGES = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node of each one's component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while len(u):
        ru, rv = up[u], up[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(up, np.maximum(ru, rv), np.minimum(ru, rv))
        while ((above := up[up]) != up).any():
            up = above
    return nodes, nodes[up]


def _forests(edges: DataFrame, with_roots: bool = False) -> DataFrame:
    """(u, v): each task's nodes with the least node of their component in the task's edges, which is itself left out unless asked for."""

    def run(batches):
        u, v, held = [], [], 0

        def forest():
            nodes, top = roots(np.concatenate(u), np.concatenate(v))
            keep = np.ones(len(nodes), bool) if with_roots else nodes != top
            return nodes[keep], top[keep]

        for b in batches:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
            held += b.num_rows
            if held > 2 * LOCAL_EDGES and not with_roots:  # what is found so far takes the place of the edges
                a, c = forest()
                u, v, held = [a], [c], 0
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest()], names=["u", "v"])

    ship(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _star(both: DataFrame, keep) -> DataFrame:
    """Links the neighbours of each node u, as keep says, to the least of them and u. both: (u, v)."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is the least node of its component.

    Every round is written to the shared folder; no round gathers a component of more than local_edges. Nulls join nothing.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} != {b}")
    e, seen = stage_table(_forests(e), "cc"), None
    while True:
        n = e.count()
        if n <= local_edges:
            return _forests(e.coalesce(1), with_roots=True).select(F.col("u").alias("node"), F.col("v").alias("root"))
        back = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(back, F.col("v") > F.col("u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v")
        now = stage_table(small.distinct(), "cc")
        drop_table(e)
        e = now
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = sign
