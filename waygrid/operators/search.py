"""Path search for batches of queries, one join with the edge table for each round.

Without turn costs a U-turn never pays, so labels are of nodes: one tree of cheapest ways for each different origin, or for each
different destination if these are fewer, answers all queries that share it. A label has its cost and its last edge; ways are put
together afterwards, an edge for each join. With turn costs labels are of edges and each query has its own.

A round expands the labels that the last one improved, those of several trees at a node together; labels that cost no less than the dearest answer of their tree are dropped.
All trees advance together; the driver only asks whether labels are left. The loop ends by itself, as a label only gets cheaper;
nothing bounds the length of a way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import c
from .sorting import places
from .storage import drop, stage


def seeds(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of the edges that leave the origins. queries: query_id, origin, destination; edges: edge_id, from_node, to_node, cost."""
    first = edges.select(F.col("from_node").alias("origin"), "edge_id", "to_node", "cost")
    return queries.join(first, "origin").select("query_id", "destination", "edge_id", "to_node", "cost", F.array("edge_id").alias("path"))


def _best(labels: DataFrame) -> DataFrame:
    return labels.groupBy("query_id", "edge_id").agg(F.min_by(F.struct("destination", "to_node", "cost", "path"), F.struct("cost", "path")).alias("b")).select("query_id", "edge_id", "b.destination", "b.to_node", "b.cost", "b.path")


#: Roots whose labels of a node share a row.
WIDTH = 16


def trees(roots: DataFrame, edges: DataFrame, targets: DataFrame, ways: bool = True) -> DataFrame:
    """(root, node, cost, edge_id, prev): the cheapest way from each root to the nodes around it, its last edge and the node before.

    roots: root; edges: edge_id, from_node, to_node, cost (not negative); targets: (root, node), all of which have their cheapest
    way in the result if they can be reached. Of last edges of equal cost the least counts. Without ways: (root, node, cost) alone.

    The labels of up to WIDTH roots at a node are one row, so that a round meets an edge once for all of them. The last edges are found
    when all costs are: those over which the cost is reached from a cheaper node, or one as cheap that was reached in an earlier round.
    """
    kind = edges.schema["cost"].dataType
    slots = places(roots.select("root").distinct(), [F.col("root")], name="at").select("root", F.floor((F.col("at") - 1) / WIDTH).alias("block"), ((F.col("at") - 1) % WIDTH).cast("int").alias("slot"))
    slots = stage(slots, "tree-roots")
    width = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    each = range(width)
    cost, round_ = [f"c{i}" for i in each], [f"r{i}" for i in each]
    net = stage(edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("end"), F.col("cost").alias("more"), *(["edge_id"] if ways else [])), "tree-edges")
    wanted = targets.select("root", "node").join(slots, "root").groupBy("block", "node").agg(*[F.bool_or(F.col("slot") == i).alias(f"w{i}") for i in each])
    wanted = stage(wanted, "tree-targets")
    total = stage(wanted.groupBy("block").agg(*[F.count_if(f"w{i}").alias(f"n{i}") for i in each]), "tree-counts")
    first = slots.groupBy("block", F.col("root").alias("node")).agg(*[F.max(F.when(F.col("slot") == i, F.lit(0).cast(kind))).alias(f"c{i}") for i in each])
    frontier, known, n = stage(first, "tree-frontier"), None, 0
    while not frontier.isEmpty():
        before = known
        fresh = frontier.select("block", "node", *cost, *[F.when(F.col(f"c{i}").isNotNull(), F.lit(n)).alias(f"r{i}") for i in each])
        if known is not None:
            later = frontier.select("block", "node", *[F.col(x).alias(f"new_{x}") for x in cost])
            fresh = known.join(later, ["block", "node"], "full_outer").select("block", "node", *[F.coalesce(f"new_c{i}", f"c{i}").alias(f"c{i}") for i in each], *[F.when(F.col(f"new_c{i}").isNotNull(), F.lit(n)).otherwise(F.col(f"r{i}")).alias(f"r{i}") for i in each])
        known, n = stage(fresh, "tree"), n + 1
        met = wanted.join(known, ["block", "node"]).groupBy("block").agg(*[F.count(F.when(F.col(f"w{i}"), F.col(f"c{i}"))).alias(f"m{i}") for i in each], *[F.max(F.when(F.col(f"w{i}"), F.col(f"c{i}"))).alias(f"b{i}") for i in each])
        bounds = total.join(met, "block").select("block", *[F.when(F.col(f"m{i}") == F.col(f"n{i}"), F.col(f"b{i}")).alias(f"b{i}") for i in each])
        live = frontier.join(bounds, "block", "left").select("block", "node", *[F.when(F.col(f"b{i}").isNull() | (F.col(f"c{i}") < F.col(f"b{i}")), F.col(f"c{i}")).alias(f"c{i}") for i in each])
        live = live.where(F.coalesce(*cost).isNotNull())
        grown = live.hint("shuffle_hash").join(net, "node").groupBy("block", F.col("end").alias("node")).agg(*[F.min(F.col(x) + F.col("more")).alias(f"new_{x}") for x in cost])
        old = known.select("block", "node", *cost)
        better = grown.join(old, ["block", "node"], "left").select("block", "node", *[F.when(F.col(x).isNull() | (F.col(f"new_{x}") < F.col(x)), F.col(f"new_{x}")).alias(x) for x in cost])
        last, frontier = frontier, stage(better.where(F.coalesce(*cost).isNotNull()), "tree-frontier")
        drop(last)
        if before is not None:
            drop(before)
    if known is None:
        known = stage(first.select("*", *[F.lit(0).alias(x) for x in round_]), "tree")
    labels = lambda rows, one: rows.withColumn("l", F.explode(F.filter(F.array(*map(one, each)), lambda x: x["cost"].isNotNull()))).join(slots, [F.col("l.slot") == slots["slot"], rows["block"] == slots["block"]])
    costs = labels(known, lambda i: F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("cost"))).select("root", "node", "l.cost")
    if not ways:
        return costs
    ends = known.select("block", F.col("node").alias("end"), *[F.col(x).alias(f"end_{x}") for x in (*cost, *round_)])
    over = known.hint("shuffle_hash").join(net, "node").join(ends, ["block", "end"])

    def last_edge(i):
        reached = (F.col(f"c{i}") + F.col("more") == F.col(f"end_c{i}")) & ((F.col(f"c{i}") < F.col(f"end_c{i}")) | (F.col(f"r{i}") < F.col(f"end_r{i}")))
        return F.struct(F.lit(i).alias("slot"), F.when(reached, F.col(f"end_c{i}")).alias("cost"))

    found = labels(over, last_edge).groupBy("root", F.col("end").alias("node")).agg(F.min(F.struct("edge_id", F.col("node").alias("prev"))).alias("b"))
    return stage(costs.join(found.select("root", "node", "b.edge_id", "b.prev"), ["root", "node"], "left"), "tree-ways")


def turned_round(edges: DataFrame) -> DataFrame:
    """edges driven from their end to their start: for trees of ways towards a root."""
    return edges.select(*[F.col({"from_node": "to_node", "to_node": "from_node"}.get(x, x)).alias(x) for x in edges.columns])


def _answers(queries: DataFrame, edges: DataFrame, ways: bool) -> tuple[DataFrame, DataFrame, bool]:
    """The trees of all queries; (query_id, root, node, cost) of those that can be answered; whether roots are the destinations."""
    n = queries.agg(F.count_distinct("origin"), F.count_distinct("destination")).first()
    back = n[1] < n[0]
    root, node = ("destination", "origin") if back else ("origin", "destination")
    if back:
        edges = turned_round(edges)
    q = queries.select("query_id", F.col(root).alias("root"), F.col(node).alias("node"))
    tree = trees(q, edges, q, ways)
    return tree, q.join(tree.select("root", "node", "cost"), ["root", "node"]), back


def cheapest_costs(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, cost) for every query that can be answered, as cheapest_paths()."""
    return _answers(queries, edges, False)[1].select("query_id", "cost")


def cheapest_paths(queries: DataFrame, edges: DataFrame, turn: DataFrame | None = None, u_turns: bool = False) -> DataFrame:
    """(query_id, cost, path array<edge_id>) for every query that can be answered; queries whose ends are one node cost 0.

    queries: query_id, origin, destination; edges: edge_id, opp_edge_id, from_node, to_node, cost (not negative). turn: see
    turned_paths().
    """
    if turn is not None:
        return turned_paths(queries, edges, turn, u_turns)
    tree, found, back = _answers(queries, edges, True)
    walk = stage(found.select("query_id", "root", F.col("node").alias("at"), "cost", F.array().cast("array<bigint>").alias("path")), "walk")
    step, ended = tree.where("edge_id is not null").select("root", F.col("node").alias("at"), "edge_id", "prev"), None
    while True:
        home = walk.where("at = root").select("query_id", "cost", "path")
        ended = home if ended is None else ended.unionByName(home)
        walk = stage(walk.where("at <> root").join(step, ["root", "at"]).select("query_id", "root", F.col("prev").alias("at"), "cost", F.concat("path", F.array("edge_id")).alias("path")), "walk")
        if walk.isEmpty():
            return ended if back else ended.withColumn("path", F.reverse("path"))


def turned_paths(queries: DataFrame, edges: DataFrame, turn: DataFrame, u_turns: bool = False) -> DataFrame:
    """As cheapest_paths(), with turn: (from_edge, to_edge, cost, banned) of edge pairs; pairs that it does not name cost nothing.

    Of ways of equal cost that of the smaller path is the answer.
    """
    same = queries.where("origin = destination").select("query_id", F.lit(0).cast(edges.schema["cost"].dataType).alias("cost"), F.array().cast("array<bigint>").alias("path"))
    frontier = stage(_best(seeds(queries.where("origin <> destination"), edges)), "labels")
    settled = frontier
    step = edges.select(F.col("from_node").alias("at"), F.col("edge_id").alias("next"), "opp_edge_id", F.col("to_node").alias("end"), F.col("cost").alias("more"))
    while True:
        found = settled.where("to_node = destination").groupBy("query_id").agg(F.min("cost").alias("bound"))
        live = frontier.where("to_node <> destination").join(found, "query_id", "left").where("bound is null or cost < bound").drop("bound")
        grown = live.join(step, live["to_node"] == step["at"])
        if not u_turns:
            grown = grown.where("edge_id <> opp_edge_id")
        pair = turn.select(F.col("from_edge").alias("edge_id"), F.col("to_edge").alias("next"), F.col("cost").alias("turn_cost"), "banned")
        grown = grown.join(pair, ["edge_id", "next"], "left").where("not coalesce(banned, false)").withColumn("more", F.col("more") + F.coalesce("turn_cost", F.lit(0)))
        grown = grown.select("query_id", "destination", F.col("next").alias("edge_id"), F.col("end").alias("to_node"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", F.array("next")).alias("path"))
        known = settled.select("query_id", "edge_id", F.col("cost").alias("old"))
        frontier = stage(_best(grown).join(known, ["query_id", "edge_id"], "left").where("old is null or cost < old").drop("old"), "labels")
        if frontier.isEmpty():
            break
        settled = stage(_best(settled.unionByName(frontier)), "labels")
    ends = settled.where("to_node = destination").groupBy("query_id").agg(F.min_by(F.struct("cost", "path"), F.struct("cost", "path")).alias("b"))
    return ends.select("query_id", "b.cost", "b.path").unionByName(same)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each edge of each path, with its place and the running cost."""
    e = edges.select("edge_id", "from_node", "to_node", F.col("cost").alias("edge_cost"))
    rows = paths.select("query_id", F.posexplode("path").alias("seq", "edge_id")).join(e, "edge_id")
    w = Window.partitionBy("query_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("query_id", "seq", "edge_id", "from_node", "to_node", "edge_cost", F.sum("edge_cost").over(w).alias("elapsed"))


def recost(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, cost) of the given paths by the edges' present cost; a path with an edge that is not there has no cost."""
    e = edges.select("edge_id", F.col("cost").alias("c"))
    rows = paths.select("query_id", F.explode("path").alias("edge_id")).join(e, "edge_id", "left")
    return rows.groupBy("query_id").agg(F.when(F.count("c") == F.count(F.lit(1)), F.sum("c")).alias("cost"))


def meet(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Where the two trees of a bidirectional search meet: the cheapest pair of a forward label and a backward one on its opposing edge."""
    b = backward.select("query_id", F.col("edge_id").alias("opp_edge_id"), F.col("cost").alias("rest"))
    return forward.join(b, ["query_id", "opp_edge_id"]).groupBy("query_id").agg(F.min_by("edge_id", F.struct(F.col("cost") + F.col("rest"), "edge_id")).alias("edge_id"), F.min(F.col("cost") + F.col("rest")).alias("cost"))


def reach(edges: DataFrame, starts: DataFrame, limit: int = 3) -> DataFrame:
    """(node_id, steps) of nodes within `limit` edges of the starts (node_id), by whole rounds."""
    seen = stage(starts.select("node_id").distinct().withColumn("steps", F.lit(0)), "reach")
    step = edges.select(F.col("from_node").alias("node_id"), F.col("to_node").alias("next"))
    for k in range(1, limit + 1):
        new = seen.where(F.col("steps") == k - 1).join(step, "node_id").select(F.col("next").alias("node_id")).distinct()
        seen = stage(seen.unionByName(new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("steps", F.lit(k))), "reach")
    return seen


def stretch_limit(cost, most: float = 2.0, least: float = 1.25, near: float = 600.0, far: float = 7200.0) -> Column:
    """Times the best cost that an alternate may have: falls with the cost, in a line between two bounds."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c(cost) - near) / (far - near)))
    return F.lit(most) - share * (most - least)


def sharing_limit(meters) -> Column:
    """Share of its length that an alternate may have in common: 0.6 below 10 km, 0.75 above 100 km."""
    return F.lit(0.6) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c(meters) - 10_000.0) / 90_000.0)) * 0.15


def shared_length(candidates: DataFrame, chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, other, shared): metres on edges of both ÷ metres of the chosen one. Both tables: query_id, route, path."""
    e = edges.select("edge_id", "length_m")
    a = candidates.select("query_id", F.col("route").alias("candidate"), F.explode("path").alias("edge_id")).distinct()
    b = chosen.select("query_id", F.col("route").alias("other"), F.explode("path").alias("edge_id")).distinct().join(e, "edge_id")
    total = b.groupBy("query_id", "other").agg(F.sum("length_m").alias("total"))
    both = a.join(b, ["query_id", "edge_id"]).groupBy("query_id", "candidate", "other").agg(F.sum("length_m").alias("m"))
    return both.join(total, ["query_id", "other"]).select("query_id", "candidate", "other", (F.col("m") / F.col("total")).alias("shared"))


def differing_segment(a: Column, b: Column) -> tuple[Column, Column]:
    """(common edges at the start, common edges at the end) of two paths; together not more than the shorter path."""
    n = F.least(F.size(a), F.size(b))
    k = F.sequence(F.lit(0), n)
    prefix = F.array_max(F.filter(k, lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    tail = lambda x, i: F.slice(x, F.size(x) - i + 1, i)
    suffix = F.array_max(F.filter(k, lambda i: (i == 0) | (tail(a, F.greatest(i, F.lit(1))) == tail(b, F.greatest(i, F.lit(1))))))
    return prefix, F.least(suffix, n - prefix)


def expansion_factor(meters) -> Column:
    """By how much farther arterial roads are searched if the ends are 25 to 100 km apart."""
    return F.when((c(meters) > 25_000.0) & (c(meters) < 100_000.0), F.least(F.lit(3.0), F.lit(100_000.0) / c(meters))).otherwise(1.0)


def alternate_threshold(cost) -> Column:
    """The cost up to which a search for alternates goes on."""
    return F.lit(1.2) * c(cost) + 420.0


def multi_leg_costs(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, cost) of the way by all stops in their order. stops: query_id, stops array; a query with a leg that cannot be driven has no row."""
    legs = stops.select("query_id", F.posexplode(F.expr("transform(sequence(1, size(stops) - 1), i -> struct(stops[i - 1] as origin, stops[i] as destination))")).alias("leg", "l"))
    legs = legs.select("query_id", "leg", "l.origin", "l.destination")
    each = legs.select("origin", "destination").distinct().withColumn("query_id", F.struct("origin", "destination"))
    found = cheapest_costs(each, edges).select("query_id.origin", "query_id.destination", "cost")
    total = legs.join(found, ["origin", "destination"], "left").groupBy("query_id").agg(F.count("cost").alias("n"), F.count(F.lit(1)).alias("m"), F.sum("cost").alias("cost"))
    return total.where("n = m").select("query_id", "cost")


def recover(shortcuts: DataFrame) -> DataFrame:
    """(shortcut, seq, edge_id): the base edges of shortcuts (shortcut, base array<edge_id>)."""
    return shortcuts.select("shortcut", F.posexplode("base").alias("seq", "edge_id"))


#: Fixed values, by level: transitions to a higher level, and the distance in metres from an end within which a level is searched whole.
UP_TRANSITIONS, EXPAND_WITHIN, NO_LIMIT = (4_294_967_295, 400, 100), (4_294_967_295.0, 100_000.0, 5_000.0), 4_294_967_295


def hierarchy_limits(level, relax: int = 1, expand: float = 1.0) -> tuple[Column, Column]:
    """(transitions, metres) of a level 0, 1 or 2; a second pass relaxes both, but for those without a limit."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), c(level) + 1)
    most, within = pick([x if x == NO_LIMIT else x * relax for x in UP_TRANSITIONS]), pick([x if x == NO_LIMIT else x * expand for x in EXPAND_WITHIN])
    return most.cast("long"), within.cast("double")
