"""The path queries over all origins against Dijkstra on the smallest tables, and the rounds that their SQL needs."""

import heapq

import pytest

from waygrid.operators import search
from waygrid.plans import q_route
from waygrid.plans.q_route import costed


def dijkstra(out, s):
    best, todo = {}, [(0, s)]
    while todo:
        c, n = heapq.heappop(todo)
        if n not in best:
            best[n] = c
            for m, more in out.get(n, ()):
                heapq.heappush(todo, (c + more, m))
    return best


def brute(edges, queries):
    out = {}
    for r in edges:
        out.setdefault(r.from_node, []).append((r.to_node, r.cost))
    return {q.query_id: b[q.destination] for q in queries if q.destination in (b := dijkstra(out, q.origin))}


def test_every_origin_is_answered_and_equals_dijkstra(spark, sf):
    edges, queries = costed(spark, sf).collect(), q_route.queries(spark, sf).collect()
    want = brute(edges, queries)
    got = {r.query_id: r for r in q_route.paths(spark, sf).collect()}
    by = {e.edge_id: e for e in edges}
    assert {q: r.cost for q, r in got.items()} == want and len(want) > 12
    for q in queries:
        if r := got.get(q.query_id):
            at = q.origin
            for e in r.path:
                assert by[e].from_node == at
                at = by[e].to_node
            assert at == q.destination and sum(by[e].cost for e in r.path) == r.cost
    assert max(len(r.path) for r in got.values()) < q_route.ROUNDS - 1


def test_retry_answers_by_the_strict_graph_first(spark, sf):
    edges, queries = costed(spark, sf).collect(), q_route.queries(spark, sf).collect()
    strict = brute([r for r in edges if r.toll == 0], queries)
    want = brute(edges, queries) | strict
    assert {r.query_id: r.cost for r in q_route.pth18(spark, sf).collect()} == want


@pytest.mark.parametrize("few", ["origin", "destination"])
def test_a_way_may_be_long(spark, few):
    """A line of 24 edges with dearer short cuts; trees from the side that has fewer ends."""
    rows = [(2 * k + d, 2 * k + 1 - d, k + d, k + 1 - d, 1) for k in range(24) for d in (0, 1)] + [(1000 + k, -1, k, k + 10, 11) for k in range(0, 20, 10)]
    edges = spark.createDataFrame(rows, "edge_id long, opp_edge_id long, from_node long, to_node long, cost long")
    ends = [(0, k) for k in (24, 9, 0, 500)] if few == "origin" else [(k, 24) for k in (0, 9, 24, 500)]
    q = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ends)], "query_id long, origin long, destination long")
    got = {r.query_id: r for r in search.cheapest_paths(q, edges).collect()}
    assert {k: (r.cost, list(r.path)) for k, r in got.items()} == {k: (b - a, list(range(2 * a, 2 * b, 2))) for k, (a, b) in enumerate(ends) if 500 not in (a, b)}
