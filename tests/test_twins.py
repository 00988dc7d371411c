"""Queries on tables in which parts and suppliers share ids, as they do in large copies, and parts whose work must not grow with crowds."""

import os
import time
from collections import Counter

import duckdb
import pytest
from test_queries import plain

from waygrid.operators import search, snap
from waygrid.plans import catalog


@pytest.fixture(scope="module")
def twins(sf, tmp_path_factory):
    """A quarter of the parts have the ids that suppliers have in the graph."""
    at = tmp_path_factory.mktemp("twins")
    for name in os.listdir(sf):
        table = name.removesuffix(".parquet")
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(table)
        shared = f" replace (case when {key}%4=0 then 1000000+{key}//4 else {key} end as {key})" if key else ""
        duckdb.execute(f"copy (select *{shared} from '{sf}/{name}') to '{at}/{name}'")
    return str(at)


NAMES = [
    "jon24_nearest_in_tile",
    "jon22_snap_to_node",
    "geo11_interpolate",
    "geo23_self_crossings",
    "prj14_polyline_round_trip",
    "flt11_access_evaluation",
    "flt16_bridging_edge",
    "agg01_node_density",
    "agg23_shared_length",
    "pth13_differing_segment",
    "geo05_heading_along",
    "jon09_predicted_speed",
    "jon18_restriction_markers",
    "ops06_semantic_differential",
    "trf18_control_index",
    "geo13_closest_on_line",
    "pth04_cheapest_path",
    "pth06_form_path",
    "pth08_bidirectional_meet",
    "pth09_alternate_threshold",
    "pth15_recost",
    "pth18_retry_failed",
    "pth19_multi_leg",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_where_ids_are_shared(spark, twins, name):
    df, db = catalog.QUERIES[name](spark, twins), duckdb.connect()
    for file in os.listdir(twins):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{twins}/{file}'")
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.toArrow().to_pylist())
    found = db.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_nearest_in_tile_of_many_nodes_at_one_place(spark, tmp_path):
    """120,000 nodes at 10,000 places: all pairs of a tile took more than a minute on eight cores."""
    duckdb.execute(f"copy (select range as p_partkey from range(120000)) to '{tmp_path}/part.parquet'")
    duckdb.execute(f"copy (select range as s_suppkey from range(1)) to '{tmp_path}/supplier.parquet'")
    began = time.time()
    got = {r.station: r.nearest for r in catalog.QUERIES["jon24_nearest_in_tile"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60 and len(got) == 17_143 and all(got[k] % 10_000 == k % 10_000 and got[k] < 20_000 for k in got if k < 100_000)


def test_snap_of_many_points_to_many_nodes_at_one_place(spark):
    crowd = spark.range(60_000).selectExpr("id as point_id", "1.0D as lat", "2.0D as lon")
    began = time.time()
    got = snap.nearest_nodes(crowd, crowd.withColumnRenamed("point_id", "node_id")).selectExpr("count(*) n", "max(node_id) node", "max(meters) m").first()
    assert tuple(got) == (60_000, 0, 0.0) and time.time() - began < 60


def test_a_search_keeps_its_edges_and_shares_rows_among_roots(spark, monkeypatch):
    """40 roots, more than a row holds, on a ring of 40 nodes with edges that cost nothing."""
    names, stage = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    rows = [(2 * k + d, 2 * k + 1 - d, (k + d) % 40, (k + 1 - d) % 40, k % 2) for k in range(40) for d in (0, 1)]
    edges = spark.createDataFrame(rows, "edge_id long, opp_edge_id long, from_node long, to_node long, cost long")
    q = spark.createDataFrame([(k, k, (k + 4) % 40) for k in range(40)], "query_id long, origin long, destination long")
    got = {r.query_id: (r.cost, len(r.path)) for r in search.cheapest_paths(q, edges).collect()}
    assert got == {k: (2, 4) for k in range(40)} and names.count("tree-edges") == 1


@pytest.mark.parametrize("name", ["geo11_interpolate", "geo23_self_crossings", "prj14_polyline_round_trip"])
def test_edges_meet_their_nodes_once(spark, sf, name):
    """The ends' places come with the edges, and rows are repeated after the work on them."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
