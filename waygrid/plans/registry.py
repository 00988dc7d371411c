"""Where queries register under their operator's id, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: The road graph and the traffic feed that the test tables stand for, as common table expressions for DuckDB, each made once a query.
NODE = """g_node AS MATERIALIZED (
  SELECT node_id, 36e0 + ((node_id*7919) % 10000)/2e4 AS lat, -87e0 + ((node_id*104729) % 10000)/2e4 AS lon
  FROM (SELECT CAST(p_partkey AS BIGINT) AS node_id FROM part UNION ALL SELECT CAST(1000000 + s_suppkey AS BIGINT) FROM supplier) t)"""
BASE = """g_base AS MATERIALIZED (
  SELECT l_partkey AS a, 1000000 + l_suppkey AS b, l_partkey*100000 + l_suppkey AS way_id,
    CAST(min(l_quantity) AS BIGINT)+20 AS speed_kph, min(l_linenumber) % 8 AS road_class,
    max(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS toll, min(l_suppkey) % 16 AS density
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
EDGE = """g_edge AS MATERIALIZED (
  SELECT e.way_id*2+k AS edge_id, e.way_id*2+1-k AS opp_edge_id, e.way_id,
    CASE WHEN k=0 THEN a ELSE b END AS from_node, CASE WHEN k=0 THEN b ELSE a END AS to_node, speed_kph, road_class, toll, density,
    greatest(1e0, floor(0.5e0 + 2e0*6378160.187e0*asin(sqrt(power(sin(radians(nb.lat-na.lat)/2e0),2)
      + cos(radians(na.lat))*cos(radians(nb.lat))*power(sin(radians(nb.lon-na.lon)/2e0),2))))) AS length_m
  FROM g_base e JOIN g_node na ON na.node_id=e.a JOIN g_node nb ON nb.node_id=e.b CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk)"""
TRAFFIC = """g_traffic AS MATERIALIZED (
  SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'here' ELSE 'tomtom' END AS provider_id,
    CASE event_type WHEN 'error' THEN 'incident' WHEN 'purchase' THEN 'closure' WHEN 'signup' THEN 'restriction' ELSE 'flow' END AS kind,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS layer, event_type='purchase' AS closed,
    event_id % 5 <> 0 AS direction_resolved, CAST(floor(value + 0.5e0) AS BIGINT) % 100 AS confidence_pct, ts AS freshness, e.way_id * 2 + event_id % 2 AS edge_id,
    CAST(floor(value) AS BIGINT) % 130 AS speed_kph, CAST(floor(value * 7e0) AS BIGINT) % 900 AS delay_s
  FROM events ev JOIN (SELECT a, min(way_id) AS way_id FROM g_base GROUP BY a) e ON e.a = (CAST(ev.user_id AS BIGINT)*7919 + event_id % 4) % (SELECT count(*) FROM part))"""
GRAPH = f"WITH {NODE}, {BASE}, {EDGE}"
FEED = f"{GRAPH}, {TRAFFIC}"
