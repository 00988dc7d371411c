"""Queries of the join (JON), aggregate (AGG), window (WIN), sort (SRT), set (SET) and graph ETL groups over the road graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import etl, graph, sorting
from .q_geo import ENDS, HEADING, ends
from .registry import FEED, GRAPH, query


@query("jon01_opposing_edge", f"{GRAPH} SELECT e.edge_id, o.edge_id AS opposing, o.from_node=e.to_node AND o.to_node=e.from_node AS mirrored FROM g_edge e JOIN g_edge o ON o.edge_id=e.opp_edge_id")
def jon01(spark, d):
    e = graph.edges(spark, d)
    o = e.select(F.col("edge_id").alias("opp_edge_id"), F.col("from_node").alias("f"), F.col("to_node").alias("t"))
    return e.join(o, "opp_edge_id").select("edge_id", F.col("opp_edge_id").alias("opposing"), ((F.col("f") == F.col("to_node")) & (F.col("t") == F.col("from_node"))).alias("mirrored"))


@query("jon02_end_nodes", f"{ENDS} SELECT edge_id, lat1, lon1, lat2, lon2 FROM e")
def jon02(spark, d):
    return ends(spark, d).select("edge_id", "lat1", "lon1", "lat2", "lon2")


@query("jon03_outbound_edges", f"{GRAPH} SELECT n.node_id, e.edge_id FROM g_node n JOIN g_edge e ON e.from_node=n.node_id")
def jon03(spark, d):
    return graph.nodes(spark, d).select("node_id").join(graph.edges(spark, d).select(F.col("from_node").alias("node_id"), "edge_id"), "node_id")


@query("jon06_admin_join", f"""{GRAPH}, a AS (SELECT CAST(n_nationkey AS BIGINT) AS admin, n_name AS country FROM nation) SELECT node_id, country FROM g_node JOIN a ON a.admin = node_id % 25""")
def jon06(spark, d):
    a = graph.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("admin"), F.col("n_name").alias("country"))
    return graph.nodes(spark, d).withColumn("admin", F.col("node_id") % 25).join(F.broadcast(a), "admin").select("node_id", "country")  # one row for each country


@query("jon07_access_restrictions", f"{GRAPH}, r AS (SELECT edge_id, edge_id%8 AS modes, 100+edge_id%300 AS v FROM g_edge WHERE edge_id%3=0) SELECT e.edge_id, r.v AS value FROM g_edge e JOIN r ON r.edge_id=e.edge_id WHERE r.modes & 4 <> 0")
def jon07(spark, d):
    e, i = graph.edges(spark, d).select("edge_id"), F.col("edge_id")
    r = e.where(i % 3 == 0).select("edge_id", (i % 8).alias("modes"), (100 + i % 300).alias("value"))
    return e.join(r.where(F.col("modes").bitwiseAND(4) != 0).select("edge_id", "value"), "edge_id")


@query("jon10_live_traffic", f"{FEED}, t AS (SELECT edge_id, max(speed_kph) AS live FROM g_traffic GROUP BY 1) SELECT e.edge_id, e.speed_kph, t.live FROM g_edge e LEFT JOIN t USING (edge_id)")
def jon10(spark, d):
    t = graph.traffic(spark, d).groupBy("edge_id").agg(F.max("speed_kph").alias("live"))
    return graph.edges(spark, d).select("edge_id", "speed_kph").join(t, "edge_id", "left")


@query("jon14_node_incidence", f"{GRAPH}, i AS (SELECT from_node AS node_id, way_id, 1 AS role FROM g_edge UNION ALL SELECT to_node, way_id, 2 FROM g_edge) SELECT node_id, count(DISTINCT way_id) AS ways, bit_or(role) AS roles FROM i GROUP BY 1")
def jon14(spark, d):
    e = graph.edges(spark, d)
    i = e.select(F.col("from_node").alias("node_id"), "way_id", F.lit(1).alias("role")).unionAll(e.select("to_node", "way_id", F.lit(2)))
    return i.groupBy("node_id").agg(F.countDistinct("way_id").alias("ways"), F.bit_or("role").alias("roles"))


@query("jon15_node_edge_incidence", f"{GRAPH}, i AS (SELECT from_node AS node_id, edge_id FROM g_edge UNION ALL SELECT to_node, edge_id FROM g_edge) SELECT node_id, count(*) AS edges, min(edge_id) AS first, max(edge_id) AS last FROM i GROUP BY 1")
def jon15(spark, d):
    e = graph.edges(spark, d)
    i = e.select(F.col("from_node").alias("node_id"), "edge_id").unionAll(e.select("to_node", "edge_id"))
    return i.groupBy("node_id").agg(F.count(F.lit(1)).alias("edges"), F.min("edge_id").alias("first"), F.max("edge_id").alias("last"))


@query("jon18_restriction_markers", f"{GRAPH}, r AS (SELECT edge_id AS a, opp_edge_id AS b FROM g_edge WHERE edge_id%50=0) SELECT e.edge_id, coalesce(bit_or(m.k), 0) AS marks FROM g_edge e LEFT JOIN (SELECT a AS edge_id, 1 AS k FROM r UNION ALL SELECT b, 2 FROM r) m USING (edge_id) GROUP BY 1")
def jon18(spark, d):
    e = graph.different_edges(spark, d).select("edge_id", "opp_edge_id")
    r = e.where("edge_id % 50 = 0")
    m = r.select("edge_id", F.lit(1).alias("k")).unionAll(r.select("opp_edge_id", F.lit(2))).groupBy("edge_id").agg(F.bit_or("k").alias("marks"))
    return e.select("edge_id").join(m, "edge_id", "left").select("edge_id", F.coalesce("marks", F.lit(0)).alias("marks"))


@query("jon19_simple_restriction_mask", f"""{GRAPH}, l AS (SELECT edge_id, from_node, row_number() OVER (PARTITION BY from_node ORDER BY edge_id)-1 AS local FROM g_edge)
SELECT i.edge_id, CAST(sum(1 << CAST(l.local AS INT)) AS BIGINT) AS mask FROM g_edge i JOIN l ON l.from_node=i.to_node WHERE l.local < 8 AND (i.edge_id + l.edge_id) % 7 = 0 GROUP BY 1""")
def jon19(spark, d):
    e = graph.edges(spark, d)
    out = etl.local_index(e).where("local < 8").select(F.col("from_node").alias("to_node"), F.col("edge_id").alias("next"), "local")
    hit = e.select("edge_id", "to_node").join(out, "to_node").where((F.col("edge_id") + F.col("next")) % 7 == 0)
    return hit.groupBy("edge_id").agg(F.sum(F.expr("shiftleft(1L, local)")).alias("mask"))


@query("jon33_hierarchy_join", f"{GRAPH}, h AS (SELECT node_id, CASE WHEN c<=2 THEN 0 WHEN c<=4 THEN 1 ELSE 2 END AS level FROM (SELECT DISTINCT from_node AS node_id, road_class AS c FROM g_edge) t) SELECT node_id, string_agg(DISTINCT CAST(level AS VARCHAR), ',' ORDER BY CAST(level AS VARCHAR)) AS levels FROM h GROUP BY 1")
def jon33(spark, d):
    h = etl.node_levels(graph.edges(spark, d))
    return h.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("level").cast("string"))), ",").alias("levels"))


@query("jon37_speed_dataset", f"{GRAPH}, s AS (SELECT edge_id, 30+edge_id%90 AS free FROM g_edge WHERE edge_id%3=0) SELECT e.edge_id, coalesce(s.free, e.speed_kph) AS kph, s.free IS NOT NULL AS updated FROM g_edge e LEFT JOIN s USING (edge_id)")
def jon37(spark, d):
    e, i = graph.edges(spark, d).select("edge_id", "speed_kph"), F.col("edge_id")
    s = e.where(i % 3 == 0).select("edge_id", (30 + i % 90).alias("free"))
    return e.join(s, "edge_id", "left").select("edge_id", F.coalesce("free", "speed_kph").alias("kph"), F.col("free").isNotNull().alias("updated"))


@query("jon38_semantic_compare", f"""{GRAPH}, b AS (SELECT edge_id, speed_kph + CASE WHEN edge_id%97=0 THEN 1 ELSE 0 END AS speed_kph FROM g_edge WHERE edge_id%89<>0)
SELECT coalesce(a.edge_id,b.edge_id) AS edge_id, CASE WHEN b.edge_id IS NULL THEN 'missing' WHEN a.edge_id IS NULL THEN 'added' ELSE 'changed' END AS difference FROM g_edge a FULL JOIN b ON a.edge_id=b.edge_id WHERE a.speed_kph IS DISTINCT FROM b.speed_kph""")
def jon38(spark, d):
    a = graph.edges(spark, d).select("edge_id", "speed_kph")
    b = a.where("edge_id % 89 <> 0").withColumn("speed_kph", F.col("speed_kph") + F.when(F.col("edge_id") % 97 == 0, 1).otherwise(0))
    return etl.compare(a, b, "edge_id", ["speed_kph"])


@query("jon39_route_matrix_compare", f"""{GRAPH}, a AS (SELECT from_node AS k, CAST(sum(length_m) AS BIGINT) AS v FROM g_edge GROUP BY 1) SELECT k AS case_id, abs(v - (v + k%300)) > 100 AND abs(v-(v+k%300)) > v*0.001e0 AS differs FROM a""")
def jon39(spark, d):
    a = graph.edges(spark, d).groupBy(F.col("from_node").alias("case_id")).agg(F.sum("length_m").cast("long").alias("v"))
    return a.select("case_id", etl.beyond_tolerance(F.col("v"), F.col("v") + F.col("case_id") % 300, 100, 0.001).alias("differs"))


@query("jon41_duplicate_edges", f"{GRAPH} SELECT from_node, to_node, count(*) AS edges FROM (SELECT from_node%50 AS from_node, to_node%5 AS to_node, length_m FROM g_edge) t GROUP BY 1, 2, floor(length_m/1000e0) HAVING count(*)>1")
def jon41(spark, d):
    e = graph.edges(spark, d).select((F.col("from_node") % 50).alias("from_node"), (F.col("to_node") % 5).alias("to_node"), F.floor(F.col("length_m") / 1000.0).alias("l"))
    return e.groupBy("from_node", "to_node", "l").agg(F.count(F.lit(1)).alias("edges")).where("edges > 1").drop("l")


@query("agg10_incidence_summary", f"{GRAPH} SELECT to_node AS node_id, count(*) AS inbound, bit_or(1 << CAST(road_class AS INT)) AS classes FROM g_edge GROUP BY 1")
def agg10(spark, d):
    return graph.edges(spark, d).groupBy(F.col("to_node").alias("node_id")).agg(F.count(F.lit(1)).alias("inbound"), F.bit_or(F.expr("shiftleft(1, int(road_class))")).alias("classes"))


@query("agg24_ferry_speed", f"{GRAPH} SELECT way_id, greatest(1, CAST(floor(sum(length_m)*3.6e0/(600+way_id%600)) AS BIGINT)) AS kph FROM g_edge GROUP BY way_id")
def agg24(spark, d):
    return graph.edges(spark, d).groupBy("way_id").agg(F.sum("length_m").alias("m")).select("way_id", F.greatest(F.lit(1).cast("long"), F.floor(F.col("m") * 3.6 / (600 + F.col("way_id") % 600)).cast("long")).alias("kph"))


@query("agg25_node_bundle", f"{GRAPH} SELECT from_node, min(CASE WHEN edge_id%5<>0 THEN road_class END) AS best_class, CAST(sum(CASE WHEN edge_id%5=0 THEN 1 ELSE 0 END) AS BIGINT) AS links FROM g_edge GROUP BY 1")
def agg25(spark, d):
    link = F.col("edge_id") % 5 == 0
    return graph.edges(spark, d).groupBy("from_node").agg(F.min(F.when(~link, F.col("road_class"))).alias("best_class"), F.sum(link.cast("long")).alias("links"))


LEVELS = "CASE WHEN road_class<=2 THEN 0 WHEN road_class<=4 THEN 1 ELSE 2 END"


@query("agg26_graph_statistics", f"{GRAPH} SELECT {LEVELS} AS level, count(*) AS edges, count(DISTINCT from_node) AS nodes, min(density) AS least, max(density) AS most, CAST(sum(density) AS BIGINT) AS total FROM g_edge GROUP BY 1")
def agg26(spark, d):
    return etl.statistics(graph.edges(spark, d))


@query("agg35_level_rollup", f"{GRAPH} SELECT {LEVELS} AS level, count(*) AS edges FROM g_edge GROUP BY ROLLUP(1)")
def agg35(spark, d):
    from ..functions.keys import level_of_class

    return graph.edges(spark, d).select(level_of_class("road_class").alias("level")).rollup("level").agg(F.count(F.lit(1)).alias("edges"))


@query("agg28_filter_statistics", f"{GRAPH} SELECT count(*) AS edges, CAST(sum(CASE WHEN road_class<3 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM g_edge")
def agg28(spark, d):
    return graph.edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("road_class") < 3).alias("kept"))


PATH = f"{GRAPH}, p AS (SELECT from_node AS route, edge_id, length_m, speed_kph, row_number() OVER (PARTITION BY from_node ORDER BY edge_id) AS seq FROM g_edge)"


def path(spark, d):
    return graph.edges(spark, d).select(F.col("from_node").alias("route"), "edge_id", "length_m", "speed_kph").withColumn("seq", F.row_number().over(Window.partitionBy("route").orderBy("edge_id")).cast("long"))


@query("win01_neighbour_edges", f"{PATH} SELECT edge_id, lag(edge_id) OVER w AS previous, lead(edge_id) OVER w AS following FROM p WINDOW w AS (PARTITION BY route ORDER BY seq)")
def win01(spark, d):
    w = Window.partitionBy("route").orderBy("seq")
    return path(spark, d).select("edge_id", F.lag("edge_id").over(w).alias("previous"), F.lead("edge_id").over(w).alias("following"))


@query("win02_running_cost", f"{PATH} SELECT edge_id, CAST(sum(length_m) OVER (PARTITION BY route ORDER BY seq) AS BIGINT) AS meters, CAST(sum(CAST(floor(length_m*3.6e0/speed_kph+0.5e0) AS BIGINT)) OVER (PARTITION BY route ORDER BY seq) AS BIGINT) AS seconds FROM p")
def win02(spark, d):
    w = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return path(spark, d).select("edge_id", F.sum("length_m").over(w).cast("long").alias("meters"), F.sum(scalar.travel_seconds("length_m", "speed_kph")).over(w).alias("seconds"))


@query("agg21_cost_along_path", f"{PATH} SELECT route, max(seq) AS edges, CAST(sum(length_m) AS BIGINT) AS meters FROM p GROUP BY route")
def agg21(spark, d):
    return path(spark, d).groupBy("route").agg(F.max("seq").alias("edges"), F.sum("length_m").cast("long").alias("meters"))


@query("agg22_segment_cost", f"{PATH} SELECT route, CAST(sum(length_m) AS BIGINT) AS meters FROM p WHERE seq BETWEEN 2 AND 4 GROUP BY route")
def agg22(spark, d):
    return path(spark, d).where("seq between 2 and 4").groupBy("route").agg(F.sum("length_m").cast("long").alias("meters"))


@query("win03_leg_stitching", f"{PATH}, l AS (SELECT route, (seq-1)//3 AS leg, CAST(sum(length_m) AS BIGINT) AS m FROM p GROUP BY 1,2) SELECT route, leg, CAST(coalesce(sum(m) OVER (PARTITION BY route ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS starts_at FROM l")
def win03(spark, d):
    legs = path(spark, d).groupBy("route", F.floor((F.col("seq") - 1) / 3).alias("leg")).agg(F.sum("length_m").cast("long").alias("m"))
    w = Window.partitionBy("route").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    return legs.select("route", "leg", F.coalesce(F.sum("m").over(w), F.lit(0).cast("long")).alias("starts_at"))


@query("win11_collapse_runs", f"{PATH}, f AS (SELECT *, CASE WHEN lag(speed_kph//10) OVER (PARTITION BY route ORDER BY seq) IS DISTINCT FROM speed_kph//10 THEN 1 ELSE 0 END AS s FROM p), g AS (SELECT *, sum(s) OVER (PARTITION BY route ORDER BY seq) AS run FROM f) SELECT route, CAST(run AS BIGINT) AS run, min(seq) AS first, count(*) AS edges FROM g GROUP BY 1,2")
def win11(spark, d):
    return etl.collapse_runs(path(spark, d), "route", "seq", F.floor(F.col("speed_kph") / 10))


@query("win10_nearest_per_group", f"{PATH}, q AS (SELECT *, min(length_m) OVER (PARTITION BY route) AS best FROM p) SELECT route, edge_id FROM q WHERE length_m <= best + 1")
def win10(spark, d):
    return path(spark, d).withColumn("best", F.min("length_m").over(Window.partitionBy("route"))).where("length_m <= best + 1").select("route", "edge_id")


@query("win05_best_per_group", f"{PATH}, q AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY speed_kph DESC, length_m, edge_id) AS r FROM p) SELECT route, edge_id FROM q WHERE r=1")
def win05(spark, d):
    return path(spark, d).groupBy("route").agg(F.min_by("edge_id", F.struct(-F.col("speed_kph"), "length_m", "edge_id")).alias("edge_id"))


@query("srt04_sort_nodes", f"{GRAPH}, t AS (SELECT node_id, CAST(floor((lat+90e0)/0.25e0) AS BIGINT)*1440+CAST(floor((lon+180e0)/0.25e0) AS BIGINT) AS tile FROM g_node) SELECT node_id, tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY node_id)-1 AS BIGINT) AS idx FROM t WHERE node_id <> 1000000 OR true")
def srt04(spark, d):
    n = graph.nodes(spark, d).select("node_id", geo.tile_id("lat", "lon", 2).alias("tile"))
    return n.select("node_id", "tile", (F.row_number().over(Window.partitionBy("tile").orderBy("node_id")) - 1).cast("long").alias("idx"))


@query("srt07_bin_sort", f"{GRAPH} SELECT density AS bin, edge_id, CAST(row_number() OVER (PARTITION BY density ORDER BY edge_id) AS BIGINT) AS place FROM g_edge")
def srt07(spark, d):
    return sorting.places(graph.edges(spark, d).select(F.col("density").alias("bin"), "edge_id"), [F.col("edge_id")], "bin").select("bin", "edge_id", "place")


@query("srt11_alternates_limit", f"{PATH}, q AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY length_m, edge_id) AS r FROM p) SELECT route, edge_id FROM q WHERE r<=3")
def srt11(spark, d):
    return path(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("route").orderBy("length_m", "edge_id"))).where("r <= 3").select("route", "edge_id")


@query("set01_union_of_parts", "SELECT CAST(c_custkey AS BIGINT) AS id, 'customer' AS kind FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'supplier' FROM supplier")
def set01(spark, d):
    a = graph.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(graph.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("id")))


@query("set02_merge_distinct", "SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 40 UNION SELECT s_suppkey FROM supplier")
def set02(spark, d):
    a = graph.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("id"))
    return a.unionByName(graph.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).dropDuplicates()


@query("set03_common_names", f"{GRAPH} SELECT edge_id, [road_class] = [density % 8] AS shared FROM g_edge")
def set03(spark, d):
    name = lambda x: F.array(F.concat(F.lit("North Road "), F.col(x).cast("string")))
    e = graph.edges(spark, d).withColumn("d8", F.col("density") % 8)
    base = lambda a: F.transform(a, scalar.base_name)
    return e.select("edge_id", (F.size(F.array_intersect(base(name("road_class")), base(name("d8")))) > 0).alias("shared"))


@query("set04_route_numbers", "SELECT p_partkey, CAST(1 AS INT) AS numbers, CAST(2 AS INT) AS names FROM part")
def set04(spark, d):
    a = F.array(F.concat(F.lit("US "), F.col("p_partkey").cast("string")), F.concat(F.trim("p_brand"), F.lit(" Avenue")), F.lit("Main Street"))
    return graph.table(spark, d, "part").select("p_partkey", F.size(F.filter(a, scalar.is_route_number)).alias("numbers"), F.size(F.filter(a, lambda x: ~scalar.is_route_number(x))).alias("names"))


@query("set05_key_union", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) t")
def set05(spark, d):
    return graph.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(graph.table(spark, d, "customer").select("c_custkey")).distinct()


@query("set06_ordered_distinct", f"{FEED} SELECT edge_id, string_agg(DISTINCT provider_id, ',' ORDER BY provider_id) AS providers FROM g_traffic GROUP BY 1")
def set06(spark, d):
    return graph.traffic(spark, d).groupBy("edge_id").agg(F.array_join(F.sort_array(F.collect_set("provider_id")), ",").alias("providers"))


@query("set07_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set07(spark, d):
    return graph.table(spark, d, "customer").join(graph.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("etl05_intersections", f"{GRAPH}, u AS (SELECT from_node AS node_id, way_id FROM g_edge UNION SELECT to_node, way_id FROM g_edge) SELECT node_id, count(*) > 1 AS intersection FROM u GROUP BY 1")
def etl05(spark, d):
    e = graph.edges(spark, d)
    u = e.select(F.col("from_node").alias("node_id"), "way_id").union(e.select("to_node", "way_id"))
    return u.groupBy("node_id").agg((F.countDistinct("way_id") > 1).alias("intersection"))


@query("etl07_split_ways", """WITH w AS (SELECT o_custkey AS way_id, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey%3=0 AS cross_ FROM orders),
x AS (SELECT *, max(pos) OVER (PARTITION BY way_id) AS last FROM w), y AS (SELECT *, sum(CASE WHEN cross_ AND pos>1 AND pos<last THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS upto, (cross_ AND pos>1 AND pos<last) AS cut FROM x),
z AS (SELECT way_id, upto AS edge, node FROM y UNION ALL SELECT way_id, upto-1, node FROM y WHERE cut) SELECT way_id, CAST(edge AS BIGINT) AS edge, count(*) AS nodes, min(node) AS first, max(node) AS last FROM z GROUP BY 1,2""")
def etl07(spark, d):
    o = graph.table(spark, d, "orders").select(F.col("o_custkey").alias("way_id"), F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 3 == 0).alias("crossing"))
    o = o.withColumn("pos", F.row_number().over(Window.partitionBy("way_id").orderBy("node")))
    return etl.split_ways(o).groupBy("way_id", "edge").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first"), F.max("node").alias("last"))


@query("etl16_headings", f"""{ENDS}, l AS (SELECT *, row_number() OVER (PARTITION BY from_node ORDER BY edge_id)-1 AS local, {HEADING} AS h FROM e) SELECT from_node, CAST(local AS BIGINT) AS local, edge_id, floor(h*1e3+0.5e0)/1e3 AS heading FROM l WHERE local < 8""")
def etl16(spark, d):
    e = etl.local_index(ends(spark, d)).where("local < 8")
    return e.select("from_node", "local", "edge_id", geo.milli(geo.heading("lat1", "lon1", "lat2", "lon2"), 1e3).alias("heading"))


@query("etl17_opposing_index", f"""{GRAPH}, l AS (SELECT edge_id, row_number() OVER (PARTITION BY from_node ORDER BY edge_id)-1 AS local FROM g_edge) SELECT e.edge_id, CAST(l.local AS BIGINT) AS opp_index FROM g_edge e JOIN l ON l.edge_id=e.opp_edge_id""")
def etl17(spark, d):
    e = graph.edges(spark, d)
    return e.select("edge_id", "opp_edge_id").join(etl.local_index(e).select(F.col("edge_id").alias("opp_edge_id"), F.col("local").alias("opp_index")), "opp_edge_id").select("edge_id", "opp_index")


@query("etl19_enhanced_speed", f"""{GRAPH} SELECT edge_id, CAST(floor(CASE WHEN edge_id%7=0 THEN speed_kph*CASE WHEN density>8 THEN 0.8e0 ELSE 0.85e0 END WHEN edge_id%11=0 THEN speed_kph*0.5e0 WHEN edge_id%13=0 THEN speed_kph*1.25e0 WHEN edge_id%17=0 THEN speed_kph*0.5e0 WHEN edge_id%19=0 THEN 10e0 WHEN edge_id%23=0 THEN 15e0 ELSE speed_kph END+0.5e0) AS BIGINT) AS kph FROM g_edge""")
def etl19(spark, d):
    i = F.col("edge_id")
    v = etl.enhanced_speed("speed_kph", "density", ramp=i % 7 == 0, roundabout=i % 11 == 0, turn_channel=i % 13 == 0, unpaved=i % 17 == 0, driveway=i % 19 == 0, aisle=i % 23 == 0)
    return graph.edges(spark, d).select("edge_id", v.alias("kph"))


@query("etl20_name_consistency", "SELECT p_partkey, p_partkey%4=0 OR p_partkey%3=0 AS consistent FROM part")
def etl20(spark, d):
    i = F.col("p_partkey")
    a = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("North Main Street")))
    b = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 3 == 0, F.array(F.lit("Main Street East"))).otherwise(F.array(F.lit("Oak Street")))
    return graph.table(spark, d, "part").select("p_partkey", etl.names_consistent(a, b).alias("consistent"))


@query("etl21_edge_transitions", f"""{GRAPH}, l AS (SELECT edge_id, opp_edge_id, from_node, row_number() OVER (PARTITION BY from_node ORDER BY edge_id)-1 AS local FROM g_edge)
SELECT i.opp_edge_id AS inbound, CAST(i.local AS BIGINT) AS local, o.edge_id AS outbound, i.edge_id = o.edge_id AS u_turn FROM l i JOIN g_edge o ON o.from_node=i.from_node WHERE i.local < 8""")
def etl21(spark, d):
    """From each of a node's first eight edges, which are all that a transition can name, driven towards the node, into each edge that leaves it."""
    e = graph.edges(spark, d)
    local = (F.row_number().over(Window.partitionBy("from_node").orderBy("edge_id")) - 1).cast("long")
    i = e.select("from_node", F.col("edge_id").alias("own"), F.col("opp_edge_id").alias("inbound"), local.alias("local")).where("local < 8")
    return i.join(e.select("from_node", F.col("edge_id").alias("outbound")), "from_node").select("inbound", "local", "outbound", (F.col("own") == F.col("outbound")).alias("u_turn"))


@query("etl26_hierarchy_transitions", f"{GRAPH}, h AS (SELECT DISTINCT from_node AS node_id, {LEVELS} AS level FROM g_edge) SELECT a.node_id, a.level AS from_level, b.level AS to_level FROM h a JOIN h b ON a.node_id=b.node_id AND a.level<>b.level")
def etl26(spark, d):
    return etl.transitions(etl.node_levels(graph.edges(spark, d)))


@query("etl34_validate_graph", f"""{GRAPH} SELECT CAST(sum(CASE WHEN o.edge_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN o.opp_edge_id=e.edge_id THEN 1 ELSE 0 END) AS BIGINT) AS involutions, CAST(sum(CASE WHEN o.length_m<>e.length_m THEN 1 ELSE 0 END) AS BIGINT) AS uneven FROM g_edge e LEFT JOIN g_edge o ON o.edge_id=e.opp_edge_id""")
def etl34(spark, d):
    return etl.validate(graph.edges(spark, d))


@query("agg01_node_density", f"""{GRAPH}, cell AS (SELECT node_id, CAST(floor(lat/0.02e0) AS BIGINT) AS r, CAST(floor(lon/0.02e0) AS BIGINT) AS c FROM g_node),
load AS (SELECT r, c, sum(CAST(length_m AS BIGINT)) AS m FROM g_edge JOIN cell ON node_id=from_node GROUP BY 1,2),
tot AS (SELECT n.node_id, CAST(sum(l.m) AS BIGINT) AS m FROM cell n JOIN load l ON l.r BETWEEN n.r-1 AND n.r+1 AND l.c BETWEEN n.c-1 AND n.c+1 GROUP BY 1)
SELECT node_id, least(15, m//100000) AS density FROM tot""")
def agg01(spark, d):
    return etl.node_density(graph.nodes(spark, d), graph.edges(spark, d))


@query("etl39_service_calendar", """WITH s AS (SELECT CAST(c_custkey AS BIGINT) AS service_id, c_custkey % 128 AS mask, c_custkey % 30 AS a, c_custkey % 30 + 20 AS b FROM customer),
r AS (SELECT service_id, k FROM s, range(60) t(k) WHERE k BETWEEN a AND b AND (mask >> CAST((dayofweek(DATE '2024-01-01' + CAST(k AS INT))+6) % 7 AS INT)) & 1 = 1 AND NOT (service_id%3=0 AND k=a) UNION SELECT service_id, 59 FROM s WHERE service_id%3=1),
t AS (SELECT service_id, CAST(sum(1::BIGINT << CAST(k AS INT)) AS BIGINT) AS days FROM r GROUP BY 1) SELECT service_id, coalesce(days,0) AS days FROM s LEFT JOIN t USING (service_id)""")
def etl39(spark, d):
    from ..sources import gtfs

    k, start = F.col("service_id"), F.lit("2024-01-01").cast("date")
    s = graph.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("service_id"))
    calendar = s.select("service_id", *[F.expr(f"shiftright(service_id % 128, {i})").bitwiseAND(1).alias(x) for i, x in enumerate(gtfs.DAYS)], F.date_add(start, (k % 30).cast("int")).alias("start_date"), F.date_add(start, (k % 30 + 20).cast("int")).alias("end_date"))
    off = s.where(k % 3 == 0).select("service_id", F.date_add(start, (k % 30).cast("int")).alias("date"), F.lit(2).alias("exception_type"))
    on = s.where(k % 3 == 1).select("service_id", F.date_add(start, 59).alias("date"), F.lit(1).alias("exception_type"))
    return gtfs.service_bits(calendar, off.unionAll(on), "2024-01-01")


@query("jon36_consecutive_stops", "WITH t AS (SELECT o_custkey AS trip, o_orderkey AS stop, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT a.trip, a.stop AS from_stop, b.stop AS to_stop FROM t a JOIN t b ON a.trip=b.trip AND b.n=a.n+1")
def jon36(spark, d):
    w = Window.partitionBy("trip").orderBy("from_stop")
    o = graph.table(spark, d, "orders").select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("from_stop"))
    return o.withColumn("to_stop", F.lead("from_stop").over(w)).where("to_stop is not null")
