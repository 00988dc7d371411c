"""Further queries of all groups over the road graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, keys, scalar
from ..functions.geo import milli
from ..operators import components, costing, filters, graph, polygons, sorting, trip
from .q_geo import ENDS, ends
from .q_graph import PATH, path
from .q_route import leaving
from .registry import FEED, GRAPH, query


@query("agg02_curvature", f"{GRAPH}, t AS (SELECT edge_id, 100e0+edge_id%1900 AS r FROM g_edge) SELECT edge_id, CAST(least(15, floor(CASE WHEN r>1000 THEN 0e0 ELSE least(1500e0/r, 25e0) END)) AS BIGINT) AS curvature FROM t")
def agg02(spark, d):
    r = 100.0 + F.col("edge_id") % 1900
    return graph.edges(spark, d).select("edge_id", F.least(F.lit(15).cast("long"), F.floor(F.when(r > 1000, 0.0).otherwise(F.least(F.lit(1500.0) / r, F.lit(25.0))))).alias("curvature"))


@query("agg03_weighted_grade", f"""{GRAPH}, g AS (SELECT edge_id, [least(15e0,greatest(-10e0,(edge_id%41)-20e0)), least(15e0,greatest(-10e0,(edge_id%29)-14e0)), least(15e0,greatest(-10e0,(edge_id%7)-3e0))] AS a FROM g_edge),
w AS (SELECT edge_id, a, list_transform(a, lambda x: CASE WHEN x>0 THEN 1e0+x/7e0 ELSE 1e0+x/17e0 END) AS w FROM g)
SELECT edge_id, CAST(trunc(0.6e0*((a[1]*w[1]+a[2]*w[2]+a[3]*w[3])/(w[1]+w[2]+w[3]))+6.5e0) AS BIGINT) AS factor FROM w""")
def agg03(spark, d):
    e = F.col("edge_id")
    clamp = lambda x: F.least(F.lit(15.0), F.greatest(F.lit(-10.0), x))
    a = F.array(clamp(e % 41 - 20.0), clamp(e % 29 - 14.0), clamp(e % 7 - 3.0))
    weight = lambda x: F.when(x > 0, 1.0 + x / 7.0).otherwise(1.0 + x / 17.0)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate("a", zero, lambda t, x: F.struct((t["s"] + x * weight(x)).alias("s"), (t["w"] + weight(x)).alias("w")))
    return graph.edges(spark, d).select("edge_id", a.alias("a")).withColumn("t", total).select("edge_id", (F.lit(0.6) * (F.col("t.s") / F.col("t.w")) + 6.5).cast("long").alias("factor"))


@query("agg04_elevation_extremes", f"{GRAPH} SELECT road_class, max(CASE WHEN edge_id%9<>0 THEN edge_id%50 END) AS up, min(CASE WHEN edge_id%9<>0 THEN -(edge_id%40) END) AS down, CAST(sum(CASE WHEN edge_id%9<>0 THEN edge_id%1000 END) AS BIGINT) AS total FROM g_edge GROUP BY 1")
def agg04(spark, d):
    known = lambda x: F.when(F.col("edge_id") % 9 != 0, x)
    e = F.col("edge_id")
    return graph.edges(spark, d).groupBy("road_class").agg(F.max(known(e % 50)).alias("up"), F.min(known(-(e % 40))).alias("down"), F.sum(known(e % 1000)).alias("total"))


@query("agg27_validator_statistics", f"{GRAPH} SELECT CASE WHEN road_class<=2 THEN 0 WHEN road_class<=4 THEN 1 ELSE 2 END AS level, count(DISTINCT way_id) AS ways, CAST(sum(CASE WHEN edge_id%2=0 THEN 1 ELSE 0 END) AS BIGINT) AS forward, string_agg(DISTINCT lpad(CAST(density AS VARCHAR),2,'0'), ',' ORDER BY lpad(CAST(density AS VARCHAR),2,'0')) AS densities FROM g_edge GROUP BY 1")
def agg27(spark, d):
    return graph.edges(spark, d).groupBy(keys.level_of_class("road_class").alias("level")).agg(F.countDistinct("way_id").alias("ways"), F.count_if(F.col("edge_id") % 2 == 0).alias("forward"), F.array_join(F.sort_array(F.collect_set(F.lpad(F.col("density").cast("string"), 2, "0"))), ",").alias("densities"))


@query("agg31_side_counts", f"{GRAPH}, i AS (SELECT from_node, edge_id%360 AS g, road_class FROM g_edge) SELECT from_node, CAST(sum(CASE WHEN g BETWEEN 1 AND 179 THEN 1 ELSE 0 END) AS BIGINT) AS right_side, CAST(sum(CASE WHEN g>180 THEN 1 ELSE 0 END) AS BIGINT) AS left_side, CAST(sum(CASE WHEN g>180 AND road_class<3 THEN 1 ELSE 0 END) AS BIGINT) AS left_major FROM i GROUP BY 1")
def agg31(spark, d):
    g = F.col("edge_id") % 360
    return graph.edges(spark, d).groupBy("from_node").agg(F.count_if(g.between(1, 179)).alias("right_side"), F.count_if(g > 180).alias("left_side"), F.count_if((g > 180) & (F.col("road_class") < 3)).alias("left_major"))


@query("agg32_friction_inputs", f"{PATH.replace('length_m, speed_kph', 'length_m, speed_kph, toll, road_class')} SELECT route, count(*) AS maneuvers, CAST(sum(toll) AS BIGINT) AS tolls, CAST(sum(CASE WHEN road_class<=1 THEN 1 ELSE 0 END) AS BIGINT) AS highways FROM p GROUP BY 1")
def agg32(spark, d):
    return graph.edges(spark, d).groupBy(F.col("from_node").alias("route")).agg(F.count(F.lit(1)).alias("maneuvers"), F.sum("toll").cast("long").alias("tolls"), F.count_if(F.col("road_class") <= 1).alias("highways"))


@query("agg34_sketches", f"{GRAPH} SELECT road_class, count(*) AS edges, true AS count_is_close, true AS median_is_close FROM g_edge GROUP BY 1")
def agg34(spark, d):
    """A sketch's distinct count (standard error 2 %) within 12 % of the exact one, and its median between the exact 45th and 55th percentiles."""
    by = graph.edges(spark, d).groupBy("road_class").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("to_node").alias("exact"), F.approx_count_distinct("to_node", 0.02).alias("about"), F.percentile_approx("length_m", 0.5, 1000).alias("median"), F.percentile("length_m", F.array(F.lit(0.45), F.lit(0.55))).alias("around"))
    close = F.abs(F.col("about") - F.col("exact")) <= F.col("exact") * 0.12 + 1
    return by.select("road_class", "edges", close.alias("count_is_close"), F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_is_close"))


MODIFIERS = f"""{FEED}, n AS (SELECT event_id, kind, edge_id FROM g_traffic WHERE direction_resolved)"""


@query("agg12_modifier_components", f"{MODIFIERS}, c AS (SELECT kind, edge_id, min(event_id) AS root FROM n GROUP BY 1,2 HAVING count(*) > 1) SELECT root, count(*) AS updates FROM n JOIN c USING (kind, edge_id) GROUP BY 1")
def agg12(spark, d):
    n = graph.traffic(spark, d).where("direction_resolved").select("event_id", "kind", "edge_id")
    w = Window.partitionBy("kind", "edge_id").orderBy("event_id")
    links = n.select(F.col("event_id").alias("a"), F.lag("event_id").over(w).alias("b")).where("b is not null")
    return components.components(links).groupBy("root").agg(F.count(F.lit(1)).alias("updates"))


@query("jon20_point_in_polygon", """WITH g AS (SELECT CAST(c_custkey AS BIGINT) AS point_id, -87e0+((c_custkey*3571) % 10000)/2e4 AS x, 36e0+((c_custkey*6151) % 10000)/2e4 AS y FROM customer),
z AS (SELECT CAST(r_regionkey AS BIGINT) AS polygon_id, -86.9e0+r_regionkey*0.08e0 AS cx, 36.1e0+r_regionkey*0.07e0 AS cy FROM region)
SELECT point_id, min(polygon_id) AS polygon_id FROM g, z WHERE abs(x-cx)+abs(y-cy) < 0.123456789e0 GROUP BY 1""")
def jon20(spark, d):
    k = F.col("c_custkey")
    p = graph.table(spark, d, "customer").select(k.cast("long").alias("point_id"), (F.lit(-87.0) + k * 3571 % 10_000 / F.lit(2e4)).alias("x"), (F.lit(36.0) + k * 6151 % 10_000 / F.lit(2e4)).alias("y"))
    r, s = F.col("r_regionkey"), 0.123456789
    cx, cy = F.lit(-86.9) + r * 0.08, F.lit(36.1) + r * 0.07
    ring = F.array(*[F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in ((s, 0.0), (0.0, s), (-s, 0.0), (0.0, -s), (s, 0.0))])
    return polygons.covering(p, graph.table(spark, d, "region").select(r.cast("long").alias("polygon_id"), ring.alias("ring")))


@query("jon24_nearest_in_tile", f"""{GRAPH}, t AS (SELECT *, CAST(floor(lat/0.1e0) AS BIGINT)*100000+CAST(floor(lon/0.1e0) AS BIGINT) AS tile FROM g_node), s AS (SELECT * FROM t WHERE node_id%7=0), o AS (SELECT * FROM t WHERE node_id%7<>0),
x AS (SELECT s.node_id AS station, o.node_id AS nearest, row_number() OVER (PARTITION BY s.node_id ORDER BY (s.lat-o.lat)*(s.lat-o.lat)+(s.lon-o.lon)*(s.lon-o.lon), o.node_id) AS r FROM s JOIN o USING (tile)) SELECT station, nearest FROM x WHERE r=1""")
def jon24(spark, d):
    t = graph.nodes(spark, d).withColumn("tile", F.floor(F.col("lat") / 0.1) * 100_000 + F.floor(F.col("lon") / 0.1))
    s = t.where("node_id % 7 = 0").select(F.col("node_id").alias("station"), F.col("lat").alias("la"), F.col("lon").alias("lo"), "tile").distinct()
    others = t.where("node_id % 7 <> 0").groupBy("tile", "lat", "lon").agg(F.min("node_id").alias("node_id"))  # of nodes at one place the smallest is nearest
    both = s.select("tile", "la", "lo").distinct().join(others, "tile")
    gap = (F.col("la") - F.col("lat")) * (F.col("la") - F.col("lat")) + (F.col("lo") - F.col("lon")) * (F.col("lo") - F.col("lon"))
    best = both.groupBy("tile", "la", "lo").agg(F.min_by("node_id", F.struct(gap, "node_id")).alias("nearest"))
    return s.join(best, ["tile", "la", "lo"]).select("station", "nearest")


@query("jon35_integrity", "SELECT 'lineitem' AS file, count(*) AS lost FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def jon35(spark, d):
    lost = lambda a, x, b, y: graph.table(spark, d, a).join(graph.table(spark, d, b).select(F.col(y).alias(x)), x, "left_anti").agg(F.lit(a).alias("file"), F.count(F.lit(1)).alias("lost"))
    return lost("lineitem", "l_orderkey", "orders", "o_orderkey").unionAll(lost("orders", "o_custkey", "customer", "c_custkey"))


@query("jon34_shortcut_bridge", f"{PATH}, s AS (SELECT route AS shortcut, seq, edge_id FROM p WHERE seq <= 5) SELECT e.edge_id, min(s.shortcut) AS shortcut FROM g_edge e JOIN s ON s.edge_id=e.edge_id GROUP BY 1")
def jon34(spark, d):
    bridge = path(spark, d).where("seq <= 5").select(F.col("route").alias("shortcut"), "seq", "edge_id")
    return graph.edges(spark, d).select("edge_id").join(bridge, "edge_id").groupBy("edge_id").agg(F.min("shortcut").alias("shortcut"))


@query("jon40_shape_match", f"{ENDS} SELECT e.edge_id, o.edge_id AS mirrored FROM e JOIN e o ON o.lat1=e.lat2 AND o.lon1=e.lon2 AND o.lat2=e.lat1 AND o.lon2=e.lon1 AND o.length_m=e.length_m AND o.way_id=e.way_id AND o.edge_id<>e.edge_id")
def jon40(spark, d):
    e = ends(spark, d)
    o = e.select("way_id", "length_m", F.col("edge_id").alias("mirrored"), F.col("lat1").alias("a"), F.col("lon1").alias("b"), F.col("lat2").alias("c"), F.col("lon2").alias("f"))
    return e.join(o, ["way_id", "length_m"]).where("a = lat2 and b = lon2 and c = lat1 and f = lon1 and edge_id <> mirrored").select("edge_id", "mirrored")


@query("flt10_truck_limits", f"""{GRAPH}, lim AS (SELECT edge_id, CASE edge_id%3 WHEN 0 THEN 'height' WHEN 1 THEN 'axle_load' ELSE 'axles' END AS kind, 100+edge_id%900 AS v FROM g_edge WHERE edge_id%2=0)
SELECT edge_id FROM g_edge WHERE edge_id NOT IN (SELECT edge_id FROM lim WHERE (kind='height' AND 4.1e0 > v*0.01e0) OR (kind='axle_load' AND 9e0 > v*0.01e0) OR (kind='axles' AND 5e0 > v*0.01e0))""")
def flt10(spark, d):
    e, i = graph.edges(spark, d).select("edge_id"), F.col("edge_id")
    limits = e.where(i % 2 == 0).select("edge_id", F.element_at(F.array(*map(F.lit, ("height", "axle_load", "axles"))), (i % 3 + 1).cast("int")).alias("kind"), (100 + i % 900).alias("value"))
    return filters.within_limits(e, limits, {"height": 4.1, "axle_load": 9.0, "axles": 5.0}).select("edge_id")


@query("flt14_complex_restriction", f"{PATH}, l AS (SELECT route, list(edge_id%5 ORDER BY seq) AS a, count(*) AS n FROM p GROUP BY 1) SELECT route, n >= 2 AND a[n-1]=1 AND a[n]=2 AS banned FROM l")
def flt14(spark, d):
    p = path(spark, d).groupBy("route").agg(F.sort_array(F.collect_list(F.struct("seq", "edge_id"))).alias("x")).select("route", F.transform("x", lambda r: r["edge_id"] % 5).alias("a"))
    return p.select("route", filters.breaks_restriction(F.col("a"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("banned"))


@query("flt22_layer_filter", f"{GRAPH} SELECT edge_id FROM g_edge WHERE NOT (edge_id%4<>0 AND edge_id%4<>2)")
def flt22(spark, d):
    return graph.edges(spark, d).where(~filters.layer_rejects(F.when(F.col("edge_id") % 4 != 0, F.col("edge_id") % 4), F.lit(2))).select("edge_id")


@query("flt24_hierarchy_stop", f"{GRAPH} SELECT edge_id FROM g_edge WHERE edge_id%500 > 10 AND length_m > 5000")
def flt24(spark, d):
    return graph.edges(spark, d).where(filters.stops_expanding(F.col("edge_id") % 500, "length_m", 10, 5000.0)).select("edge_id")


@query("flt26_edges_connected", f"{GRAPH}, b AS (SELECT from_node, count(*) AS touching FROM g_edge GROUP BY 1) SELECT a.edge_id, touching FROM g_edge a JOIN b ON a.to_node=b.from_node")
def flt26(spark, d):
    e = graph.edges(spark, d)
    return e.join(leaving(e), "to_node").select("edge_id", F.col("n").alias("touching"))


@query("flt27_contractable", f"{GRAPH} SELECT from_node, count(*) = 2 AS contractable FROM g_edge WHERE road_class <= 1 GROUP BY 1")
def flt27(spark, d):
    return graph.edges(spark, d).where("road_class <= 1").groupBy("from_node").agg((F.count(F.lit(1)) == 2).alias("contractable"))


@query("win04_shape_distance", f"{PATH} SELECT edge_id, CAST(coalesce(sum(length_m) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS starts_at FROM p")
def win04(spark, d):
    w = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return path(spark, d).select("edge_id", F.coalesce(F.sum("length_m").over(w), F.lit(0.0)).cast("long").alias("starts_at"))


@query("win12_consecutive_signs", f"{PATH}, s AS (SELECT route, seq, speed_kph%3 AS sign FROM p) SELECT a.route, a.seq, CAST(CASE WHEN b.sign=a.sign THEN CASE WHEN c.sign=a.sign THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS repeats FROM s a LEFT JOIN s b ON b.route=a.route AND b.seq=a.seq+1 LEFT JOIN s c ON c.route=a.route AND c.seq=a.seq+2")
def win12(spark, d):
    w, s = Window.partitionBy("route").orderBy("seq"), F.col("sign")
    p = path(spark, d).select("route", "seq", (F.col("speed_kph") % 3).alias("sign"))
    one, two = F.coalesce(F.lead("sign", 1).over(w) == s, F.lit(False)), F.coalesce(F.lead("sign", 2).over(w) == s, F.lit(False))
    return p.select("route", "seq", F.when(one, F.when(two, 2).otherwise(1)).otherwise(0).cast("long").alias("repeats"))


@query("win13_row_frames", f"{PATH} SELECT edge_id, CAST(sum(length_m) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around FROM p")
def win13(spark, d):
    return path(spark, d).select("edge_id", F.sum("length_m").over(Window.partitionBy("route").orderBy("seq").rowsBetween(-1, 1)).cast("long").alias("around"))


@query("srt05_total_order", f"{GRAPH} SELECT edge_id, CAST(row_number() OVER (PARTITION BY density ORDER BY road_class, to_node, edge_id) AS BIGINT) AS place FROM g_edge")
def srt05(spark, d):
    e = graph.edges(spark, d).select("edge_id", "density", "road_class", "to_node")
    return sorting.places(e, [F.col("road_class"), F.col("to_node"), F.col("edge_id")], "density").select("edge_id", "place")


@query("srt12_lower_bound", f"{GRAPH}, b AS (SELECT from_node, min(length_m) AS m FROM g_edge GROUP BY 1) SELECT edge_id FROM g_edge JOIN b USING (from_node) WHERE length_m <= m*1.25e0")
def srt12(spark, d):
    e = graph.edges(spark, d)
    return e.join(e.groupBy("from_node").agg(F.min("length_m").alias("m")), "from_node").where("length_m <= m * 1.25D").select("edge_id")


@query("srt14_trim_signs", f"{GRAPH}, s AS (SELECT from_node, to_node, row_number() OVER (PARTITION BY from_node ORDER BY to_node) AS r FROM (SELECT DISTINCT from_node, to_node FROM g_edge) t) SELECT from_node, string_agg(CAST(to_node AS VARCHAR), '/' ORDER BY to_node) AS signs FROM s WHERE r<=4 GROUP BY 1")
def srt14(spark, d):
    e = graph.edges(spark, d).groupBy("from_node").agg(F.sort_array(F.collect_set("to_node")).alias("s"))
    return e.select("from_node", trip.sign_text(F.transform("s", lambda x: x.cast("string")), 4).alias("signs"))


@query("set08_unused_tiles", f"{GRAPH}, t AS (SELECT node_id, CAST(floor(lat/0.05e0) AS BIGINT) AS r, CAST(floor(lon/0.05e0) AS BIGINT) AS c FROM g_node) SELECT DISTINCT r, c FROM t WHERE (r,c) NOT IN (SELECT r,c FROM t JOIN (SELECT from_node FROM g_edge WHERE road_class=1 AND edge_id%50=0) e ON e.from_node=node_id)")
def set08(spark, d):
    t = graph.nodes(spark, d).select("node_id", F.floor(F.col("lat") / 0.05).alias("r"), F.floor(F.col("lon") / 0.05).alias("c"))
    used = t.join(graph.edges(spark, d).where("road_class = 1 and edge_id % 50 = 0").select(F.col("from_node").alias("node_id")), "node_id", "left_semi").select("r", "c")
    return t.select("r", "c").distinct().join(used, ["r", "c"], "left_anti")


@query("prj13_conditional_limits", "SELECT o_orderkey, CAST(o_orderkey % 130 AS BIGINT) AS kph, 'Mo-Fr '||lpad(CAST(o_orderkey % 24 AS VARCHAR),2,'0')||':00' AS hours FROM orders")
def prj13(spark, d):
    text = F.concat((F.col("o_orderkey") % 130).cast("string"), F.lit(" @ (Mo-Fr "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00)"))
    value, hours = scalar.conditional("t")
    return graph.table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", value.cast("long").alias("kph"), hours.alias("hours"))


@query("prj16_elevation_decode", f"{GRAPH} SELECT edge_id, 100e0+((edge_id%9)-4)*0.25e0 AS second, 100e0+((edge_id%9)-4)*0.25e0+((edge_id%5)-2)*0.25e0 AS third FROM g_edge")
def prj16(spark, d):
    e = F.col("edge_id")
    zero = F.array(F.lit(100.0))
    run = F.aggregate(F.array(e % 9 - 4, e % 5 - 2), zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x * 0.25)))
    return graph.edges(spark, d).select("edge_id", run.alias("a")).select("edge_id", F.col("a")[1].alias("second"), F.col("a")[2].alias("third"))


@query("prj21_class_lookup", f"{GRAPH} SELECT edge_id, list_extract(['motorway','trunk','primary','secondary','tertiary','unclassified','residential','service'], CAST(road_class AS INT)+1) AS name FROM g_edge")
def prj21(spark, d):
    names = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service"]
    dim = spark.createDataFrame(list(enumerate(names)), "road_class int, name string")
    return graph.edges(spark, d).join(F.broadcast(dim), "road_class").select("edge_id", "name")  # eight rows


@query("cst11_turn_kind", f"{GRAPH} SELECT edge_id, CASE WHEN length_m < 20000 AND edge_id%360 BETWEEN 45 AND 135 THEN 'right' WHEN length_m < 20000 AND edge_id%360 BETWEEN 225 AND 315 THEN 'left' ELSE 'none' END AS internal FROM g_edge")
def cst11(spark, d):
    g, short = F.col("edge_id") % 360, F.col("length_m") < 20_000
    return graph.edges(spark, d).select("edge_id", F.when(short & g.between(45, 135), "right").when(short & g.between(225, 315), "left").otherwise("none").alias("internal"))


@query("cst14_heuristic", f"{ENDS} SELECT edge_id, floor(sqrt(((lat2-lat1)*110567e0)*((lat2-lat1)*110567e0)+((lon2-lon1)*(cos(radians(lat1))*110567e0))*((lon2-lon1)*(cos(radians(lat1))*110567e0)))*(3.6e0/140e0)*0.85e0*1e2+0.5e0)/1e2 AS least FROM e")
def cst14(spark, d):
    far = F.sqrt(geo.approx_squared("lat1", "lon1", "lat2", "lon2"))
    return ends(spark, d).select("edge_id", milli(far * F.lit(3.6 / 140.0) * 0.85, 1e2).alias("least"))


@query("snk11_validation_receipt", f"""{GRAPH} SELECT '{{"edges":'||CAST(count(*) AS VARCHAR)||',"nodes":'||CAST(count(DISTINCT from_node) AS VARCHAR)||',"valid":true}}' AS receipt FROM g_edge""")
def snk11(spark, d):
    one = graph.edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_node").alias("nodes"), F.lit(True).alias("valid"))
    return one.select(F.to_json(F.struct("edges", "nodes", "valid")).alias("receipt"))


@query("src08_tile_listing", f"{GRAPH} SELECT DISTINCT 2 AS level, CAST(floor((lat+90e0)/0.25e0) AS BIGINT)*1440+CAST(floor((lon+180e0)/0.25e0) AS BIGINT) AS tile FROM g_node")
def src08(spark, d):
    return graph.nodes(spark, d).select(F.lit(2).alias("level"), geo.tile_id("lat", "lon", 2).alias("tile")).distinct()


@query("src10_point_lookup", f"{GRAPH} SELECT edge_id, from_node, to_node, speed_kph FROM g_edge WHERE edge_id IN (SELECT edge_id FROM g_edge WHERE edge_id%1000 < 20)")
def src10(spark, d):
    e = graph.edges(spark, d)
    return e.join(e.where("edge_id % 1000 < 20").select("edge_id"), "edge_id", "left_semi").select("edge_id", "from_node", "to_node", "speed_kph")


@query("etl10_restriction_masks", f"{GRAPH}, l AS (SELECT edge_id, from_node, row_number() OVER (PARTITION BY from_node ORDER BY edge_id)-1 AS local FROM g_edge) SELECT from_node, CAST(sum(1 << CAST(local AS INT)) AS BIGINT) AS mask FROM l WHERE local < 8 AND edge_id%3=0 GROUP BY 1")
def etl10(spark, d):
    from ..operators import etl

    return etl.local_index(graph.edges(spark, d)).where("local < 8 and edge_id % 3 = 0").groupBy("from_node").agg(F.sum(F.expr("shiftleft(1L, local)")).alias("mask"))


@query("etl15_ferry_class", f"{GRAPH} SELECT way_id, CASE WHEN max(length_m) > 40000 THEN 'primary' WHEN max(length_m) > 10000 THEN 'secondary' ELSE 'tertiary' END AS class FROM g_edge GROUP BY 1")
def etl15(spark, d):
    far = F.max("length_m")
    return graph.edges(spark, d).groupBy("way_id").agg(F.when(far > 40_000, "primary").when(far > 10_000, "secondary").otherwise("tertiary").alias("class"))


@query("etl09_edge_info_dedup", f"{GRAPH} SELECT least(from_node,to_node) AS a, greatest(from_node,to_node) AS b, count(*) AS edges FROM g_edge GROUP BY 1,2,way_id")
def etl09(spark, d):
    return graph.edges(spark, d).groupBy(F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b"), "way_id").agg(F.count(F.lit(1)).alias("edges")).drop("way_id")


@query("udf01_costing_registry", f"{GRAPH} SELECT edge_id, length_m AS cost FROM g_edge")
def udf01(spark, d):
    costing.register("shortest", lambda length, **_: (geo.c(length), F.lit(0.0)))
    return graph.edges(spark, d).select("edge_id", costing.REGISTRY["shortest"]("length_m")[0].alias("cost"))
