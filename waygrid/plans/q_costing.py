"""Queries of the costing (CST) and filter (FLT) groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import c, milli
from ..operators import costing, filters, graph
from .registry import FEED, GRAPH, query

OPTIONS = costing.Options(use_highways=0.25, use_tolls=0.25, top_speed=60.0)
HWY = "list_extract([1.0,0.5,0.0,0.0,0.0,0.0,0.0,0.0]::DOUBLE[], CAST(road_class AS INT)+1)"
SECS = "length_m*(3.6e0/least(speed_kph, 60e0))"
DENSITY = "(0.85e0+density*0.025e0)"
PENALTY = "greatest(0e0, speed_kph-60e0)*0.05e0"


def m(x: str, scale: str = "1e3") -> str:
    return f"floor(({x})*{scale}+0.5e0)/{scale}"


@query("cst01_edge_speed", f"""{GRAPH}, x AS (SELECT edge_id, speed_kph AS def, CASE WHEN edge_id%3=0 THEN speed_kph+15 END AS free, CASE WHEN edge_id%4=0 THEN speed_kph-15 END AS con, CASE WHEN edge_id%5=0 THEN speed_kph*0.75e0 END AS pred,
  CASE WHEN edge_id%7=0 THEN 24 END AS live, 0.5e0 AS share, CASE WHEN edge_id%6<>0 THEN (edge_id*7919)%604800 END AS sec FROM g_edge),
y AS (SELECT *, CASE WHEN live IS NOT NULL AND sec IS NOT NULL THEN share*(1e0-least(900/3600e0,1e0)) ELSE 0e0 END AS p,
  CASE WHEN pred IS NOT NULL AND sec IS NOT NULL THEN greatest(pred,0.5e0)+0.5e0 WHEN con>=1 AND (sec IS NULL OR (sec%86400>25200 AND sec%86400<68400)) THEN con
   WHEN free>=1 AND (sec IS NULL OR NOT (sec%86400>25200 AND sec%86400<68400)) THEN free ELSE def END AS base FROM x)
SELECT edge_id, CAST(floor(coalesce(live,0)*p+(1e0-p)*base) AS BIGINT) AS kph FROM y""")
def cst01(spark, d):
    e, s = F.col("edge_id"), F.col("speed_kph")
    v = costing.edge_speed(s, F.when(e % 3 == 0, s + 15), F.when(e % 4 == 0, s - 15), F.when(e % 5 == 0, s * 0.75), F.when(e % 7 == 0, F.lit(24)), F.lit(0.5), F.when(e % 6 != 0, e * 7919 % 604_800), F.lit(900))
    return graph.edges(spark, d).select("edge_id", v.alias("kph"))


@query("cst02_auto_edge_cost", f"""{GRAPH} SELECT edge_id, {m(f"{SECS}*({DENSITY}+2e0*{HWY}+{PENALTY}+toll*2e0)")} AS cost, {m(SECS)} AS seconds FROM g_edge""")
def cst02(spark, d):
    cost, secs = costing.auto_cost("length_m", "speed_kph", "road_class", "density", "toll", o=OPTIONS)
    return graph.edges(spark, d).select("edge_id", milli(cost).alias("cost"), milli(secs).alias("seconds"))


@query("cst03_truck_edge_cost", f"""{GRAPH}, x AS (SELECT *, least(least(speed_kph, CASE WHEN edge_id%3=0 THEN 30 ELSE speed_kph END, 120e0), 60e0) AS v FROM g_edge)
SELECT edge_id, {m("length_m*(3.6e0/v)*((CASE WHEN edge_id%5=0 THEN 0.85e0 ELSE 1e0 END)+toll*2e0)")} AS cost FROM x""")
def cst03(spark, d):
    e = F.col("edge_id")
    cost, _ = costing.truck_cost("length_m", "speed_kph", F.when(e % 3 == 0, 30).otherwise(0), e % 5 == 0, "toll", OPTIONS)
    return graph.edges(spark, d).select("edge_id", milli(cost).alias("cost"))


@query("cst04_taxi_edge_cost", f"""{GRAPH} SELECT edge_id, {m(f"{SECS}*({DENSITY}+{PENALTY})*CASE WHEN edge_id%9=0 THEN 0.85e0 ELSE 1e0 END")} AS cost FROM g_edge""")
def cst04(spark, d):
    cost, _ = costing.taxi_cost("length_m", "speed_kph", "density", F.col("edge_id") % 9 == 0, OPTIONS)
    return graph.edges(spark, d).select("edge_id", milli(cost).alias("cost"))


@query("cst07_base_transition", f"""{GRAPH}, x AS (SELECT edge_id, edge_id%5 AS n, toll=1 AS t, edge_id%2=0 AS pt, edge_id%6 AS u, (edge_id//7)%6 AS pu, edge_id%4=0 AS dest, edge_id%8=0 AS pdest, edge_id%3=0 AS link, edge_id%10=0 AS same FROM g_edge),
s AS (SELECT *, (CASE WHEN n=0 THEN 600e0 ELSE 0 END)+(CASE WHEN n=1 THEN 30e0 ELSE 0 END)+(CASE WHEN n=2 OR (t AND NOT pt) THEN 15e0 ELSE 0 END)+(CASE WHEN u=0 AND pu<>0 THEN 300e0 ELSE 0 END) AS secs FROM x)
SELECT edge_id, CAST(secs AS DOUBLE) AS seconds, CAST(secs+(CASE WHEN n=1 THEN 300e0 ELSE 0 END)+(CASE WHEN dest AND NOT pdest THEN 600e0 ELSE 0 END)+(CASE WHEN u=1 AND pu<>1 THEN 5e0 ELSE 0 END)+(CASE WHEN NOT link AND NOT same THEN 5e0 ELSE 0 END)+(CASE WHEN u=2 AND pu<>2 THEN 15e0 ELSE 0 END) AS DOUBLE) AS cost FROM s""")
def cst07(spark, d):
    e = F.col("edge_id")
    kinds, uses = F.array(*map(F.lit, ("border", "gate", "toll_booth", "street", "street"))), F.array(*map(F.lit, ("ferry", "alley", "service", "road", "road", "road")))
    use = lambda x: F.element_at(uses, (x % 6 + 1).cast("int"))
    rows = graph.edges(spark, d).select("edge_id", F.element_at(kinds, (e % 5 + 1).cast("int")).alias("node"), (F.col("toll") == 1).alias("t"), use(e).alias("u"), use(F.floor(e / 7)).alias("pu"))
    edge = {"toll": F.col("t"), "use": F.col("u"), "destination_only": e % 4 == 0, "link": e % 3 == 0, "same_name": e % 10 == 0}
    cost, secs = costing.base_transition("node", edge, {"toll": e % 2 == 0, "use": F.col("pu"), "destination_only": e % 8 == 0})
    return rows.select("edge_id", secs.alias("seconds"), cost.alias("cost"))


@query("cst08_u_turn_penalty", f"""{GRAPH} SELECT edge_id, CASE WHEN edge_id%3=0 AND NOT edge_id%2=0 THEN 20e0 WHEN edge_id%3=0 THEN 610e0 WHEN edge_id%5=0 THEN 150e0 ELSE 10e0 END AS seconds FROM g_edge""")
def cst08(spark, d):
    e = F.col("edge_id")
    return graph.edges(spark, d).select("edge_id", costing.u_turn_seconds(F.lit(10.0), e % 3 == 0, e % 2 == 0, e % 5 == 0).alias("seconds"))


def _sig(a: str, k: str, b: str) -> str:
    return f"7.5e0/(1e0+exp(-({k}*({a})/180e0-{b})))"


_INV = 1.0 / 1.075
_RIGHT = f"CASE WHEN s>=0 THEN {_sig('s', repr(13 * _INV) + 'e0', repr(6.5 * 1.075) + 'e0')} ELSE {_sig('-s', repr(13 * 1.075) + 'e0', repr(6.5 * _INV) + 'e0')} END"
_LEFT = f"CASE WHEN s>=0 THEN {_sig('s', repr(13 * 1.075) + 'e0', repr(6.5 * _INV) + 'e0')} ELSE {_sig('-s', repr(13 * _INV) + 'e0', repr(6.5 * 1.075) + 'e0')} END"


@query("cst09_turn_duration", f"""{GRAPH}, x AS (SELECT edge_id, edge_id%360 AS g, CASE WHEN edge_id%360>180 THEN edge_id%360-360 ELSE edge_id%360 END AS s, edge_id%5 AS roads FROM g_edge)
SELECT edge_id, {m(f"(CASE WHEN edge_id%3=0 THEN 2e0 ELSE 0e0 END)+(CASE WHEN roads>2 OR g BETWEEN 160 AND 200 THEN (CASE WHEN edge_id%2=0 THEN {_RIGHT} ELSE {_LEFT} END)+(CASE WHEN g BETWEEN 160 AND 200 THEN 20e0 ELSE 0e0 END) ELSE 0e0 END)", "1e6")} AS seconds FROM x""")
def cst09(spark, d):
    e = F.col("edge_id")
    return graph.edges(spark, d).select("edge_id", milli(costing.turn_seconds(e % 360, e % 2 == 0, e % 5, e % 3 == 0), 1e6).alias("seconds"))


@query("cst10_speed_penalty", f"{GRAPH} SELECT edge_id, {m(PENALTY)} AS penalty FROM g_edge")
def cst10(spark, d):
    return graph.edges(spark, d).select("edge_id", milli(costing.speed_penalty("speed_kph", 60.0, 0.05)).alias("penalty"))


@query("cst12_custom_factors", f"""{GRAPH}, f AS (SELECT edge_id, (edge_id%10)/10e0 AS a, 1e0 AS b, 2e0 AS w FROM g_edge WHERE edge_id%4=0)
SELECT g.edge_id, {m("coalesce((b-a)*w + (1e0-(b-a)), 1e0)", "1e6")} AS factor FROM g_edge g LEFT JOIN f ON f.edge_id=g.edge_id""")
def cst12(spark, d):
    e = graph.edges(spark, d).select("edge_id")
    f = e.where("edge_id % 4 = 0").select("edge_id", (F.col("edge_id") % 10 / 10.0).alias("a"), F.lit(1.0).alias("b"), F.lit(2.0).alias("w"))
    part = F.col("b") - F.col("a")
    return e.join(f, "edge_id", "left").select("edge_id", milli(F.coalesce(part * F.col("w") + (F.lit(1.0) - part), F.lit(1.0)), 1e6).alias("factor"))


@query("cst13_partial_edge_cost", f"""{GRAPH} SELECT edge_id, {m(f"{SECS}*({DENSITY}+2e0*{HWY}+{PENALTY}+toll*2e0)*0.5e0")} AS cost FROM g_edge""")
def cst13(spark, d):
    cost, secs = costing.auto_cost("length_m", "speed_kph", "road_class", "density", "toll", o=OPTIONS)
    return graph.edges(spark, d).select("edge_id", milli(costing.partial(cost, secs, F.lit(0.25), F.lit(0.75))[0]).alias("cost"))


@query("cst15_beeline", f"{GRAPH} SELECT edge_id, {m('length_m*3.6e0/60e0')} AS seconds FROM g_edge")
def cst15(spark, d):
    return graph.edges(spark, d).select("edge_id", milli(costing.beeline_seconds("length_m", 60.0)).alias("seconds"))


@query("cst16_preference_factors", "SELECT i AS step, CASE WHEN u >= 0.5e0 THEN power(0.5e0-u, 3) ELSE 8e0*power(1-2*u, 2) END AS highway, CASE WHEN u<0.5e0 THEN 4e0-8e0*u ELSE (0.5e0-u)*0.03e0 END AS toll, CASE WHEN u<0.5e0 THEN 10e0-18e0*u ELSE 1.5e0-u END AS ferry FROM (SELECT CAST(i AS BIGINT) AS i, i/8e0 AS u FROM range(9) t(i)) q")
def cst16(spark, d):
    rows = []
    for i in range(9):
        o = costing.Options(use_highways=i / 8, use_tolls=i / 8, use_ferry=i / 8)
        rows.append((i, float(costing.highway_factor(o)), float(costing.toll_factor(o)), float(costing.ferry(o)[0])))
    return spark.createDataFrame(rows, "step long, highway double, toll double, ferry double")


@query("cst17_option_parse", "SELECT * FROM (VALUES ('closure_factor', 9e0, true), ('top_speed', 140e0, true), ('use_tolls', 0.25e0, false)) t(name, value, replaced)")
def cst17(spark, d):
    given = {"closure_factor": 99.0, "top_speed": 999.0, "use_tolls": 0.25, "unheard_of": 1.0}
    o = costing.parse(given)
    return spark.createDataFrame([(k, float(getattr(o, k)), k in o.changed) for k in sorted(given) if hasattr(o, k)], "name string, value double, replaced boolean")


@query("cst18_speed_mask", "SELECT CAST(9 AS BIGINT) AS mask")
def cst18(spark, d):
    return spark.createDataFrame([(costing.parse({"speed_types": ["freeflow", "current", "other"]}).flow_mask,)], "mask long")


@query("cst19_cost_arithmetic", f"{GRAPH} SELECT from_node, CAST(sum(CAST(floor({m(SECS)}*1000+0.5e0) AS BIGINT)) AS BIGINT) AS milliseconds FROM g_edge GROUP BY from_node")
def cst19(spark, d):
    return graph.edges(spark, d).groupBy("from_node").agg(F.sum(F.floor(milli(costing.seconds("length_m", "speed_kph", 60.0)) * 1000 + 0.5)).alias("milliseconds"))


@query("flt01_access_mask", f"{GRAPH} SELECT edge_id FROM g_edge WHERE (edge_id % 64) & 5 <> 0")
def flt01(spark, d):
    return graph.edges(spark, d).where(filters.has_access(F.col("edge_id") % 64, 5)).select("edge_id")


ATTR = f"""{GRAPH}, atr AS (SELECT *, CAST(edge_id % 64 AS INT) AS access, CAST((edge_id//3)%8 AS INT) AS surface, edge_id%17=0 AS dest, edge_id%19=0 AS unpaved, edge_id%23=0 AS closed, CAST((edge_id//5)%256 AS INT) AS forbidden, CAST(edge_id%8 AS INT) AS local, opp_edge_id%5=0 AS before_opp FROM g_edge)"""


def attributes(spark, d):
    e = F.col("edge_id")
    return graph.edges(spark, d).select("*", (e % 64).cast("int").alias("access"), (F.floor(e / 3) % 8).cast("int").alias("surface"), (e % 17 == 0).alias("dest"), (e % 19 == 0).alias("unpaved"), (e % 23 == 0).alias("closed"), (F.floor(e / 5) % 256).cast("int").alias("forbidden"), (e % 8).cast("int").alias("local"), (F.col("opp_edge_id") % 5 == 0).alias("before_opp"))


for _name, _bit in (("flt02_auto_allowed", 1), ("flt04_bus_allowed", 16), ("flt05_taxi_allowed", 4), ("flt06_truck_allowed", 8)):

    @query(_name, f"{ATTR} SELECT edge_id FROM atr WHERE access & {_bit} <> 0 AND NOT before_opp AND (forbidden >> local) & 1 = 0 AND surface <> 7 AND NOT dest AND NOT closed AND NOT unpaved")
    def _allowed(spark, d, bit=_bit):
        row = {k: F.col(k) for k in ("access", "surface", "dest", "closed", "unpaved", "forbidden", "local")}
        return attributes(spark, d).where(filters.allowed(row, bit, u_turn=F.col("before_opp"), exclude_unpaved=True)).select("edge_id")


@query("flt03_auto_allowed_reverse", f"{ATTR} SELECT a.edge_id FROM atr a JOIN atr o ON o.edge_id=a.opp_edge_id WHERE o.access & 1 <> 0 AND NOT a.before_opp AND (o.forbidden >> o.local) & 1 = 0 AND o.surface <> 7 AND NOT o.dest AND NOT o.closed")
def flt03(spark, d):
    a = attributes(spark, d)
    names = ("access", "surface", "dest", "closed", "unpaved", "forbidden", "local")
    o = a.select(F.col("edge_id").alias("opp_edge_id"), *[F.col(k).alias(f"o_{k}") for k in names])
    return a.select("edge_id", "opp_edge_id", "before_opp").join(o, "opp_edge_id").where(filters.allowed({k: F.col(f"o_{k}") for k in names}, 1, u_turn=F.col("before_opp"))).select("edge_id")


@query("flt07_hov", f"{GRAPH} SELECT edge_id FROM (SELECT edge_id, edge_id%4 AS k, toll=1 AS t FROM g_edge) x WHERE k=0 OR k=2 OR (k=3 AND t)")
def flt07(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("none", "hov3", "hov2", "hot"))), (F.col("edge_id") % 4 + 1).cast("int"))
    return graph.edges(spark, d).where(filters.hov_allowed(kind, F.col("toll") == 1, hov2=True, hov3=False, hot=True)).select("edge_id")


@query("flt08_exclusion_flags", f"{GRAPH} SELECT edge_id FROM g_edge WHERE NOT (toll=1 AND edge_id%2=0)")
def flt08(spark, d):
    return graph.edges(spark, d).where(filters.exclusion_ok(F.col("toll") == 1, F.col("edge_id") % 2 != 0)).select("edge_id")


@query("flt09_car_limits", f"""{GRAPH}, lim AS (SELECT edge_id, 'height' AS kind, 100+edge_id%400 AS v FROM g_edge WHERE edge_id%3=0 UNION ALL SELECT edge_id, 'weight', 100+(edge_id*7)%900 FROM g_edge WHERE edge_id%5=0)
SELECT edge_id FROM g_edge WHERE edge_id NOT IN (SELECT edge_id FROM lim WHERE (kind='height' AND 1.9e0 > v*0.01e0) OR (kind='weight' AND 2.5e0 > v*0.01e0))""")
def flt09(spark, d):
    e = graph.edges(spark, d).select("edge_id")
    i = F.col("edge_id")
    limits = e.where(i % 3 == 0).select("edge_id", F.lit("height").alias("kind"), (100 + i % 400).alias("value")).unionAll(e.where(i % 5 == 0).select("edge_id", F.lit("weight").alias("kind"), (100 + i * 7 % 900).alias("value")))
    return filters.within_limits(e, limits, {"height": 1.9, "weight": 2.5}).select("edge_id")


@query("flt12_conditional_time", """SELECT event_id, (list_extract([1,2,4,8,16,32,64], CAST(dayofweek(ts) AS INT)+1) & 62 <> 0 AND hour(ts)*60+minute(ts) BETWEEN 420 AND 570) AS active FROM events""")
def flt12(spark, d):
    return graph.table(spark, d, "events").select("event_id", filters.in_time_domain("ts", dow_mask=62, begin_minute=420, end_minute=570).alias("active"))


@query("flt13_nth_weekday", """SELECT event_id, CAST(day(date_trunc('month', ts)) + ((1 - dayofweek(date_trunc('month', ts)) + 7) % 7) + 7 AS INT) AS day FROM events""")
def flt13(spark, d):
    return graph.table(spark, d, "events").select("event_id", filters.nth_weekday("ts", 2, 2).alias("day"))


@query("flt17_subsequence", f"""{GRAPH}, p AS (SELECT from_node, list(edge_id%4 ORDER BY edge_id) AS a FROM g_edge GROUP BY 1)
SELECT from_node, contains(','||array_to_string(a, ',')||',', ',1,2,1,') OR contains(','||array_to_string(a, ',')||',', ',0,1,2,') AS holds FROM p""")
def flt17(spark, d):
    p = graph.edges(spark, d).groupBy("from_node").agg(F.sort_array(F.collect_list("edge_id")).alias("ids")).select("from_node", F.transform("ids", lambda x: x % 4).alias("a"))
    one = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    return p.select("from_node", (filters.holds_sequence(F.col("a"), one(1, 2, 1)) | filters.holds_sequence(F.col("a"), one(0, 1, 2))).alias("holds"))


@query("flt18_closed_edge", f"{GRAPH} SELECT edge_id FROM g_edge WHERE edge_id%4<>0 AND edge_id%6=0")
def flt18(spark, d):
    return graph.edges(spark, d).where(filters.is_closed(F.col("edge_id") % 4, F.col("edge_id") % 6)).select("edge_id")


@query("flt19_avoid_edges", f"{FEED} SELECT edge_id FROM g_edge WHERE edge_id NOT IN (SELECT edge_id FROM g_traffic WHERE closed)")
def flt19(spark, d):
    return graph.edges(spark, d).join(graph.traffic(spark, d).where("closed").select("edge_id"), "edge_id", "left_anti").select("edge_id")


@query("flt20_snap_filter", f"{GRAPH} SELECT edge_id FROM g_edge WHERE NOT (road_class > 6 OR road_class < 1 OR toll=1 OR edge_id%13=0)")
def flt20(spark, d):
    reject = filters.snap_rejects("road_class", toll=F.col("toll") == 1, tunnel=F.col("edge_id") % 13 == 0, min_class=6, max_class=1, exclude_tolls=True, exclude_tunnels=True)
    return graph.edges(spark, d).where(~reject).select("edge_id")


@query("flt21_heading_filter", f"{GRAPH} SELECT edge_id FROM (SELECT edge_id, edge_id%360 AS h FROM g_edge) x WHERE least((h-90+360)%360, 360-(h-90+360)%360) <= 45")
def flt21(spark, d):
    return graph.edges(spark, d).where(~filters.heading_rejects(F.col("edge_id") % 360, F.lit(90), 45)).select("edge_id")


@query("flt23_side_of_street", f"{GRAPH} SELECT edge_id FROM g_edge WHERE NOT (edge_id%3<>0 AND road_class<=4 AND (edge_id%3=1) <> true)")
def flt23(spark, d):
    side = F.when(F.col("edge_id") % 3 == 0, F.lit("none")).when(F.col("edge_id") % 3 == 1, "right").otherwise("left")
    return graph.edges(spark, d).where(~filters.side_rejects(side, "same", "road_class", 4, F.lit(True))).select("edge_id")


@query("flt25_trivial_path", f"{GRAPH} SELECT edge_id FROM g_edge WHERE (edge_id%10)/10e0 <= (edge_id%7)/7e0")
def flt25(spark, d):
    return graph.edges(spark, d).where(filters.trivial("edge_id", "edge_id", F.col("edge_id") % 10 / 10.0, F.col("edge_id") % 7 / 7.0)).select("edge_id")


@query("flt28_mode_filter", f"{GRAPH}, k AS (SELECT * FROM g_edge WHERE road_class < 3) SELECT node_id FROM g_node WHERE node_id IN (SELECT from_node FROM k UNION SELECT to_node FROM k)")
def flt28(spark, d):
    kept = graph.edges(spark, d).where("road_class < 3")
    ends = kept.select(F.col("from_node").alias("node_id")).union(kept.select("to_node"))
    return graph.nodes(spark, d).join(ends, "node_id", "left_semi").select("node_id")


@query("flt34_freshness_policy", """SELECT event_id, CASE WHEN event_id%3=0 THEN 'fail' WHEN event_id%5=0 THEN 'fail' WHEN event_id%7=0 THEN 'closures only' ELSE 'available' END AS state FROM events""")
def flt34(spark, d):
    e = F.col("event_id")
    return graph.table(spark, d, "events").select("event_id", filters.freshness(e % 3 != 0, e % 5 != 0, e % 7 != 0).alias("state"))


_ = c
