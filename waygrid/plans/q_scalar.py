"""Queries of the key (PRJ), scalar (SCL) and sink-digest (SNK) groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, scalar
from ..functions.geo import milli
from ..operators import graph
from .registry import FEED, GRAPH, query

ID = "(l | (t << 3) | (i << 25))"
PARTS = f"{GRAPH}, p AS (SELECT edge_id, CAST(edge_id % 4 AS BIGINT) AS l, CAST((edge_id*31) % 1000000 AS BIGINT) AS t, CAST((edge_id*7) % 2000000 AS BIGINT) AS i FROM g_edge)"


def parts(spark, d):
    e = F.col("edge_id")
    return graph.edges(spark, d).select("edge_id", (e % 4).alias("l"), (e * 31 % 1_000_000).alias("t"), (e * 7 % 2_000_000).alias("i"))


@query("prj01_graph_id", f"{PARTS} SELECT edge_id, {ID} AS gid, CAST(l AS VARCHAR)||'/'||CAST(t AS VARCHAR)||'/'||CAST(i AS VARCHAR) AS text, true AS same FROM p")
def prj01(spark, d):
    g = parts(spark, d).withColumn("gid", keys.graph_id("t", "l", "i")).withColumn("text", keys.format_id("gid"))
    return g.select("edge_id", "gid", "text", (keys.parse_id("text") == F.col("gid")).alias("same"))


@query("prj02_cache_order", f"{PARTS} SELECT edge_id, CAST(row_number() OVER (PARTITION BY l ORDER BY {ID} & 33554431, i, edge_id) AS BIGINT) AS place FROM p")
def prj02(spark, d):
    from ..operators import sorting

    g = parts(spark, d).select("edge_id", "l", "i", keys.tile_base(keys.graph_id("t", "l", "i")).alias("base"))
    return sorting.places(g, [F.col("base"), F.col("i"), F.col("edge_id")], "l").select("edge_id", "place")


@query("prj03_tile_base", f"{PARTS} SELECT edge_id, {ID} & 33554431 AS base, t AS tile, l AS level, i AS idx FROM p")
def prj03(spark, d):
    g = parts(spark, d).withColumn("gid", keys.graph_id("t", "l", "i"))
    return g.select("edge_id", keys.tile_base("gid").alias("base"), *[v.alias(k) for k, v in keys.unpack("gid").items()])


@query("prj04_level_of_class", f"{GRAPH} SELECT edge_id, CASE WHEN road_class<=2 THEN 0 WHEN road_class<=4 THEN 1 ELSE 2 END AS level FROM g_edge")
def prj04(spark, d):
    return graph.edges(spark, d).select("edge_id", keys.level_of_class("road_class").alias("level"))


@query("prj05_tile_path", f"{PARTS} SELECT edge_id, CAST(l AS VARCHAR)||'/'||substr(z,1,3)||'/'||substr(z,4,3)||'/'||substr(z,7,3) AS path FROM (SELECT *, lpad(CAST(t AS VARCHAR),9,'0') AS z FROM p) q")
def prj05(spark, d):
    return parts(spark, d).select("edge_id", keys.tile_path("t", "l").alias("path"))


@query("prj06_edge_bits", f"{PARTS} SELECT edge_id, (w & 15) AS density, (w >> 4) & 7 AS road_class, (w >> 7) & 63 AS lanes FROM (SELECT edge_id, t*1024+i%1024 AS w FROM p) q")
def prj06(spark, d):
    w = parts(spark, d).select("edge_id", (F.col("t") * 1024 + F.col("i") % 1024).alias("w"))
    return w.select("edge_id", keys.bits("w", 0, 4).alias("density"), keys.bits("w", 4, 3).alias("road_class"), keys.bits("w", 7, 6).alias("lanes"))


@query("prj07_slope", f"{PARTS} SELECT edge_id, CASE WHEN (t & 16)=0 THEN t&31 ELSE 16+4*(t&15) END AS up, -(CASE WHEN (t & 16)=0 THEN t&31 ELSE 16+4*(t&15) END) AS down FROM p")
def prj07(spark, d):
    p = parts(spark, d).withColumn("raw", F.col("t").bitwiseAND(31))
    return p.select("edge_id", keys.slope("raw").cast("long").alias("up"), keys.slope("raw", down=True).cast("long").alias("down"))


@query("prj08_node_heading", f"{PARTS} SELECT edge_id, CAST(floor((t%256)*(360e0/255e0)+0.5e0) AS BIGINT) AS degrees FROM p")
def prj08(spark, d):
    return parts(spark, d).select("edge_id", keys.heading8(F.col("t") % 256).alias("degrees"))


@query("prj09_node_position", f"{GRAPH}, o AS (SELECT node_id, lat, lon, floor((lat+90e0)/0.25e0)*0.25e0-90e0 AS y, floor((lon+180e0)/0.25e0)*0.25e0-180e0 AS x FROM g_node) SELECT node_id, CAST(floor((lat-y)*1e6+0.5e0) AS BIGINT) AS dy, CAST(floor((lon-x)*1e6+0.5e0) AS BIGINT) AS dx FROM o")
def prj09(spark, d):
    low = lambda x, base: F.floor((F.col(x) + base) / 0.25) * 0.25 - base
    off = lambda x, base: F.floor((F.col(x) - low(x, base)) * 1e6 + 0.5).cast("long")
    return graph.nodes(spark, d).select("node_id", off("lat", 90.0).alias("dy"), off("lon", 180.0).alias("dx"))


@query("prj17_turn_lanes", f"""{PARTS}, q AS (SELECT edge_id, CAST(t % 1024 AS INT) AS mask FROM p)
SELECT edge_id, mask, list_aggregate(list_filter([CASE WHEN mask&1<>0 THEN 'reverse' END, CASE WHEN mask&2<>0 THEN 'sharp_left' END, CASE WHEN mask&4<>0 THEN 'left' END, CASE WHEN mask&8<>0 THEN 'slight_left' END,
 CASE WHEN mask&16<>0 THEN 'merge_to_left' END, CASE WHEN mask&32<>0 THEN 'through' END, CASE WHEN mask&64<>0 THEN 'merge_to_right' END, CASE WHEN mask&128<>0 THEN 'slight_right' END, CASE WHEN mask&256<>0 THEN 'right' END,
 CASE WHEN mask&512<>0 THEN 'sharp_right' END], lambda x: x IS NOT NULL), 'string_agg', ';') AS lanes FROM q WHERE mask <> 0""")
def prj17(spark, d):
    q = parts(spark, d).select("edge_id", (F.col("t") % 1024).cast("int").alias("m")).where("m <> 0").withColumn("lanes", keys.lane_text("m"))
    return q.select("edge_id", keys.lane_mask("lanes").alias("mask"), "lanes")


@query("prj19_time_domain", f"{PARTS} SELECT edge_id, l%2 AS type, t%128 AS dow, i%24 AS begin_hrs, i%60 AS begin_mins, t%13 AS begin_month, i%24 AS end_hrs FROM p")
def prj19(spark, d):
    t, i = F.col("t"), F.col("i")
    packed = keys.pack_domain(type=F.col("l") % 2, dow=t % 128, begin_hrs=i % 24, begin_mins=i % 60, begin_month=t % 13, end_hrs=i % 24)
    out = keys.time_domain("packed")
    return parts(spark, d).withColumn("packed", packed).select("edge_id", *[out[k].alias(k) for k in ("type", "dow", "begin_hrs", "begin_mins", "begin_month", "end_hrs")])


@query("prj22_base64", "SELECT event_id, to_base64(encode(props)) AS encoded, true AS same FROM events")
def prj22(spark, d):
    e = graph.table(spark, d, "events").select("event_id", "props", F.base64(F.col("props").cast("binary")).alias("encoded"))
    return e.select("event_id", F.regexp_replace("encoded", "[\r\n]", "").alias("encoded"), (F.unbase64("encoded").cast("string") == F.col("props")).alias("same"))


@query("prj25_leading_number", "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, floor(value)+0.5e0 AS fraction FROM events")
def prj25(spark, d):
    e = graph.table(spark, d, "events").select("event_id", F.floor("value").cast("string").alias("n"))
    return e.select("event_id", scalar.leading_int(F.concat("n", F.lit("abc"))).alias("whole"), scalar.leading_float(F.concat("n", F.lit(".5 km"))).alias("fraction"))


@query("src19_live_record", f"{PARTS}, w AS (SELECT edge_id, (t%128) AS o, (i%128) AS s1, (t%64) AS c1 FROM p) SELECT edge_id, CASE WHEN o<>127 THEN o*2 END AS overall, CASE WHEN s1<>127 THEN s1*2 END AS speed1, c1 AS congestion1 FROM w")
def src19(spark, d):
    raw = (F.col("t") % 128).bitwiseOR(F.shiftleft(F.col("i") % 128, 7)).bitwiseOR(F.shiftleft(F.col("t") % 64, 44))
    r = keys.live_record("raw")
    return parts(spark, d).withColumn("raw", raw).select("edge_id", keys.live_speed(r["overall"]).alias("overall"), keys.live_speed(r["speed1"]).alias("speed1"), r["congestion1"].alias("congestion1"))


_STAMPS = """t AS (SELECT o_custkey % 40 AS tile, CAST(sum(('0x'||substr(md5(CAST(o_orderkey AS VARCHAR)||'|'||o_orderpriority),1,12))::BIGINT::HUGEINT) % 281474976710656 AS BIGINT) AS hash48 FROM orders GROUP BY 1)"""


@query("snk04_tileset_checksum", f"WITH {_STAMPS} SELECT tile, hash48 FROM t")
def snk04(spark, d):
    """A checksum for each tile from its rows' own, so that no task needs a whole tile."""
    from ..operators import etl

    o = graph.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("tile"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("row"))
    return etl.stamps(o).withColumnRenamed("stamp", "hash48")


@query("agg29_tileset_fold", f"""WITH {_STAMPS}, s AS (SELECT CAST(sum(hash48) AS BIGINT) AS total FROM t)
SELECT total, xor(xor(total & 65535, (total >> 16) & 65535), xor((total >> 32) & 65535, (total >> 48) & 65535)) AS folded FROM s""")
def agg29(spark, d):
    total = snk04(spark, d).agg(F.sum("hash48").alias("total"))
    return total.select("total", keys.fold16("total").alias("folded"))


@query("agg30_output_tree_hash", f"""WITH {_STAMPS} SELECT sha256(string_agg(lpad(CAST(tile AS VARCHAR),4,'0')||':'||CAST(hash48 AS VARCHAR), chr(10) ORDER BY tile)) AS tree_hash FROM t""")
def agg30(spark, d):
    """One digest of a line for each output file, of which there are few whatever their size."""
    lines = snk04(spark, d).select("tile", F.concat(F.lpad(F.col("tile").cast("string"), 4, "0"), F.lit(":"), F.col("hash48").cast("string")).alias("line"))
    every = lines.agg(F.sort_array(F.collect_list(F.struct("tile", "line"))).alias("all"))
    return every.select(F.sha2(F.array_join(F.col("all.line"), "\n").cast("binary"), 256).alias("tree_hash"))


@query("scl06_speed", """SELECT event_id, CASE WHEN event_id%2=0 THEN floor(floor(value)*1.609344e0*1e3+0.5e0)/1e3 ELSE floor(value) END AS kph,
  CASE event_id%3 WHEN 0 THEN floor(value)/2000e0 WHEN 1 THEN floor(value)/1000e0 ELSE floor(value) END AS tons FROM events""")
def scl06(spark, d):
    n = F.floor("value").cast("string")
    e = graph.table(spark, d, "events").select("event_id", F.concat(n, F.when(F.col("event_id") % 2 == 0, " mph").otherwise(" kph")).alias("s"), F.concat(n, F.element_at(F.array(F.lit(" lbs"), F.lit(" kg"), F.lit(" t")), (F.col("event_id") % 3 + 1).cast("int"))).alias("w"))
    speed = scalar.speed_kph("s")
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, milli(speed)).otherwise(speed).alias("kph"), scalar.weight_tons("w").alias("tons"))


@query("scl06_measure", "SELECT event_id, floor(((event_id%20)*0.3048e0+(event_id%12)*0.0254e0)*1e4+0.5e0)/1e4 AS feet, floor((event_id%400)*0.01e0*1e4+0.5e0)/1e4 AS cm FROM events")
def scl06_measure(spark, d):
    e = F.col("event_id")
    t = graph.table(spark, d, "events").select("event_id", F.concat((e % 20).cast("string"), F.lit("'"), (e % 12).cast("string"), F.lit('"')).alias("a"), F.concat((e % 400).cast("string"), F.lit(" cm")).alias("b"))
    return t.select("event_id", milli(scalar.measure_meters("a"), 1e4).alias("feet"), milli(scalar.measure_meters("b"), 1e4).alias("cm"))


@query("scl07_conditional", "SELECT event_id, event_type AS value, CASE WHEN event_id%2=0 THEN 'Mo-Fr 07:00-09:00' END AS condition FROM events")
def scl07(spark, d):
    text = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, " @ (Mo-Fr 07:00-09:00)").otherwise(""))
    value, condition = scalar.conditional("t")
    return graph.table(spark, d, "events").select("event_id", text.alias("t")).select("event_id", value.alias("value"), condition.alias("condition"))


@query("scl12_tokens", "SELECT o_orderkey, lower(o_orderstatus)||'|'||o_orderpriority AS tokens, CAST(2 AS BIGINT) AS n FROM orders")
def scl12(spark, d):
    t = scalar.tokens(F.concat_ws(";", F.concat(F.lit(" "), F.lower("o_orderstatus")), F.lit(""), F.concat("o_orderpriority", F.lit(" "))))
    return graph.table(spark, d, "orders").select("o_orderkey", F.array_join(t, "|").alias("tokens"), F.size(t).cast("long").alias("n"))


@query("scl15_base_name", "SELECT p_partkey, trim(p_brand)||' Street' AS base FROM part")
def scl15(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "North ").otherwise("Southwest "), F.trim("p_brand"), F.lit(" Street"), F.when(F.col("p_partkey") % 3 == 0, " East").otherwise(""))
    return graph.table(spark, d, "part").select("p_partkey", scalar.base_name(name).alias("base"))


@query("scl18_word_count", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text, chr(32)), '[ \t\n\r\f\x0b]+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents")
def scl18(spark, d):
    return graph.table(spark, d, "documents").select("doc_id", scalar.word_count("text").alias("words"), F.char_length("text").cast("long").alias("chars"))


@query("scl19_plural", """SELECT event_id, CASE WHEN n=1 THEN 'one' ELSE 'other' END AS en, CASE WHEN n=1 THEN 'one' WHEN n BETWEEN 2 AND 4 THEN 'few' ELSE 'other' END AS cs,
  CASE WHEN n%10=1 AND n%100<>11 THEN 'one' WHEN n%10 BETWEEN 2 AND 4 AND NOT (n%100 BETWEEN 12 AND 14) THEN 'few' ELSE 'many' END AS ru FROM (SELECT event_id, event_id%130 AS n FROM events) t""")
def scl19(spark, d):
    n = F.col("event_id") % 130
    return graph.table(spark, d, "events").select("event_id", *[scalar.plural(n, x).alias(x) for x in ("en", "cs", "ru")])


@query("scl20_length_phrase", f"""{GRAPH}, t AS (SELECT edge_id, length_m/7e0 AS v FROM g_edge), u AS (SELECT *, CAST(floor(v/500e0+0.5e0) AS BIGINT) AS h FROM t)
SELECT edge_id, CASE WHEN v<10 THEN 'less than 10 meters' WHEN floor(v/10e0+0.5e0)*10<100 THEN CAST(CAST(floor(v/10e0+0.5e0)*10 AS BIGINT) AS VARCHAR)||' meters'
 WHEN floor(v/50e0+0.5e0)*50<1000 THEN CAST(CAST(floor(v/50e0+0.5e0)*50 AS BIGINT) AS VARCHAR)||' meters'
 WHEN h<20 THEN CAST(h//2 AS VARCHAR)||CASE WHEN h%2=1 THEN '.5' ELSE '' END||CASE WHEN h=2 THEN ' kilometer' ELSE ' kilometers' END
 ELSE CAST(CAST(floor(v/1000e0+0.5e0) AS BIGINT) AS VARCHAR)||' kilometers' END AS phrase FROM u""")
def scl20(spark, d):
    return graph.edges(spark, d).select("edge_id", scalar.length_phrase(F.col("length_m") / 7.0).alias("phrase"))


@query("scl21_phrase", "SELECT c_custkey, 'Turn left onto '||c_name||' and drive '||CAST(c_custkey%90 AS VARCHAR)||' meters.' AS instruction FROM customer")
def scl21(spark, d):
    c = graph.table(spark, d, "customer")
    return c.select("c_custkey", scalar.fill(F.lit("Turn left onto <STREET_NAMES> and drive <LENGTH> meters."), street_names=F.col("c_name"), length=F.col("c_custkey") % 90).alias("instruction"))


@query("scl22_second_of_week", """SELECT event_id, CAST(dayofweek(ts)*86400+hour(ts)*3600+minute(ts)*60+second(ts) AS BIGINT) AS second,
  CASE WHEN dayofweek(ts)*86400+hour(ts)*3600+minute(ts)*60+second(ts)+90000 > 604800 THEN CAST(dayofweek(ts)*86400+hour(ts)*3600+minute(ts)*60+second(ts)+90000-604800 AS BIGINT) ELSE CAST(dayofweek(ts)*86400+hour(ts)*3600+minute(ts)*60+second(ts)+90000 AS BIGINT) END AS later FROM events""")
def scl22(spark, d):
    e = graph.table(spark, d, "events").select("event_id", scalar.second_of_week("ts").alias("second"))
    return e.select("event_id", "second", scalar.advance_week("second", F.lit(90_000)).cast("long").alias("later"))


@query("scl24_travel_time", f"{GRAPH} SELECT edge_id, CAST(floor(length_m*3.6e0/speed_kph+0.5e0) AS BIGINT) AS seconds, floor(3.6e0/speed_kph*1e6+0.5e0)/1e6 AS factor FROM g_edge")
def scl24(spark, d):
    return graph.edges(spark, d).select("edge_id", scalar.travel_seconds("length_m", "speed_kph").alias("seconds"), milli(scalar.speed_factor("speed_kph"), 1e6).alias("factor"))


@query("scl26_density_factors", f"{GRAPH} SELECT edge_id, floor((0.85e0+density*0.025e0)*1e3+0.5e0)/1e3 AS factor, list_extract([1.0,1.0,1.0,1.0,1.0,1.1,1.2,1.3,1.4,1.6,1.9,2.2,2.5,2.8,3.1,3.5]::DOUBLE[], CAST(density AS INT)+1) AS transition FROM g_edge")
def scl26(spark, d):
    return graph.edges(spark, d).select("edge_id", milli(scalar.density_factor("density")).alias("factor"), scalar.transition_density("density").alias("transition"))


@query("scl28_clamps", "SELECT event_id, least(50e0, greatest(10e0, value)) AS clamped, (event_id*37)%360-((event_id*37)%360>=180)::INT*360 AS turned FROM events")
def scl28(spark, d):
    e = graph.table(spark, d, "events")
    return e.select("event_id", F.least(F.lit(50.0), F.greatest(F.lit(10.0), "value")).alias("clamped"), scalar.circular(F.col("event_id") * 37, -180, 180).cast("long").alias("turned"))


@query("scl29_ranged_default", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 60 THEN value ELSE 25e0 END AS value, NOT (value BETWEEN 10 AND 60) AS replaced FROM events")
def scl29(spark, d):
    v = scalar.ranged_default("value", 10, 25.0, 60)
    return graph.table(spark, d, "events").select("event_id", v.alias("value"), (~F.col("value").between(10, 60)).alias("replaced"))


@query("scl30_saturating_add", "SELECT user_id, least(CAST(sum(CAST(floor(value) AS BIGINT)*9000000) AS BIGINT), 2147483647) AS total FROM events GROUP BY user_id")
def scl30(spark, d):
    return graph.table(spark, d, "events").groupBy("user_id").agg(scalar.saturating(F.sum(F.floor("value") * 9_000_000)).alias("total"))


@query("scl31_json_aliases", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scl31(spark, d):
    return graph.table(spark, d, "events").select("event_id", scalar.json_first("props", "$.key", "$.k", kind="long").alias("k"))


@query("scl33_delay", f"{FEED} SELECT event_id, CASE WHEN event_id%2=0 THEN delay_s ELSE greatest(0, speed_kph*10-delay_s) END AS delay FROM g_traffic")
def scl33(spark, d):
    t = graph.traffic(spark, d)
    return t.select("event_id", scalar.delay_seconds(F.when(F.col("event_id") % 2 == 0, F.col("delay_s")), F.col("speed_kph") * 10, F.col("delay_s")).alias("delay"))


@query("scl34_confidence", "SELECT event_id, CASE WHEN event_id%7=0 THEN 0e0 ELSE least(1e0, greatest(0e0, value/50e0)) END AS confidence FROM events")
def scl34(spark, d):
    return graph.table(spark, d, "events").select("event_id", scalar.confidence(F.when(F.col("event_id") % 7 != 0, F.col("value") / 50.0)).alias("confidence"))


@query("scl35_flow_severity", f"{FEED} SELECT event_id, CASE WHEN speed_kph/100e0<=0.5e0 THEN 'heavy' WHEN speed_kph/100e0<0.85e0 THEN 'moderate' ELSE 'free_flow' END AS severity FROM g_traffic")
def scl35(spark, d):
    return graph.traffic(spark, d).select("event_id", scalar.flow_severity("speed_kph", F.lit(100)).alias("severity"))


@query("scl36_magnitude_severity", "SELECT event_id, CASE event_id%7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'minor' WHEN 2 THEN 'moderate' WHEN 3 THEN 'major' ELSE 'critical' END AS severity FROM events")
def scl36(spark, d):
    return graph.table(spark, d, "events").select("event_id", scalar.magnitude_severity(F.col("event_id") % 7).alias("severity"))


@query("scl37_units", "SELECT event_id, CASE event_id%4 WHEN 0 THEN value WHEN 1 THEN floor(value*1.609344e0*1e3+0.5e0)/1e3 WHEN 2 THEN floor(value*3.6e0*1e3+0.5e0)/1e3 END AS kph FROM events")
def scl37(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("kph", "MPH", "m/s", "knots"))), (F.col("event_id") % 4 + 1).cast("int"))
    v = scalar.unit_speed("value", unit)
    return graph.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, v).otherwise(milli(v)).alias("kph"))


@query("scl38_redact_url", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def scl38(spark, d):
    return graph.table(spark, d, "pages").select("page_id", scalar.without_query("url").alias("url"))


@query("scl39_route_identity", f"{GRAPH} SELECT from_node, 'edges:'||string_agg(lpad(upper(to_hex(edge_id)),16,'0'), ',' ORDER BY edge_id) AS identity FROM g_edge GROUP BY from_node")
def scl39(spark, d):
    e = graph.edges(spark, d)
    return e.groupBy("from_node").agg(F.sort_array(F.collect_list("edge_id")).alias("ids")).select("from_node", scalar.route_identity(F.col("ids")).alias("identity"))  # edges of one route


@query("scl40_traffic_edge_identity", f"{PARTS} SELECT edge_id, (({ID} & 33554431) | (i << 25)) AS identity FROM p")
def scl40(spark, d):
    g = parts(spark, d).withColumn("gid", keys.graph_id("t", "l", "i"))
    return g.select("edge_id", keys.tile_base("gid").bitwiseOR(F.shiftleft(F.col("i"), 25)).alias("identity"))
