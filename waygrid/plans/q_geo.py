"""Queries of the geometry group (GEO) and of geometric aggregates, over edges with the coordinates of their ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import milli
from ..operators import graph
from .registry import GRAPH, query

ENDS = f"""{GRAPH}, e AS (SELECT g.*, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
  FROM g_edge g JOIN g_node a ON a.node_id=g.from_node JOIN g_node b ON b.node_id=g.to_node)"""


def ends(spark, d):
    """Edges with lat1, lon1, lat2, lon2."""
    return graph.repeated(different_ends(spark, d))


def different_ends(spark, d):
    """The different rows of ends(), with times: as edges meet each node of their ends' ids once more there."""
    return graph.different_edges(spark, d).withColumn("times", F.col("times") * F.col("times"))


def m(x: str, scale: str = "1e3") -> str:
    return f"floor(({x})*{scale}+0.5e0)/{scale}"


HAV = "2e0*6378160.187e0*asin(sqrt(power(sin(radians({b}lat{j}-{a}lat{i})/2e0),2)+cos(radians({a}lat{i}))*cos(radians({b}lat{j}))*power(sin(radians({b}lon{j}-{a}lon{i})/2e0),2)))"
H12 = HAV.format(a="", b="", i=1, j=2)
BEARING = "degrees(atan2(sin(radians(lon2-lon1))*cos(radians(lat2)), cos(radians(lat1))*sin(radians(lat2))-sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1))))"
HEADING = f"CASE WHEN lat1=lat2 AND lon1=lon2 THEN 0e0 WHEN {BEARING} < 0 THEN {BEARING}+360e0 ELSE {BEARING} END"


@query("geo01_haversine", f"{ENDS} SELECT edge_id, {m(H12)} AS meters FROM e")
def geo01(spark, d):
    return ends(spark, d).select("edge_id", milli(geo.haversine("lat1", "lon1", "lat2", "lon2")).alias("meters"))


@query("geo02_approx_squared_distance", f"""{ENDS} SELECT edge_id, {m("sqrt(((lat2-lat1)*110567e0)*((lat2-lat1)*110567e0) + ((lon2-lon1)*(cos(radians(lat1))*110567e0))*((lon2-lon1)*(cos(radians(lat1))*110567e0)))", "1e2")} AS meters FROM e""")
def geo02(spark, d):
    return ends(spark, d).select("edge_id", milli(F.sqrt(geo.approx_squared("lat1", "lon1", "lat2", "lon2")), 1e2).alias("meters"))


@query("geo03_meters_per_degree", f"WITH {GRAPH[5:]} SELECT node_id, {m('cos(radians(lat))*110567e0')} AS meters FROM g_node".replace("WITH WITH", "WITH"))
def geo03(spark, d):
    return graph.nodes(spark, d).select("node_id", milli(geo.meters_per_degree_lon("lat")).alias("meters"))


@query("geo04_heading", f"{ENDS} SELECT edge_id, {m(HEADING)} AS heading FROM e")
def geo04(spark, d):
    return ends(spark, d).select("edge_id", milli(geo.heading("lat1", "lon1", "lat2", "lon2")).alias("heading"))


@query("geo06_heading_offset", f"""{GRAPH} SELECT edge_id, (CASE WHEN road_class < 2 THEN 24e0 WHEN road_class < 5 THEN 21e0 ELSE 15e0 END) * CASE WHEN edge_id % 11 = 0 THEN 0.5e0 ELSE 1e0 END AS meters FROM g_edge""")
def geo06(spark, d):
    return graph.edges(spark, d).select("edge_id", geo.heading_offset("road_class", F.col("edge_id") % 11 == 0).alias("meters"))


@query("geo07_turn_degree", f"""{GRAPH}, t AS (SELECT edge_id, CAST(edge_id % 360 AS INT) AS a, CAST((edge_id*7) % 360 AS INT) AS b FROM g_edge)
SELECT edge_id, (b-a+360) % 360 AS turn, least((b-a+360) % 360, 360-((b-a+360) % 360)) AS difference FROM t""")
def geo07(spark, d):
    t = graph.edges(spark, d).select("edge_id", (F.col("edge_id") % 360).cast("int").alias("a"), (F.col("edge_id") * 7 % 360).cast("int").alias("b"))
    return t.select("edge_id", geo.turn_degree("a", "b").alias("turn"), geo.heading_difference("b", "a").alias("difference"))


@query("geo08_turn_type", f"""{GRAPH} SELECT edge_id, CASE WHEN v<=10 THEN 'straight' WHEN v<=44 THEN 'slight right' WHEN v<=135 THEN 'right' WHEN v<=159 THEN 'sharp right'
 WHEN v<=200 THEN 'reverse' WHEN v<=223 THEN 'sharp left' WHEN v<=224 THEN 'sharp left' WHEN v<=315 THEN 'left' WHEN v<=349 THEN 'slight left' ELSE 'straight' END AS turn
FROM (SELECT edge_id, edge_id % 360 AS v FROM g_edge) t""")
def geo08(spark, d):
    return graph.edges(spark, d).select("edge_id", geo.turn_type(F.col("edge_id") % 360).alias("turn"))


@query("geo10_circumradius", f"""{GRAPH}, t AS (SELECT edge_id, length_m AS a, length_m*0.75e0 AS b, 10e0+length_m*0.5e0 AS c FROM g_edge),
u AS (SELECT *, (a+b+c)/2e0 AS s FROM t), v AS (SELECT *, s*(s-a)*(s-b)*(s-c) AS q FROM u)
SELECT edge_id, CASE WHEN q > 0 THEN {m("a*b*c/(4e0*sqrt(q))", "1e1")} ELSE -1e0 END AS radius FROM v""")
def geo10(spark, d):
    r = geo.circumradius("length_m", F.col("length_m") * 0.75, F.lit(10.0) + F.col("length_m") * 0.5)
    return graph.edges(spark, d).select("edge_id", F.when(r < 1e30, milli(r, 1e1)).otherwise(F.lit(-1.0)).alias("radius"))


@query("geo11_interpolate", f"""{ENDS}, r AS (SELECT edge_id, lat1, lon1, lat2, lon2, radians(lat1) a1, radians(lon1) o1, radians(lat2) a2, radians(lon2) o2 FROM e),
s AS (SELECT *, acos(least(1e0, sin(a1)*sin(a2)+cos(a1)*cos(a2)*cos(o1-o2))) AS dd FROM r),
t AS (SELECT *, sin(0.75e0*dd)/nullif(sin(dd),0) AS u, sin(0.25e0*dd)/nullif(sin(dd),0) AS v FROM s),
w AS (SELECT *, u*cos(a1)*cos(o1)+v*cos(a2)*cos(o2) AS x, u*cos(a1)*sin(o1)+v*cos(a2)*sin(o2) AS y, u*sin(a1)+v*sin(a2) AS z FROM t)
SELECT edge_id, {m("CASE WHEN sin(dd)=0 THEN lat1 ELSE degrees(atan2(z, sqrt(x*x+y*y))) END", "1e5")} AS lat, -{m("-(CASE WHEN sin(dd)=0 THEN lon1 ELSE degrees(atan2(y, x)) END)", "1e5")} AS lon FROM w""")
def geo11(spark, d):
    lat, lon = geo.interpolate("lat1", "lon1", "lat2", "lon2", 0.25)
    return graph.repeated(different_ends(spark, d).select("edge_id", milli(lat, 1e5).alias("lat"), (-milli(-lon, 1e5)).alias("lon"), "times"))


@query("geo12_project_on_segment", f"""{ENDS}, p AS (SELECT *, 36.25e0 AS py, -86.75e0 AS px, cos(radians(36.25e0)) AS k FROM e),
q AS (SELECT *, (lon2-lon1)*k AS bx, lat2-lat1 AS by2 FROM p),
r AS (SELECT *, bx*bx+by2*by2 AS s FROM q)
SELECT edge_id, CASE WHEN s=0 THEN 0e0 ELSE {m("least(1e0,greatest(0e0,((px-lon1)*k*bx+(py-lat1)*by2)/s))", "1e6")} END AS share FROM r""")
def geo12(spark, d):
    k = F.cos(F.radians(F.lit(36.25)))
    return ends(spark, d).select("edge_id", milli(geo.project_share(F.lit(-86.75), F.lit(36.25), "lon1", "lat1", "lon2", "lat2", k), 1e6).alias("share"))


@query("geo14_side_of_line", f"""{ENDS} SELECT edge_id, CAST(sign((lon2-lon1)*(36.25e0-lat1)-(-86.75e0-lon1)*(lat2-lat1)) AS INT) AS side FROM e""")
def geo14(spark, d):
    return ends(spark, d).select("edge_id", F.signum(geo.side(F.lit(-86.75), F.lit(36.25), "lon1", "lat1", "lon2", "lat2")).cast("int").alias("side"))


@query("geo15_point_in_polygon", f"""{GRAPH} SELECT node_id, (abs(lon+86.75e0)+abs(lat-36.25e0) < 0.2e0) AS inside FROM g_node WHERE abs(abs(lon+86.75e0)+abs(lat-36.25e0)-0.2e0) > 1e-9""")
def geo15(spark, d):
    ring = [(-86.55, 36.25), (-86.75, 36.45), (-86.95, 36.25), (-86.75, 36.05), (-86.55, 36.25)]
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    away = F.abs(F.col("lon") + 86.75) + F.abs(F.col("lat") - 36.25)
    return graph.nodes(spark, d).where(F.abs(away - 0.2) > 1e-9).select("node_id", (geo.winding("lon", "lat", shape) != 0).alias("inside"))


@query("geo16_triangle", f"""{GRAPH} SELECT node_id, (lon >= -87e0 AND lat >= 36e0 AND (lon+87e0)+(lat-36e0) <= 0.4e0) AS inside FROM g_node WHERE abs((lon+87e0)+(lat-36e0)-0.4e0) > 1e-9""")
def geo16(spark, d):
    n = graph.nodes(spark, d).where(F.abs((F.col("lon") + 87.0) + (F.col("lat") - 36.0) - 0.4) > 1e-9)
    return n.select("node_id", geo.in_triangle("lon", "lat", *map(F.lit, (-87.0, 36.0, -86.6, 36.0, -87.0, 36.4))).alias("inside"))


CROSS = "(lon2-lon1)*0.3e0-(lat2-lat1)*0.4e0"


@query("geo17_segments_cross", f"""{ENDS}, x AS (SELECT edge_id, nullif({CROSS}, 0e0) AS c, (-86.95e0-lon1) AS wx, (36.1e0-lat1) AS wy, lon2-lon1 AS rx, lat2-lat1 AS ry FROM e)
SELECT edge_id, coalesce((wx*0.3e0-wy*0.4e0)/c BETWEEN 0 AND 1 AND (wx*ry-wy*rx)/c BETWEEN 0 AND 1, false) AS crosses FROM x
WHERE abs(coalesce((wx*0.3e0-wy*0.4e0)/c, 9)) > 1e-9 AND abs(coalesce((wx*0.3e0-wy*0.4e0)/c, 9)-1) > 1e-9 AND abs(coalesce((wx*ry-wy*rx)/c, 9)) > 1e-9 AND abs(coalesce((wx*ry-wy*rx)/c, 9)-1) > 1e-9""")
def geo17(spark, d):
    e = ends(spark, d)
    rx, ry = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    wx, wy, k = F.lit(-86.95) - F.col("lon1"), F.lit(36.1) - F.col("lat1"), F.nullif(rx * 0.3 - ry * 0.4, F.lit(0.0))
    t, u = F.coalesce((wx * 0.3 - wy * 0.4) / k, F.lit(9.0)), F.coalesce((wx * ry - wy * rx) / k, F.lit(9.0))
    clear = (F.abs(t) > 1e-9) & (F.abs(t - 1) > 1e-9) & (F.abs(u) > 1e-9) & (F.abs(u - 1) > 1e-9)
    far = (F.lit(-86.95) + 0.4, F.lit(36.1) + 0.3)
    return e.where(clear).select("edge_id", geo.segments_cross("lon1", "lat1", "lon2", "lat2", F.lit(-86.95), F.lit(36.1), *far).alias("crosses"))


@query("geo19_box_relations", f"""{ENDS}, b AS (SELECT edge_id, least(lon1,lon2) x0, greatest(lon1,lon2) x1, least(lat1,lat2) y0, greatest(lat1,lat2) y1 FROM e)
SELECT edge_id, (x0 <= -86.7e0 AND x1 >= -86.8e0 AND y0 <= 36.3e0 AND y1 >= 36.2e0) AS meets, (-86.75e0 BETWEEN x0 AND x1 AND 36.25e0 BETWEEN y0 AND y1) AS holds FROM b""")
def geo19(spark, d):
    box = (F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2"))
    other = tuple(map(F.lit, (-86.8, 36.2, -86.7, 36.3)))
    return ends(spark, d).select("edge_id", geo.boxes_meet(box, other).alias("meets"), geo.box_holds(box, F.lit(-86.75), F.lit(36.25)).alias("holds"))


@query("geo26_tile_and_bin", f"""{GRAPH}, t AS (SELECT node_id, lat, lon, CAST(floor((lat+90e0)/0.25e0) AS BIGINT) AS r, CAST(floor((lon+180e0)/0.25e0) AS BIGINT) AS c FROM g_node)
SELECT node_id, CAST(floor((lat+90e0)/4e0) AS BIGINT)*90+CAST(floor((lon+180e0)/4e0) AS BIGINT) AS tile0,
  CAST(floor((lat+90e0)) AS BIGINT)*360+CAST(floor((lon+180e0)) AS BIGINT) AS tile1, r*1440+c AS tile2,
  CAST(least(4, floor((lat+90e0-r*0.25e0)/0.05e0)) AS BIGINT)*5+CAST(least(4, floor((lon+180e0-c*0.25e0)/0.05e0)) AS BIGINT) AS bin FROM t""")
def geo26(spark, d):
    return graph.nodes(spark, d).select("node_id", *[geo.tile_id("lat", "lon", k).alias(f"tile{k}") for k in range(3)], geo.bin_id("lat", "lon", 2).alias("bin"))


@query("geo27_tile_neighbours", f"""{GRAPH}, t AS (SELECT node_id, CAST((node_id*977) % 1036800 AS BIGINT) AS tile FROM g_node)
SELECT node_id, tile, (tile//1440)*1440+(tile%1440+1439)%1440 AS "left", (tile//1440)*1440+(tile%1440+1)%1440 AS "right",
  CASE WHEN tile//1440 < 719 THEN tile+1440 ELSE tile END AS above, CASE WHEN tile//1440 > 0 THEN tile-1440 ELSE tile END AS below FROM t""")
def geo27(spark, d):
    t = graph.nodes(spark, d).select("node_id", (F.col("node_id") * 977 % 1_036_800).alias("tile"))
    return t.select("node_id", "tile", *[v.cast("long").alias(k) for k, v in geo.tile_neighbours("tile", 2).items()])


@query("geo28_tiles_in_box", f"""{ENDS}, b AS (SELECT edge_id, CAST(floor((least(lat1,lat2)+90e0)/0.25e0) AS BIGINT) r0, CAST(floor((greatest(lat1,lat2)+90e0)/0.25e0) AS BIGINT) r1,
  CAST(floor((least(lon1,lon2)+180e0)/0.25e0) AS BIGINT) c0, CAST(floor((greatest(lon1,lon2)+180e0)/0.25e0) AS BIGINT) c1 FROM e)
SELECT edge_id, r*1440+c AS tile FROM b, unnest(range(r0, r1+1)) AS t(r), unnest(range(c0, c1+1)) AS u(c)""")
def geo28(spark, d):
    box = (F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2"))
    return ends(spark, d).select("edge_id", F.explode(geo.tiles_in_box(box, 2)).alias("tile"))


@query("geo31_vector_algebra", f"""{ENDS} SELECT edge_id, {m("(lon2-lon1)*3e0+(lat2-lat1)*4e0+9e0", "1e6")} AS dot, {m("(lon2-lon1)*4e0-(lat2-lat1)*3e0+9e0", "1e6")} AS cross_product,
  {m("((lon2-lon1)*3e0+(lat2-lat1)*4e0)/25e0+9e0", "1e6")} AS share FROM e""")
def geo31(spark, d):
    v = geo.vector(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1"), F.lit(3.0), F.lit(4.0))
    return ends(spark, d).select("edge_id", *[milli(v[k] + 9.0, 1e6).alias(a) for k, a in (("dot", "dot"), ("cross", "cross_product"), ("share", "share"))])


@query("geo33_wrap_longitude", f"""{GRAPH}, t AS (SELECT node_id, lon + (node_id % 9 - 4) * 360e0 AS x FROM g_node)
SELECT node_id, {m("(x+180e0) - 360e0*floor((x+180e0)/360e0)", "1e6")} - 180e0 AS lon FROM t""")
def geo33(spark, d):
    x = F.col("lon") + (F.col("node_id") % 9 - 4) * 360.0
    return graph.nodes(spark, d).select("node_id", (milli(geo.wrap_lon(x) + 180.0, 1e6) - 180.0).alias("lon"))


@query("geo34_azimuthal_equidistant", f"""WITH {GRAPH[5:]}, p AS (SELECT node_id, 36.25e0 AS lat1, -86.75e0 AS lon1, lat AS lat2, lon AS lon2 FROM g_node),
q AS (SELECT node_id, {H12} AS d, radians({HEADING}) AS h FROM p)
SELECT node_id, {m("d*sin(h)+1e6", "1e1")} AS x, {m("d*cos(h)+1e6", "1e1")} AS y FROM q""".replace("WITH WITH", "WITH"))
def geo34(spark, d):
    x, y = geo.azimuthal("lat", "lon", F.lit(36.25), F.lit(-86.75))
    return graph.nodes(spark, d).select("node_id", milli(x + 1e6, 1e1).alias("x"), milli(y + 1e6, 1e1).alias("y"))


@query("geo34_azimuthal_inverse", f"""{GRAPH} SELECT node_id, {m("lat", "1e6")} AS lat, -({m("-lon", "1e6")}) AS lon FROM g_node""")
def geo34_inverse(spark, d):
    x, y = geo.azimuthal("lat", "lon", F.lit(36.2512345), F.lit(-86.7512345))
    lat, lon = geo.inverse_azimuthal("x", "y", F.lit(36.2512345), F.lit(-86.7512345))
    return graph.nodes(spark, d).select("node_id", x.alias("x"), y.alias("y")).select("node_id", milli(lat, 1e6).alias("lat"), (-milli(-lon, 1e6)).alias("lon"))


@query("agg05_polyline_length", f"""{ENDS}, s AS (SELECT edge_id, {H12} AS leg, {HAV.format(a='', b='', i=1, j=1)} AS zero FROM e)
SELECT edge_id, {m("leg+leg+zero", "1e1")} AS meters FROM s""")
def agg05(spark, d):
    p = lambda i: F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon"))
    return ends(spark, d).select("edge_id", milli(geo.polyline_length(F.array(p(1), p(2), p(1), p(1))), 1e1).alias("meters"))


@query("agg06_bounding_box", f"""{ENDS} SELECT road_class, min(least(lat1,lat2)) AS min_lat, max(greatest(lat1,lat2)) AS max_lat, min(least(lon1,lon2)) AS min_lon, max(greatest(lon1,lon2)) AS max_lon FROM e GROUP BY road_class""")
def agg06(spark, d):
    low, high = (lambda x: F.min(F.least(f"{x}1", f"{x}2")).alias(f"min_{x}")), (lambda x: F.max(F.greatest(f"{x}1", f"{x}2")).alias(f"max_{x}"))
    return ends(spark, d).groupBy("road_class").agg(low("lat"), high("lat"), low("lon"), high("lon"))


@query("agg07_region_bounding_box", f"""{ENDS} SELECT min(least(lat1,lat2)) AS min_lat, max(greatest(lat1,lat2)) AS max_lat, min(least(lon1,lon2)) AS min_lon, max(greatest(lon1,lon2)) AS max_lon, count(*) AS edges
FROM e WHERE least(lon1,lon2) <= -86.7e0 AND greatest(lon1,lon2) >= -86.8e0 AND least(lat1,lat2) <= 36.3e0 AND greatest(lat1,lat2) >= 36.2e0""")
def agg07(spark, d):
    box = (F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2"))
    inside = ends(spark, d).where(geo.boxes_meet(box, tuple(map(F.lit, (-86.8, 36.2, -86.7, 36.3)))))
    return inside.agg(F.min(box[1]).alias("min_lat"), F.max(box[3]).alias("max_lat"), F.min(box[0]).alias("min_lon"), F.max(box[2]).alias("max_lon"), F.count(F.lit(1)).alias("edges"))


@query("agg09_ring_area", f"""{ENDS} SELECT edge_id, {m("abs((lon2-lon1)*(lat2-lat1))", "1e6")} AS area FROM e""")
def agg09(spark, d):
    corner = lambda i, j: F.struct(F.col(f"lon{i}").alias("x"), F.col(f"lat{j}").alias("y"))
    ring = F.array(corner(1, 1), corner(2, 1), corner(2, 2), corner(1, 2))
    return ends(spark, d).select("edge_id", milli(F.abs(geo.ring_area(ring)), 1e6).alias("area"))


@query("prj14_polyline_round_trip", f"""{ENDS} SELECT edge_id, floor(lat1*1e6+0.5e0)/1e6 AS lat, -(floor(-lon2*1e6+0.5e0)/1e6) AS lon FROM e""")
def prj14(spark, d):
    from ..functions import shape

    p = lambda i: F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon"))
    e = different_ends(spark, d).select("edge_id", "times", shape.polyline_shape(shape.polyline_text(F.array(p(1), p(2)))).alias("s"))
    return graph.repeated(e.select("edge_id", F.col("s")[0]["lat"].alias("lat"), F.col("s")[1]["lon"].alias("lon"), "times"))
