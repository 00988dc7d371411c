"""Queries of lines of several points: each edge bent at its middle, by an offset that follows from its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import milli
from ..operators import graph
from .q_geo import ENDS, different_ends, ends
from .registry import query

#: Both segments of every edge; the same points as line() makes.
BENT = f"""{ENDS}, l AS (SELECT edge_id, lat1, lon1, (lat1+lat2)/2e0 + (edge_id%21-10)/100e0 AS lat3, (lon1+lon2)/2e0 + (edge_id%17-8)/100e0 AS lon3, lat2, lon2 FROM e),
s AS (SELECT edge_id, 0 AS i, lat1 AS ay, lon1 AS ax, lat3 AS zy, lon3 AS zx FROM l UNION ALL SELECT edge_id, 1, lat3, lon3, lat2, lon2 FROM l)"""
_H = "2e0*6378160.187e0*asin(sqrt(power(sin(radians({b}-{a})/2e0),2)+cos(radians({a}))*cos(radians({b}))*power(sin(radians({d}-{c})/2e0),2)))"
_BEARING = "degrees(atan2(sin(radians(zx-lon1))*cos(radians(zy)), cos(radians(lat1))*sin(radians(zy))-sin(radians(lat1))*cos(radians(zy))*cos(radians(zx-lon1))))"


def different_lines(spark, d):
    e, k = different_ends(spark, d), F.col("edge_id")
    p = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    middle = p((F.col("lat1") + F.col("lat2")) / 2.0 + (k % 21 - 10) / F.lit(100.0), (F.col("lon1") + F.col("lon2")) / 2.0 + (k % 17 - 8) / F.lit(100.0))
    return e.select("edge_id", F.array(p(F.col("lat1"), F.col("lon1")), middle, p(F.col("lat2"), F.col("lon2"))).alias("line"), "times")


def line(spark, d):
    return graph.repeated(different_lines(spark, d))


@query("geo13_closest_on_line", f"""{BENT}, q AS (SELECT *, (zx-ax)*cos(radians(36.25e0)) AS bx, zy-ay AS dy FROM s),
t AS (SELECT *, CASE WHEN bx*bx+dy*dy=0 THEN 0e0 ELSE least(1e0, greatest(0e0, ((-86.75e0-ax)*cos(radians(36.25e0))*bx+(36.25e0-ay)*dy)/(bx*bx+dy*dy))) END AS t FROM q),
r AS (SELECT edge_id, i, power((ay+(zy-ay)*t-36.25e0)*110567e0, 2)+power((ax+(zx-ax)*t+86.75e0)*cos(radians(36.25e0))*110567e0, 2) AS d2 FROM t)
SELECT edge_id, CAST(min_by(i, d2) AS BIGINT) AS segment, floor(sqrt(min(d2))*1e2+0.5e0)/1e2 AS meters FROM r GROUP BY 1""")
def geo13(spark, d):
    at = geo.closest_on_line(F.lit(36.25), F.lit(-86.75), F.col("line"))
    return different_lines(spark, d).select("edge_id", at.alias("p")).select("edge_id", F.col("p.i").cast("long").alias("segment"), milli(F.sqrt("p.d2"), 1e2).alias("meters"))


@query("geo05_heading_along", f"""{BENT}, h AS (SELECT *, {_H.format(a='lat1', b='lat3', c='lon1', d='lon3')} AS m1, {_H.format(a='lat3', b='lat2', c='lon3', d='lon2')} AS m2 FROM l),
p AS (SELECT edge_id, lat1, lon1, CASE WHEN m1>=30000e0 THEN lat1+(lat3-lat1)*(30000e0/m1) WHEN m1+m2>=30000e0 THEN lat3+(lat2-lat3)*((30000e0-m1)/m2) ELSE lat2 END AS zy,
  CASE WHEN m1>=30000e0 THEN lon1+(lon3-lon1)*(30000e0/m1) WHEN m1+m2>=30000e0 THEN lon3+(lon2-lon3)*((30000e0-m1)/m2) ELSE lon2 END AS zx FROM h)
SELECT edge_id, floor((CASE WHEN {_BEARING} < 0 THEN {_BEARING}+360e0 ELSE {_BEARING} END)*1e3+0.5e0)/1e3 AS heading FROM p""")
def geo05(spark, d):
    return graph.repeated(different_lines(spark, d).select("edge_id", milli(geo.heading_along(F.col("line"), F.lit(30_000.0)), 1e3).alias("heading"), "times"))


@query("geo23_self_crossings", f"""{ENDS}, l AS (SELECT edge_id, lat1 AS y1, lon1 AS x1, lat2 AS y2, lon2 AS x2, lat1+(edge_id%7-3)/10e0 AS y3, lon2 AS x3, lat2 AS y4, lon1+(edge_id%5-2)/10e0 AS x4 FROM e),
o AS (SELECT edge_id, ((x4-x3)*(y1-y3)-(x1-x3)*(y4-y3))*((x4-x3)*(y2-y3)-(x2-x3)*(y4-y3)) AS p, ((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))*((x2-x1)*(y4-y1)-(x4-x1)*(y2-y1)) AS q FROM l)
SELECT edge_id, CAST(CASE WHEN p<0 AND q<0 THEN 1 ELSE 0 END AS BIGINT) AS crossings FROM o""")
def geo23(spark, d):
    """A line of four points whose first and last segments may cross."""
    p, k = (lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))), F.col("edge_id")
    y1, x1, y2, x2 = (F.col(x) for x in ("lat1", "lon1", "lat2", "lon2"))
    four = F.array(p(y1, x1), p(y2, x2), p(y1 + (k % 7 - 3) / F.lit(10.0), x2), p(y2, x1 + (k % 5 - 2) / F.lit(10.0)))
    return graph.repeated(different_ends(spark, d).select("edge_id", F.size(geo.crossings(four)).cast("long").alias("crossings"), "times"))


@query("geo35_circle_ring", "WITH p AS (SELECT p_partkey AS id, 36e0+(p_partkey%100)/100e0 AS lat, -87e0 AS lon, 100e0+p_partkey%900 AS r FROM part), k AS (SELECT unnest(range(0, 9)) AS k) SELECT id, CAST(k AS INT) AS k, floor((lat + r/110567e0*cos((k%8)*(2e0*pi()/8e0)))*1e6+0.5e0)/1e6 AS y, -(floor(-(lon + r/110567e0/cos(radians(lat))*sin((k%8)*(2e0*pi()/8e0)))*1e6+0.5e0)/1e6) AS x FROM p, k")
def geo35(spark, d):
    from ..operators import graph

    p = graph.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(36.0) + F.col("p_partkey") % 100 / F.lit(100.0)).alias("lat"), (F.lit(100.0) + F.col("p_partkey") % 900).alias("r"))
    ring = p.select("id", F.posexplode(geo.circle_ring("lat", F.lit(-87.0), "r")).alias("k", "at"))
    return ring.select("id", "k", milli(F.col("at.lat"), 1e6).alias("y"), (-milli(-F.col("at.lon"), 1e6)).alias("x"))


@query("agg08_bounding_circle", f"""{BENT}, b AS (SELECT edge_id, (least(lat1,lat2,lat3)+greatest(lat1,lat2,lat3))/2e0 AS y, (least(lon1,lon2,lon3)+greatest(lon1,lon2,lon3))/2e0 AS x, lat1, lon1, lat2, lon2, lat3, lon3 FROM l)
SELECT edge_id, floor(greatest({_H.format(a='y', b='lat1', c='x', d='lon1')}, {_H.format(a='y', b='lat2', c='x', d='lon2')}, {_H.format(a='y', b='lat3', c='x', d='lon3')})*1e2+0.5e0)/1e2 AS meters FROM b""")
def agg08(spark, d):
    return line(spark, d).select("edge_id", milli(geo.bounding_circle(F.col("line"))["meters"], 1e2).alias("meters"))


CELLS = f"""{ENDS}, b AS (SELECT *, least(lon1,lon2) AS low, greatest(lon1,lon2) AS high FROM e),
k AS (SELECT *, unnest(range(CAST(floor(low/0.25e0) AS BIGINT), CAST(floor(high/0.25e0) AS BIGINT)+1)) AS k FROM b),
y AS (SELECT edge_id, k, CASE WHEN lon1=lon2 THEN lat1 ELSE lat1+(lat2-lat1)*((greatest(low, k*0.25e0)-lon1)/(lon2-lon1)) END AS f, CASE WHEN lon1=lon2 THEN lat2 ELSE lat1+(lat2-lat1)*((least(high, (k+1)*0.25e0)-lon1)/(lon2-lon1)) END AS g FROM k),
c AS (SELECT edge_id, k AS col, unnest(range(CAST(floor(least(f,g)/0.25e0) AS BIGINT), CAST(floor(greatest(f,g)/0.25e0) AS BIGINT)+1)) AS row FROM y)"""


def cells(spark, d):
    e = ends(spark, d).select("edge_id", F.explode(geo.cells_on_segment("lat1", "lon1", "lat2", "lon2", 0.25)).alias("c"))
    return e.select("edge_id", "c.row", "c.col")


@query("geo29_cells_on_line", f'{CELLS} SELECT edge_id, "row", col FROM c')
def geo29(spark, d):
    return cells(spark, d)


@query("jon23_edge_bins", f'{CELLS} SELECT "row", col, count(*) AS edges, min(edge_id) AS first FROM c GROUP BY 1,2')
def jon23(spark, d):
    return cells(spark, d).groupBy("row", "col").agg(F.count(F.lit(1)).alias("edges"), F.min("edge_id").alias("first"))


@query("srt09_closest_bins", """WITH p AS (SELECT c_custkey AS point_id, 36e0+((c_custkey*6151) % 10000)/2e4 AS lat, -87e0+((c_custkey*3571) % 10000)/2e4 AS lon FROM customer),
b AS (SELECT *, CAST(floor(lat/0.05e0) AS BIGINT)+r AS y, CAST(floor(lon/0.05e0) AS BIGINT)+c AS x FROM p, (VALUES (-1),(0),(1)) t(r), (VALUES (-1),(0),(1)) u(c)),
d AS (SELECT *, sqrt(power(greatest(0e0, y*0.05e0-lat, lat-(y*0.05e0+0.05e0))*110567e0, 2)+power(greatest(0e0, x*0.05e0-lon, lon-(x*0.05e0+0.05e0))*(cos(radians(lat))*110567e0), 2)) AS m FROM b)
SELECT point_id, y AS "row", x AS col, CAST(row_number() OVER (PARTITION BY point_id ORDER BY floor(m*1e2+0.5e0), y, x) AS BIGINT) AS turn FROM d""")
def srt09(spark, d):
    """The bins around a point in the order of their distance."""
    from pyspark.sql import Window

    from .q_route import points

    step = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("c")) for r in (-1, 0, 1) for k in (-1, 0, 1)])
    b = points(spark, d).withColumn("s", F.explode(step)).select("point_id", "lat", "lon", (F.floor(F.col("lat") / 0.05) + F.col("s.r")).alias("row"), (F.floor(F.col("lon") / 0.05) + F.col("s.c")).alias("col"))
    far = F.floor(geo.box_distance("lat", "lon", F.col("row") * 0.05, F.col("col") * 0.05, 0.05) * 100.0 + 0.5)
    return b.select("point_id", "row", "col", F.row_number().over(Window.partitionBy("point_id").orderBy(far, "row", "col")).cast("long").alias("turn"))
