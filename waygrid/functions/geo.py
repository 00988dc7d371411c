"""Geometry on longitude and latitude in degrees, and on the plane, as column expressions.

Every function takes column names or Columns and gives a Column; a null argument gives null. `milli` is how the queries round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M, METERS_PER_DEGREE_LAT = 6_378_160.187, 110_567.0


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def milli(x, scale: float = 1e3) -> Column:
    """x to thousandths, halves up: the same double in any engine."""
    return F.floor(c(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def _square(x: Column) -> Column:
    return x * x


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(c(lat2) - c(lat1)) / 2.0), F.lit(2)) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2.0), F.lit(2))
    return F.lit(2.0) * F.lit(EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def meters_per_degree_lon(lat) -> Column:
    return F.cos(F.radians(c(lat))) * METERS_PER_DEGREE_LAT


def approx_squared(lat1, lon1, lat2, lon2) -> Column:
    """Squared metres on the plane that touches at point 1."""
    return _square((c(lat2) - c(lat1)) * METERS_PER_DEGREE_LAT) + _square((c(lon2) - c(lon1)) * meters_per_degree_lon(lat1))


def heading(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing from point 1 to point 2 in [0, 360); 0 for equal points."""
    a, b, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    bearing = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when((c(lat1) == c(lat2)) & (c(lon1) == c(lon2)), F.lit(0.0)).when(bearing < 0, bearing + 360.0).otherwise(bearing)


def turn_degree(from_heading, to_heading) -> Column:
    return F.pmod(c(to_heading) - c(from_heading) + 360, F.lit(360))


def heading_difference(a, b) -> Column:
    """Between 0 and 180."""
    d = F.pmod(c(a) - c(b), F.lit(360))
    return F.least(d, F.lit(360) - d)


#: Upper bounds of the turn in whole degrees, and its kind.
TURNS = [(10, "straight"), (44, "slight right"), (135, "right"), (159, "sharp right"), (200, "reverse"), (224, "sharp left"), (315, "left"), (349, "slight left"), (359, "straight")]


def turn_type(degree) -> Column:
    out = F.when(c(degree) <= TURNS[0][0], TURNS[0][1])
    for most, kind in TURNS[1:]:
        out = out.when(c(degree) <= most, kind)
    return out


def heading_offset(road_class, is_path) -> Column:
    """Metres of shape that a heading looks at."""
    base = F.when(c(road_class) < 2, 24.0).when(c(road_class) < 5, 21.0).otherwise(15.0)
    return F.when(c(is_path), base * 0.5).otherwise(base)


def circumradius(a, b, d) -> Column:
    """Of the triangle with sides a, b, d; the largest float where it has no area."""
    s = (c(a) + c(b) + c(d)) / 2.0
    area2 = s * (s - c(a)) * (s - c(b)) * (s - c(d))
    return F.when(area2 > 0, c(a) * c(b) * c(d) / (F.lit(4.0) * F.sqrt(area2))).otherwise(F.lit(3.4028234663852886e38))


def interpolate(lat1, lon1, lat2, lon2, t) -> tuple[Column, Column]:
    """The point at share t of the great circle from point 1 to point 2, as (lat, lon)."""
    a1, o1, a2, o2 = (F.radians(c(x)) for x in (lat1, lon1, lat2, lon2))
    cosine = F.least(F.lit(1.0), F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2) * F.cos(o1 - o2))
    d = F.acos(cosine)
    u, v = F.sin((F.lit(1.0) - c(t)) * d) / F.sin(d), F.sin(c(t) * d) / F.sin(d)
    x, y, z = u * F.cos(a1) * F.cos(o1) + v * F.cos(a2) * F.cos(o2), u * F.cos(a1) * F.sin(o1) + v * F.cos(a2) * F.sin(o2), u * F.sin(a1) + v * F.sin(a2)
    same = F.sin(d) == 0
    lat, lon = F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))
    return F.when(same, c(lat1)).otherwise(lat), F.when(same, c(lon1)).otherwise(lon)


def project_share(px, py, x1, y1, x2, y2, scale=1.0) -> Column:
    """Where on the segment, from 0 to 1, the point nearest to p lies; x is scaled (cosine of the latitude). 0 for no length."""
    bx, by = c(x2) - c(x1), c(y2) - c(y1)
    bx2 = bx * c(scale)
    size = bx2 * bx2 + by * by
    t = ((c(px) - c(x1)) * c(scale) * bx2 + (c(py) - c(y1)) * by) / size
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def side(px, py, x1, y1, x2, y2) -> Column:
    """Positive if p is left of the line from point 1 to point 2, negative if right."""
    return (c(x2) - c(x1)) * (c(py) - c(y1)) - (c(px) - c(x1)) * (c(y2) - c(y1))


def winding(px, py, ring: Column) -> Column:
    """Winding number of a closed ring array<struct<x, y>> around p; 0 outside."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))

    def add(acc, s):
        a, b = s["a"], s["b"]
        left = side(px, py, a["x"], a["y"], b["x"], b["y"])
        return acc + F.when((a["y"] <= c(py)) & (b["y"] > c(py)) & (left > 0), 1).when((a["y"] > c(py)) & (b["y"] <= c(py)) & (left < 0), -1).otherwise(0)

    return F.aggregate(pairs, F.lit(0), add)


def in_triangle(px, py, ax, ay, bx, by, dx, dy) -> Column:
    s = [side(px, py, *q) for q in ((ax, ay, bx, by), (bx, by, dx, dy), (dx, dy, ax, ay))]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def segments_cross(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """Whether segments ab and pq share a point at shares in [0, 1] of both; parallel ones do not."""
    rx, ry, sx, sy = c(bx) - c(ax), c(by) - c(ay), c(qx) - c(px), c(qy) - c(py)
    cross = rx * sy - ry * sx
    t = ((c(px) - c(ax)) * sy - (c(py) - c(ay)) * sx) / F.nullif(cross, F.lit(0.0))
    u = ((c(px) - c(ax)) * ry - (c(py) - c(ay)) * rx) / F.nullif(cross, F.lit(0.0))
    return F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False))


def boxes_meet(a: tuple, b: tuple) -> Column:
    """a, b: (min x, min y, max x, max y); touching counts."""
    return (c(a[0]) <= c(b[2])) & (c(a[2]) >= c(b[0])) & (c(a[1]) <= c(b[3])) & (c(a[3]) >= c(b[1]))


def box_holds(a: tuple, x, y) -> Column:
    return (c(x) >= c(a[0])) & (c(y) >= c(a[1])) & (c(x) <= c(a[2])) & (c(y) <= c(a[3]))


#: Degrees of a tile by level; tiles have 5 by 5 bins.
TILE_DEGREES = {0: 4.0, 1: 1.0, 2: 0.25, 3: 0.25}
BINS = 5


def tile_row(lat, level: int) -> Column:
    rows = round(180 / TILE_DEGREES[level])
    return F.least(F.floor((c(lat) + 90.0) / TILE_DEGREES[level]), F.lit(rows - 1)).cast("long")


def tile_col(lon, level: int) -> Column:
    cols = round(360 / TILE_DEGREES[level])
    return F.least(F.floor((c(lon) + 180.0) / TILE_DEGREES[level]), F.lit(cols - 1)).cast("long")


def tile_id(lat, lon, level: int) -> Column:
    return tile_row(lat, level) * round(360 / TILE_DEGREES[level]) + tile_col(lon, level)


def bin_id(lat, lon, level: int) -> Column:
    """Number of the bin in its tile, row by row."""
    size = TILE_DEGREES[level]
    part = lambda x, low, at: F.least(F.floor((c(x) - low - at * size) / (size / BINS)), F.lit(BINS - 1)).cast("long")
    return part(lat, -90.0, tile_row(lat, level)) * BINS + part(lon, -180.0, tile_col(lon, level))


def tile_neighbours(tile, level: int) -> dict[str, Column]:
    """left and right wrap around; there is no row beyond the poles (the tile itself)."""
    cols, rows = round(360 / TILE_DEGREES[level]), round(180 / TILE_DEGREES[level])
    row, col = F.floor(c(tile) / cols).cast("long"), F.pmod(c(tile), F.lit(cols))
    return {
        "left": row * cols + F.pmod(col - 1, F.lit(cols)), "right": row * cols + F.pmod(col + 1, F.lit(cols)),
        "above": F.when(row < rows - 1, c(tile) + cols).otherwise(c(tile)), "below": F.when(row > 0, c(tile) - cols).otherwise(c(tile)),
    }


def tiles_in_box(box: tuple, level: int) -> Column:
    """array<long> of the tiles that a box (min lon, min lat, max lon, max lat) meets."""
    cols = round(360 / TILE_DEGREES[level])
    rows = F.sequence(tile_row(box[1], level), tile_row(box[3], level))
    return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(tile_col(box[0], level), tile_col(box[2], level)), lambda k: r * cols + k)))


def wrap_lon(lon) -> Column:
    return F.pmod(c(lon) + 180.0, F.lit(360.0)) - 180.0


def azimuthal(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Azimuthal equidistant metres (x east, y north) around a centre."""
    d, b = haversine(lat0, lon0, lat, lon), F.radians(heading(lat0, lon0, lat, lon))
    return d * F.sin(b), d * F.cos(b)


def inverse_azimuthal(x, y, lat0, lon0) -> tuple[Column, Column]:
    """(lat, lon) of such metres."""
    d, b = F.sqrt(c(x) * c(x) + c(y) * c(y)) / EARTH_RADIUS_M, F.atan2(c(x), c(y))
    a = F.radians(c(lat0))
    lat = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon = F.radians(c(lon0)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat))
    return F.degrees(lat), F.degrees(lon)


def polyline_length(shape: Column) -> Column:
    """Metres of array<struct<lat, lon>>."""
    n = F.size(shape)
    legs = F.zip_with(F.slice(shape, 1, F.greatest(n - 1, F.lit(0))), F.slice(shape, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    """Signed area of array<struct<x, y>> by the shoelace rule, closed by itself."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x) / 2.0


def vector(ax, ay, bx, by) -> dict[str, Column]:
    """dot, cross, norm of a, share of a's projection on b, and cosine of the angle; nulls where b has no length."""
    dot, na, nb = c(ax) * c(bx) + c(ay) * c(by), c(ax) * c(ax) + c(ay) * c(ay), c(bx) * c(bx) + c(by) * c(by)
    return {"dot": dot, "cross": c(ax) * c(by) - c(ay) * c(bx), "norm": F.sqrt(na), "share": dot / F.nullif(nb, F.lit(0.0)), "cosine": dot / F.nullif(F.sqrt(na) * F.sqrt(nb), F.lit(0.0))}


PI = math.pi


def segments(line: Column) -> Column:
    """The segments (i, lat1, lon1, lat2, lon2) of an array of points (lat, lon), i from 0; none of fewer than two points."""
    n = F.size(line)
    one = lambda i: F.struct(i.alias("i"), line[i]["lat"].alias("lat1"), line[i]["lon"].alias("lon1"), line[i + 1]["lat"].alias("lat2"), line[i + 1]["lon"].alias("lon2"))
    return F.when(n < 2, F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), one), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), one))


def closest_on_line(lat, lon, line: Column) -> Column:
    """(d2, i, t, lat, lon): the point of a line nearest to (lat, lon) on the plane that touches there, its squared metres, segment and share."""
    k = F.cos(F.radians(c(lat)))

    def at(s):
        t = project_share(lon, lat, s["lon1"], s["lat1"], s["lon2"], s["lat2"], k)
        y, x = s["lat1"] + (s["lat2"] - s["lat1"]) * t, s["lon1"] + (s["lon2"] - s["lon1"]) * t
        d2 = _square((y - c(lat)) * METERS_PER_DEGREE_LAT) + _square((x - c(lon)) * k * METERS_PER_DEGREE_LAT)
        return F.struct(d2.alias("d2"), s["i"].alias("i"), t.alias("t"), y.alias("lat"), x.alias("lon"))

    return F.array_min(F.transform(segments(line), at))


def heading_along(line: Column, meters) -> Column:
    """Bearing from a line's first point to the one so many metres along it, or to its last if it is shorter."""
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))

    def step(a, s):
        size = haversine(s["lat1"], s["lon1"], s["lat2"], s["lon2"])
        t = F.when(size == 0, F.lit(0.0)).otherwise((c(meters) - a["gone"]) / size)
        here = (a["gone"] + size >= c(meters)) & a["lat"].isNull()  # not yet on a segment without length
        y, x = s["lat1"] + (s["lat2"] - s["lat1"]) * t, s["lon1"] + (s["lon2"] - s["lon1"]) * t
        return F.struct((a["gone"] + size).alias("gone"), F.when(here, y).otherwise(a["lat"]).alias("lat"), F.when(here, x).otherwise(a["lon"]).alias("lon"))

    end = F.aggregate(segments(line), start, step)
    last = F.element_at(line, -1)
    return heading(line[0]["lat"], line[0]["lon"], F.coalesce(end["lat"], last["lat"]), F.coalesce(end["lon"], last["lon"]))


def crossings(line: Column) -> Column:
    """(i, j) of the segments of a line that properly cross each other, i before j; neighbours do not count."""
    all_segments = segments(line)

    def cross(a, b):
        s = lambda p, q: side(p[0], p[1], q["lon1"], q["lat1"], q["lon2"], q["lat2"])
        ends = lambda x: ((x["lon1"], x["lat1"]), (x["lon2"], x["lat2"]))
        (a1, a2), (b1, b2) = ends(a), ends(b)
        return (s(a1, b) * s(a2, b) < 0) & (s(b1, a) * s(b2, a) < 0)

    return F.flatten(F.transform(all_segments, lambda a: F.transform(F.filter(all_segments, lambda b: (b["i"] > a["i"] + 1) & cross(a, b)), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j")))))


def circle_ring(lat, lon, meters, corners: int = 8) -> Column:
    """A closed ring of corners on a circle of so many metres, clockwise from north, on the plane that touches at its centre."""
    dy = c(meters) / METERS_PER_DEGREE_LAT
    at = lambda k: F.struct((c(lat) + dy * F.cos(k * (2 * math.pi / corners))).alias("lat"), (c(lon) + dy / F.cos(F.radians(c(lat))) * F.sin(k * (2 * math.pi / corners))).alias("lon"))
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: at(k % corners))


def bounding_circle(line: Column) -> Column:
    """(lat, lon, meters): the middle of a line's box and the largest distance of its points from there, which no point is beyond."""
    low, high = (lambda f: F.array_min(F.transform(line, lambda p: p[f]))), (lambda f: F.array_max(F.transform(line, lambda p: p[f])))
    y, x = (low("lat") + high("lat")) / 2.0, (low("lon") + high("lon")) / 2.0
    return F.struct(y.alias("lat"), x.alias("lon"), F.array_max(F.transform(line, lambda p: haversine(y, x, p["lat"], p["lon"]))).alias("meters"))


def cells_on_segment(lat1, lon1, lat2, lon2, size: float) -> Column:
    """The cells (row, col) of a grid of so many degrees that a segment runs through, column by column."""
    y1, x1, y2, x2 = c(lat1), c(lon1), c(lat2), c(lon2)
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    at = lambda x: y1 + (y2 - y1) * ((x - x1) / (x2 - x1))

    def column(k):
        a, b = F.greatest(low, k * size), F.least(high, (k + 1) * size)
        first, last = F.when(x1 == x2, y1).otherwise(at(a)), F.when(x1 == x2, y2).otherwise(at(b))
        rows = F.sequence(F.floor(F.least(first, last) / size), F.floor(F.greatest(first, last) / size))
        return F.transform(rows, lambda r: F.struct(r.alias("row"), k.alias("col")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), column))


def box_distance(lat, lon, south, west, size: float) -> Column:
    """Metres from a point to the nearest place of a square of so many degrees; 0 inside."""
    dy = F.greatest(F.lit(0.0), c(south) - c(lat), c(lat) - (c(south) + size)) * METERS_PER_DEGREE_LAT
    dx = F.greatest(F.lit(0.0), c(west) - c(lon), c(lon) - (c(west) + size)) * meters_per_degree_lon(lat)
    return F.sqrt(_square(dy) + _square(dx))
