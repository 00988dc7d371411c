"""Parts without SQL: codecs, shapes, sources, searches with restrictions, streams' storage, and the rule on the corpus folder."""

import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygrid.functions import shape
from waygrid.operators import search, snap, traffic, trip
from waygrid.operators.storage import new_path
from waygrid.sources import elevation, gtfs, osm_pbf, speeds
from waygrid.streaming import feeds

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_corpus_folder():
    for folder, _, names in os.walk(f"{TOP}/waygrid"):
        for n in names:
            if n.endswith(".py") and not folder.endswith("/llm"):
                assert not re.search(r"\bllm\b", open(f"{folder}/{n}").read()), n


def test_polylines_come_back():
    rng = random.Random(1)
    line = [(round(rng.uniform(-90, 90), 6), round(rng.uniform(-180, 180), 6)) for _ in range(50)]
    assert np.allclose(shape.decode_polyline(shape.encode_polyline(line)), line, atol=1e-9) and np.allclose(shape.decode7(shape.encode7(line)), line, atol=1e-9)
    assert shape.encode_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], 5) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert shape.decode_polyline("") == [] and shape.encode_polyline([]) == ""
    with pytest.raises(ValueError):
        shape.decode_polyline("_p~iF~ps|U_")


def test_shapes():
    line = [(0.0, 0.0), (0.0001, 0.5), (0.0, 1.0), (1.0, 1.0)]
    assert shape.simplify(line, 50) == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)] and shape.simplify(line, 50, frozenset({1})) == line and shape.simplify(line[:2], 1) == line[:2]
    assert shape.hausdorff([(0, 0), (1, 0)], [(0, 0), (1, 2)]) == 2.0
    assert shape.trim([(0.0, 0.0), (0.0, 10.0)], 0.25, 0.5) == [(0.0, 2.5), (0.0, 5.0)]
    got = shape.resample([(0.0, 0.0), (1.0, 0.0)], 110_567.0 / 4)
    assert np.allclose([a for a, _ in got][:4], [0, 0.25, 0.5, 0.75]) and got[-1] == (1.0, 0.0)
    ring = shape.clip_box([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], (1.0, 1.0, 2.0, 3.0))
    assert {tuple(p) for p in ring} == {(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (1.0, 3.0)}
    grid = np.array([[0, 10], [20, -32768]])
    assert shape.bilinear(grid, 0, 0.5) == 5.0 and math.isclose(shape.bilinear(grid, 0.5, 0.5), 10.0) and shape.bilinear(np.full((2, 2), -32768), 0.5, 0.5) is None
    week = 50 + 10 * np.sin(np.arange(2016) / 2016 * 2 * np.pi)
    c = shape.compress_profile(week)
    assert c.shape == (200,) and max(abs(shape.profile_speed(c, 300 * k) - week[k]) for k in range(0, 2016, 40)) < 0.5


FEED = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\nA,Bus,http://b,UTC", "stops": "stop_id,stop_name,stop_lat,stop_lon\nS1,One,1.0,2.0\nS2,Two,1.5,2.5\nS3,Three,1.6,2.6",
    "routes": "route_id,agency_id,route_type\nR,A,3", "trips": "route_id,service_id,trip_id\nR,W,T1\nR,X,T2\nR9,W,T3",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,08:00:00,08:01:00,S1,1\nT1,25:10:00,25:11:00,S2,2\nT1,25:20:00,25:20:00,S3,3\nT2,9:00:00,9:00:00,S9,1",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,0,0,20240101,20240114", "calendar_dates": "service_id,date,exception_type\nW,20240102,2\nW,20240106,1\nX,20240103,1",
}


def test_gtfs(spark, tmp_path):
    for name, text in FEED.items():
        (tmp_path / f"{name}.txt").write_text(text + "\n")
    feed = gtfs.read(spark, str(tmp_path))
    assert feed["frequencies"].count() == 0 and feed["stops"].schema["stop_lat"].dataType.typeName() == "double"
    assert sorted(map(tuple, gtfs.broken_references(feed).collect())) == [("stop_times", "stop_id", "S9"), ("trips", "route_id", "R9")]
    bits = {r.service_id: r.days for r in gtfs.service_bits(*gtfs.calendar_table(feed), "2024-01-01").collect()}
    assert bits == {"W": sum(1 << k for k in (0, 2, 3, 4, 5, 7, 8, 9, 10, 11)), "X": 1 << 2}
    assert sorted((r.from_stop, r.to_stop, r.departs, r.arrives) for r in gtfs.departures(feed["stop_times"], feed["trips"]).collect()) == [("S1", "S2", 28_860, 90_600), ("S2", "S3", 90_660, 91_200)]
    (tmp_path / "routes.txt").write_text("route_id\nR\n")
    with pytest.raises(ValueError):
        gtfs.read(spark, str(tmp_path))


def varint(v):
    out = bytearray()
    while v > 0x7F:
        out.append(0x80 | v & 0x7F)
        v >>= 7
    return bytes([*out, v])


def number(k, v):
    return varint(k << 3) + varint(v)


def data(k, raw):
    return varint(k << 3 | 2) + varint(len(raw)) + raw


def zig(*values):
    return b"".join(varint(v << 1 if v >= 0 else (-v << 1) - 1) for v in values)


def blob(kind, raw, squeeze=True):
    body = number(2, len(raw)) + data(3, zlib.compress(raw)) if squeeze else data(1, raw)
    head = data(1, kind.encode()) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_osm_pbf(spark, tmp_path):
    table = data(1, b"".join(data(1, s) for s in (b"", b"highway", b"primary", b"via", b"amenity", b"bicycle_rental")))
    dense = data(2, data(1, zig(10, 1, 5)) + data(8, zig(360_000_000, 5, -5)) + data(9, zig(-870_000_000, 7, -7)) + data(10, bytes([0, 4, 5, 0, 0])))
    way = data(3, number(1, 77) + data(2, bytes([1])) + data(3, bytes([2])) + data(8, zig(10, 1, 5)))
    relation = data(4, number(1, 5) + data(8, bytes([3])) + data(9, zig(11)) + data(10, bytes([0])))
    box = data(1, number(1, 2 * 870_000_000 - 1) + number(3, 2 * 360_000_000))
    raw = blob("OSMHeader", box, squeeze=False) + blob("OSMData", table + data(2, dense) + data(2, way) + data(2, relation))
    (tmp_path / "a.osm.pbf").write_bytes(raw)
    rows = {(r.kind, r.id): r for r in osm_pbf.read(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [("node", 10), ("node", 11), ("node", 16), ("relation", 5), ("way", 77)]
    assert math.isclose(rows["node", 11].lat, 36.0000005) and math.isclose(rows["node", 16].lon, -87.0) and rows["node", 11].tags == {"amenity": "bicycle_rental"} and rows["node", 10].tags == {}
    assert rows["way", 77].refs == [10, 11, 16] and rows["way", 77].tags == {"highway": "primary"}
    assert [tuple(m) for m in rows["relation", 5].members] == [("node", 11, "via")]
    assert {r.kind for r in osm_pbf.read(spark, str(tmp_path), kinds=("way", "relation")).collect()} == {"way", "relation"}
    assert [(r.kind, r.offset + r.size) for r in osm_pbf.index(spark, str(tmp_path)).orderBy("offset").collect()][-1] == ("OSMData", len(raw))
    (tmp_path / "b.osm.pbf").write_bytes(raw + blob("OSMData", table + data(2, way)) * 5)
    assert sorted(r.kind for r in osm_pbf.read(spark, str(tmp_path), tasks=3).collect()) == ["node"] * 6 + ["relation"] * 2 + ["way"] * 7
    (tmp_path / "b.osm.pbf").unlink()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.osm.pbf").write_bytes(raw[:-3])
    with pytest.raises(Exception, match="ends early"):
        osm_pbf.read(spark, str(tmp_path / "c")).collect()
    h = osm_pbf.header(spark, f"{tmp_path}/a.osm.pbf").first()
    assert math.isclose(h.left, -0.87) and math.isclose(h.top, 0.36) and h.right is None
    with pytest.raises(ValueError):
        list(osm_pbf.blobs(raw[:-3]))


def test_search_obeys_turns_and_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        a, b = rng.sample(range(12), 2)
        rows += [(2 * k, 2 * k + 1, a, b, rng.randint(1, 30)), (2 * k + 1, 2 * k, b, a, rng.randint(1, 30))]
    edges = spark.createDataFrame(rows, "edge_id long, opp_edge_id long, from_node long, to_node long, cost long")
    queries = [(k, rng.randrange(12), rng.randrange(12)) for k in range(10)]
    turns = {(a[0], b[0]): (rng.randint(0, 5), rng.random() < 0.2) for a in rows for b in rows if a[3] == b[2] and rng.random() < 0.5}

    def brute(s, t):
        if s == t:
            return 0
        best, todo = {}, [(e[4], e[0]) for e in rows if e[2] == s]
        by = {e[0]: e for e in rows}
        while todo:
            todo.sort()
            cost, e = todo.pop(0)
            if e in best:
                continue
            best[e] = cost
            for n in rows:
                if n[2] == by[e][3] and n[0] != by[e][1]:
                    extra, banned = turns.get((e, n[0]), (0, False))
                    if not banned:
                        todo.append((cost + extra + n[4], n[0]))
        return min((c for e, c in best.items() if by[e][3] == t), default=None)

    turn = spark.createDataFrame([(a, b, c, x) for (a, b), (c, x) in turns.items()], "from_edge long, to_edge long, cost long, banned boolean")
    found = search.cheapest_paths(spark.createDataFrame(queries, "query_id long, origin long, destination long"), edges, turn=turn)
    got = {r.query_id: r.cost for r in found.collect()}
    assert got == {q: c for q, s, t in queries if (c := brute(s, t)) is not None}


def test_snap_finds_far_nodes_and_respects_the_cutoff(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.4), (3, 0.0, 0.4)], "node_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 0.01, 0.01), (2, 0.0, 0.25), (3, 20.0, 20.0), (4, 0.0, 0.4)], "point_id long, lat double, lon double")
    got = {r.point_id: r.node_id for r in snap.nearest_nodes(points, nodes).collect()}
    assert got == {1: 1, 2: 2, 4: 2}
    segments = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.1), (2, 0.02, 0.0, 0.02, 0.1)], "edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    e = snap.nearest_edges(points.where("point_id = 1"), segments).first()
    far = snap.nearest_edges(spark.createDataFrame([(9, 0.0, 0.3), (10, 30.0, 0.3)], "point_id long, lat double, lon double"), segments).collect()
    assert [(r.point_id, r.edge_id, r.share) for r in far] == [(9, 1, 1.0)]
    over = snap.nearest_nodes(spark.createDataFrame([(1, 10.0, 179.99)], "point_id long, lat double, lon double"), spark.createDataFrame([(7, 10.0, -179.99)], "node_id long, lat double, lon double")).first()
    assert over.node_id == 7 and over.meters < 2300
    assert e.edge_id in (1, 2) and math.isclose(e.share, 0.1, abs_tol=1e-9) and math.isclose(e.meters, 1105.67, rel_tol=1e-6)


def test_providers(spark):
    a = '{"flowSegmentData": {"currentSpeed": 30, "freeFlowSpeed": 60, "currentTravelTime": 100, "freeFlowTravelTime": 40, "confidence": 1.5, "roadClosure": false, "observedAt": "2024-01-01T00:00:00Z"}}'
    b = '{"results": [{"id": "x", "currentFlow": {"speed": 10.0, "freeFlow": 11.0, "traversalTime": 50, "freeFlowTravelTime": 60, "jamFactor": 2.0}}, {"id": "y", "currentFlow": {"speed": 0.0, "freeFlow": 11.0, "jamFactor": 10.0}}]}'
    p = spark.createDataFrame([(1, a), (2, "not json"), (3, None)], "payload_id long, body string")
    got = {r.payload_id: r for r in traffic.provider_a_flow(p).collect()}
    assert (got[1].kind, got[1].speed_kph, got[1].delay_s, got[1].confidence, got[1].severity) == ("flow", 30.0, 60.0, 1.0, "heavy") and got[2].speed_kph is None and got[3].confidence == 0.0
    rows = traffic.provider_b_flow(spark.createDataFrame([(9, b)], "payload_id long, body string")).orderBy("speed_kph").collect()
    assert [(r.kind, r.speed_kph, r.delay_s) for r in rows] == [("closure", 0.0, None), ("flow", 36.0, 0.0)] or rows[1].delay_s == 0.0
    good, bad = traffic.split_malformed(traffic.provider_a_flow(p).withColumn("edge_id", F.lit(1)), traffic.malformed("speed_kph", "edge_id"))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"speed missing"}


def test_instructions(spark):
    row = spark.range(1).select(trip.instruction(F.lit("left"), F.lit("Main Street"), F.lit("north"), F.lit(120.0)).alias("a"), trip.instruction(F.lit("keep straight"), F.lit("B"), F.lit("x"), F.lit(1600.0)).alias("b"), trip.active_lanes(F.array(F.lit("left;through"), F.lit("right")), "left").alias("c")).first()
    assert (row.a, row.b, row.c) == ("Turn left onto Main Street.", "Continue on B for 1.5 kilometers.", ["active", "invalid"])


def test_snapshots_are_versions(spark):
    at = new_path(spark, "snap-test")
    assert feeds.current(spark, at) is None
    for v in range(1, 6):
        feeds.publish(spark.range(v), at, v)
    assert feeds.versions(spark, at) == [1, 2, 3, 4, 5] and feeds.current(spark, at).count() == 5
    assert feeds.vacuum(spark, at, keep=2, pinned={2}) == [1, 3] and feeds.versions(spark, at) == [2, 4, 5]


def test_historical_speeds(spark, tmp_path):
    week = 50 + 10 * np.sin(np.arange(2016) / 2016 * 2 * np.pi)
    (tmp_path / "a.csv").write_text(f"0/3016/0,72,41,{speeds.encode(shape.compress_profile(week))}\n0/3016/1,60,50,\nbad,1,2,\n0/3016/2,999,1,\n0/3016/3,1,2,AAAA\n0/3016/9,5,5,\n")
    good, bad = speeds.read(spark, str(tmp_path))
    assert good.count() == 3 and bad.count() == 3
    edges = spark.createDataFrame([(r.edge_id,) for r in good.orderBy("edge_id").collect()[:2]] + [(5,)], "edge_id long")
    joined, lost = speeds.apply(edges, good)
    got = joined.withColumn("v", speeds.speed_at("profile", F.lit(300 * 500))).collect()
    assert len(got) == 3 and lost.count() == 1 and max(abs(r.v - week[500]) for r in got if r.v is not None) < 0.5 and sum(r.v is None for r in got) == 2


def test_elevation(spark, tmp_path):
    side = 11
    raster = np.add.outer(np.arange(side)[::-1], np.arange(side)) * 10
    (tmp_path / "N43E007.hgt").write_bytes(raster.astype(">i2").tobytes())
    points = spark.createDataFrame([(1, 43.0, 7.0), (2, 43.5, 7.25), (3, 10.0, 10.0), (4, 43.99, 7.99)], "point_id long, lat double, lon double")
    got = {r.point_id: r.elevation for r in elevation.sample(points, spark, str(tmp_path)).collect()}
    assert got[1] == 0.0 and math.isclose(got[2], 75.0) and got[3] is None and math.isclose(got[4], 198.0)
    names = spark.createDataFrame([(-0.5, -0.5), (43.2, 7.9)], "lat double, lon double").select(elevation.tile_name("lat", "lon").alias("n")).collect()
    assert [r.n for r in names] == ["S01W001", "N43E007"]
    with pytest.raises(ValueError):
        elevation.grid(b"\0" * 10)
