"""Areas of points, map relations, rings of tiles and boundary loads against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ballotlake.operators import reconcile, spatial, tiles
from ballotlake.sources import files
from ballotlake.sources.current import Current

RINGS = "array<array<struct<lng:double,lat:double>>>"


def plain_inside(x, y, ring):
    hit = False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
        if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
            hit = not hit
    return hit


@pytest.mark.parametrize("cell", [0.5, 3.0, 100.0])
def test_first_area_that_holds_a_point(spark, cell):
    draw = random.Random(4)
    areas = []
    for k in range(12):
        x, y = draw.uniform(-10, 10), draw.uniform(-10, 10)
        star = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in ((i * 0.6, draw.uniform(1, 4)) for i in range(10))]
        hole = [(x - 0.4, y - 0.4), (x + 0.4, y - 0.4), (x, y + 0.4), (x - 0.4, y - 0.4)]
        far = [(x + 9, y), (x + 10, y), (x + 10, y + 1), (x + 9, y)]
        areas.append((f"a{k}", 12 - k, [[[*star, star[0]], hole], [far]]))
    points = [(i, draw.uniform(-14, 14), draw.uniform(-14, 14)) for i in range(600)] + [(600, None, 1.0), (601, 0.0, None)]
    df = spark.createDataFrame(areas, f"area string, at long, polygons array<{RINGS}>")
    found = {r.id: r.area for r in spatial.locate(spark.createDataFrame(points, "id long, lng double, lat double"), df, "id", cell).collect()}
    for i, x, y in points:
        holds = [(at, name) for name, at, polygons in areas if x is not None and y is not None and any(plain_inside(x, y, p[0]) and not any(plain_inside(x, y, h) for h in p[1:]) for p in polygons)]
        assert found[i] == (min(holds)[1] if holds else None)
    assert len(set(found.values())) > 5


def test_no_pair_of_all_points_and_all_areas_in_the_plan(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    points, areas = spark.range(5).selectExpr("id", "id / 2 lng", "id / 3 lat"), spark.createDataFrame([("a", 1, [[ring]])], f"area string, at long, polygons array<{RINGS}>")
    plan = spatial.locate(points, areas, "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def way(points, role="outer"):
    return {"type": "way", "role": role, "geometry": [{"lat": y, "lon": x} for x, y in points]}


def test_map_extracts(spark, tmp_path):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    relation = lambda i, tags, *members: {"type": "relation", "id": i, "tags": tags, "members": list(members)}
    elements = [
        relation(1, {"admin_level": "6", "name": "First"}, way(box(0, 0, 10))), relation(2, {"admin_level": "6", "name": "Second"}, way(box(5, 5, 10))), relation(3, {"admin_level": "6"}, way(box(0, 0, 99))),
        relation(4, {"admin_level": "8", "name": "in both"}, way(box(6, 6, 1))), relation(5, {"admin_level": "8", "name": "second only"}, way(box(12, 12, 1)), way(box(30, 30, 1)), way(box(12.2, 12.2, 0.1), "inner")),
        relation(6, {"admin_level": "8", "name": "said", "is_in:lga": "Told"}, way(box(6, 6, 1))), relation(7, {"admin_level": "8", "name": "nowhere"}, way(box(50, 50, 1))),
        relation(8, {"admin_level": "8"}, way(box(6, 6, 1))), relation(9, {"admin_level": "8", "name": "no ring"}, way([(1, 1), (2, 2), (1, 1)])), relation(10, {"admin_level": "8", "name": "holes only"}, way(box(1, 1, 1), "inner")),
        {"type": "way", "id": 11, "tags": {"admin_level": "8", "name": "a way"}}, relation(12, {"admin_level": "8", "name": "no members"}),
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1}))
    wards = {r.wardname: r for r in spatial.wards_of(files.osm(spark, str(tmp_path))).collect()}
    assert {n: r.lganame for n, r in wards.items()} == {"in both": "First", "second only": "Second", "said": "Told", "nowhere": ""}
    shape = wards["second only"].polygons
    assert wards["in both"].wardcode == "OSM-4" and [len(p) for p in shape] == [2, 1]
    assert all(ring[0] == ring[-1] and len(ring) == 5 for polygon in shape for ring in polygon)


def plain_clip(points, low, high):
    """Sutherland and Hodgman, a side at a time, of an open ring."""
    for axis in (0, 1):
        for sign, limit in ((1, high), (-1, low)):
            out = []
            for k, q in enumerate(points):
                p = points[k - 1]
                p_in, q_in = sign * p[axis] <= sign * limit, sign * q[axis] <= sign * limit
                if p_in != q_in:
                    share = (limit - p[axis]) / (q[axis] - p[axis])
                    cut = [0.0, 0.0]
                    cut[axis], cut[1 - axis] = float(limit), p[1 - axis] + share * (q[1 - axis] - p[1 - axis])
                    out.append(tuple(cut))
                if q_in:
                    out.append(q)
            points = out
    return points


def half_up(x):
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def plain_tile(rings, zoom, tx, ty):
    out = []
    for ring in rings:
        plane = []
        for lng, lat in ring[:-1]:
            phi = math.radians(lat)
            plane.append((((lng + 180) / 360 * 2**zoom - tx) * 4096, ((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * 2**zoom - ty) * 4096))
        whole = [(half_up(x), half_up(y)) for x, y in plain_clip(plane, -64, 4096 + 64)]
        turn = [p for k, p in enumerate(whole) if p != whole[k - 1]]
        out.append([*turn, turn[0]] if len(turn) >= 3 else None)
    return [r for r in out if r] if out[0] else None


@pytest.mark.parametrize("zoom", [3, 6])
def test_rings_of_tiles_equal_a_plain_version(spark, zoom):
    draw = random.Random(9)
    areas = []
    for k in range(8):
        x, y = draw.uniform(-20, 20), draw.uniform(-20, 40)
        star = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in ((i * 0.7, draw.uniform(1, 12)) for i in range(9))]
        hole = [(x - 0.3, y - 0.3), (x + 0.3, y - 0.3), (x, y + 0.3)]
        areas.append((k, [[*star, star[0]], [*hole, hole[0]]]))
    rows = tiles.ring_features(spark.createDataFrame(areas, f"id long, rings {RINGS}"), zoom).collect()
    found = {(r.id, r.tile_x, r.tile_y): [[(p.x, p.y) for p in ring] for ring in r.rings] for r in rows}
    expected = {}
    for k, rings in areas:
        for tx in range(2**zoom):
            for ty in range(2**zoom):
                lngs = [(lng + 180) / 360 * 2**zoom for lng, _ in rings[0]]
                lats = [(1 - math.log(math.tan(math.radians(a)) + 1 / math.cos(math.radians(a))) / math.pi) / 2 * 2**zoom for _, a in rings[0]]
                if math.floor(min(lngs)) <= tx <= math.floor(max(lngs)) and math.floor(min(lats)) <= ty <= math.floor(max(lats)) and (cut := plain_tile(rings, zoom, tx, ty)):
                    expected[(k, tx, ty)] = cut
    assert found == expected and len(found) > 15


def test_an_area_larger_than_a_tile_fills_it(spark):
    ring = [(-60.0, -60.0), (60.0, -60.0), (60.0, 60.0), (-60.0, 60.0), (-60.0, -60.0)]
    rows = tiles.ring_features(spark.createDataFrame([(1, [ring])], f"id long, rings {RINGS}"), 5).filter("tile_x = 16 and tile_y = 16").collect()
    assert {(p.x, p.y) for p in rows[0].rings[0]} == {(-64, -64), (-64, 4160), (4160, -64), (4160, 4160)}


def test_points_beyond_the_map_are_in_no_tile(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 10.0, 89.9), (4, 180.0, 0.0), (5, -180.0, 0.0)], "id long, lng double, lat double")
    assert {r.id: (r.tile_x, r.tile_y, r.x, r.y) for r in tiles.point_features(df, 1).collect()} == {1: (1, 1, 0, 0), 5: (0, 1, 0, 0)}


def test_boundary_load_writes_and_counts_once(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    schema = f"at long, source_id string, ward_code string, confidence double, reason string, kind string, polygon {RINGS}, polygons array<{RINGS}>"
    rows = [
        (1, "a", "w1", 0.9, "exact", "Polygon", [ring], None), (2, "b", "w1", 0.8, "fuzzy", "MultiPolygon", None, [[ring], [ring]]), (3, "c", None, 0.0, "no_ward", "Polygon", [ring], None),
        (4, "d", "w2", 0.79, "needs_review", "Polygon", [ring], None), (5, "e", "w3", 1.0, "exact", "Point", None, None), (6, "f", "w4", 1.0, "exact", None, None, None),
    ]
    table = Current(spark, f"{tmp_path}/t", ["ward_code"], 2)
    counts = reconcile.load(spark.createDataFrame(rows, schema), table, f"{tmp_path}/report")
    assert counts == {"loaded": 2, "skipped_no_match": 1, "skipped_low_confidence": 1, "skipped_bad_geom": 2}
    assert [(r.ward_code, r.source_id, len(r.polygons)) for r in table.read().collect()] == [("w1", "b", 2)]
    report = {r.source_id: r.action for r in spark.read.parquet(f"{tmp_path}/report").collect()}
    assert report == {"a": "loaded", "b": "loaded", "c": "skipped_no_match", "d": "skipped_low_confidence", "e": "skipped_bad_geom", "f": "skipped_bad_geom"}
    again = reconcile.load(spark.createDataFrame(rows[:1], schema), table, f"{tmp_path}/again", least=0.95)
    assert again["skipped_low_confidence"] == 1 and table.read().count() == 1


def test_areas_without_boundary_are_points(spark):
    places = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    boundaries = spark.createDataFrame([("a", [[[(0.0, 0.0)]]])], f"code string, polygons array<{RINGS}>")
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "code string, lng double, lat double")
    found = {r.code: (r.geometry, r.point and r.point.lng) for r in spatial.placed(places, boundaries, points).collect()}
    assert found == {"a": ("polygon", None), "b": ("point", 3.0), "c": (None, None)}
    assert spark.range(1).select(spatial.multipolygon(F.lit("Point"), F.lit(None).cast(RINGS), F.lit(None).cast(f"array<{RINGS}>")).alias("p")).first().p is None
