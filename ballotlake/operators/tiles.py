"""What a map tile shows: points and clipped rings in the tile's own grid, and the attributes of units and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import tile
from .rollups import status_code

EXTENT, BUFFER = 4096, 64


def tile_xy(lng: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Place of a point in the plane of all tiles of a zoom, in tiles: the web projection, y downwards."""
    n = float(2**zoom)
    phi = F.radians(lat)
    return (lng + 180) / 360 * n, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.pi()) / 2 * n


def _once(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clipped_side(ring: Column, axis: str, sign: int, limit: int) -> Column:
    """An open ring (array of structs x, y) cut at one side of a box: the points within, and those where edges cross it.

    Each point is looked at with the one before it: an edge that enters gives the crossing and the point, one that
    leaves the crossing. A ring that lies within stays as it is.
    """
    other = "y" if axis == "x" else "x"
    inside = lambda p: sign * p[axis] <= sign * limit

    def crossing(p: Column, q: Column) -> Column:
        share = (F.lit(float(limit)) - p[axis]) / (q[axis] - p[axis])
        cut = {axis: F.lit(float(limit)), other: p[other] + share * (q[other] - p[other])}
        return F.struct(cut["x"].alias("x"), cut["y"].alias("y"))

    def step(p: Column, q: Column) -> Column:
        kept, crosses = F.struct(q["x"].alias("x"), q["y"].alias("y")), inside(p) != inside(q)
        came = F.when(crosses, F.array(crossing(p, q), kept)).otherwise(F.array(kept))
        return F.when(inside(q), came).when(crosses, F.array(crossing(p, q))).otherwise(F.array())

    return F.when(F.forall(ring, inside), ring).otherwise(F.flatten(F.zip_with(_before(ring), ring, step)))


def _before(ring: Column) -> Column:
    """The point before each of an open ring's points."""
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))


def _quantised(ring: Column) -> Column:
    """Whole coordinates, repeats in a row left out, closed; null with fewer than three different points in turn."""
    whole = F.transform(ring, lambda p: F.struct(F.round(p["x"]).cast("long").alias("x"), F.round(p["y"]).cast("long").alias("y")))
    pairs = lambda w: F.zip_with(_before(w), w, lambda p, q: F.struct((p != q).alias("differ"), q.alias("at")))
    turn = F.transform(F.filter(_once(whole, pairs), lambda e: e["differ"]), lambda e: e["at"])
    return _once(turn, lambda t: F.when(F.size(t) >= 3, F.concat(t, F.slice(t, 1, 1))))


def ring_features(areas: DataFrame, zoom: int, extent: int = EXTENT, buffer: int = BUFFER) -> DataFrame:
    """areas (rings: closed rings of one polygon, of structs lng and lat; any others) by tile: tile_x, tile_y, and rings cut and quantised to it.

    A polygon is in the tiles that its bounding box meets, and is cut to each with this much around it. Rings that shrink to
    less than three points go; without its outer ring a polygon is not in the tile. A polygon as large as the map
    has a row for each tile of the zoom. Polygons are dealt over tasks first, as a file of many may be one task's.
    """
    placed = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(*(c.alias(a) for c, a in zip(tile_xy(p["lng"], p["lat"], zoom), "xy")))))
    edge = 2**zoom - 1

    def with_spans(plane: Column) -> Column:
        outer = F.get(plane, F.lit(0))
        span = lambda a: F.sequence(*(F.greatest(F.lit(0), F.least(F.lit(edge), F.floor(f(F.transform(outer, lambda p: p[a]))))).cast("int") for f in (F.array_min, F.array_max)))
        return F.struct(plane.alias("plane"), span("x").alias("x"), span("y").alias("y"))

    # a generator computes its value once, where a plain column is copied into each of its uses
    rows = areas.repartition(F.xxhash64("rings")).withColumn("placed_", F.explode(F.array(_once(placed, with_spans))))
    each = rows.withColumn("tile_x", F.explode("placed_.x")).withColumn("tile_y", F.explode("placed_.y"))
    local = F.transform("placed_.plane", lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda p: F.struct(((p["x"] - F.col("tile_x")) * extent).alias("x"), ((p["y"] - F.col("tile_y")) * extent).alias("y"))))

    def cut(ring: Column) -> Column:
        for axis, sign, limit in (("x", 1, extent + buffer), ("x", -1, -buffer), ("y", 1, extent + buffer), ("y", -1, -buffer)):
            ring = _once(ring, lambda r: _clipped_side(r, axis, sign, limit))  # noqa: B023
        return _quantised(ring)

    kept = F.filter(F.array(F.transform(local, cut)), lambda rings: F.get(rings, F.lit(0)).isNotNull())
    each = each.withColumn("cut_", F.explode(kept)).withColumn("rings", F.filter("cut_", lambda r: r.isNotNull()))
    return each.drop("placed_", "cut_")


def point_features(rows: DataFrame, zoom: int, extent: int = EXTENT) -> DataFrame:
    """rows (lng, lat, any others) with tile_x, tile_y, x, y: the tile that holds each point and its place in the tile's grid.

    Points without a place, and those beyond the map, are in no tile.
    """
    tx, ty = tile(F.col("lat"), F.col("lng"), zoom)
    px, py = tile_xy(F.col("lng"), F.col("lat"), zoom)
    held = rows.withColumns({"tile_x": tx.cast("long"), "tile_y": ty.cast("long"), "x": px, "y": py})
    most = F.lit(2**zoom - 1)
    local = {a: F.round((F.col(a) - F.col(f"tile_{a}")) * extent).cast("long") for a in "xy"}
    return held.filter(F.col("tile_x").between(F.lit(0), most) & F.col("tile_y").between(F.lit(0), most)).withColumns(local)


def unit_attributes(live: DataFrame) -> DataFrame:
    """pu, ward, lga, state, status_int, leader, leader_share of live units; leader: most votes, then name; its share of all votes, 4 places."""
    entries = F.map_entries("votes")
    top = F.array_max(F.map_values("votes"))
    leader = F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"]))
    whole = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, v: a + v)
    return live.select("pu", "ward", "lga", "state", status_code().alias("status_int"), F.when(whole > 0, leader).alias("leader"), F.when(whole > 0, F.round(top / whole, 4)).alias("leader_share"))


def region_attributes(regions: DataFrame, level: str, extra: Sequence[str] = ()) -> DataFrame:
    """code, its counts and, for states, party_totals_json, of region rows (code, total_pus, status counts, party_totals)."""
    counts = (F.col("total_pus").alias("pu_count"), (F.col("total_pus") - F.col("no_data")).alias("units_reporting"), *(F.col(s).alias(f"units_{s}") for s in ("consensus", "discrepancy", "inec_conflict")))
    totals = [F.coalesce(F.to_json("party_totals"), F.lit("{}")).alias("party_totals_json")] if level == "state" else []
    return regions.select("code", *extra, *counts, *totals)
