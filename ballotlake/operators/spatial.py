"""Which area holds a point, and areas from map relations.

An area is an array of polygons, a polygon an array of closed rings (the outer one, then holes), a ring an array of
structs (lng, lat).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from .registers import ring_centroid

#: The tags that name a ward's local government, the first that is not empty counts.
IN_TAGS = ("is_in:district", "is_in:county", "is_in:lga")


def _ends(ring: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(ring, lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def covered(areas: DataFrame, cell: float) -> DataFrame:
    """areas (polygons, any others) with rings, cx, cy: a row for each polygon and grid cell that its bounding box meets.

    A cell should be about as large as a small area: a polygon has as many rows as its box has cells.
    """
    rows = areas.withColumn("rings", F.explode("polygons")).drop("polygons")
    cells = lambda axis: F.explode(F.sequence(*(F.floor(e / cell) for e in _ends(F.get("rings", F.lit(0)), axis))))
    return rows.withColumn("cx", cells("lng")).withColumn("cy", cells("lat"))


def locate(points: DataFrame, areas: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """points (key, lng, lat, any others) with area: the first area (area, at, polygons), by at, that holds each; null if none does.

    Points meet the areas of their own grid cell only, so no pair is made of things that are a cell apart. A cell that
    holds a large share of all points is split by the join as Spark reads it; the first area is a minimum by point, summed
    up where the points are. Points on no valid place (null) are in no area. key tells points apart.
    """
    places = points.select(F.col(key).alias("key_"), F.col("lng").alias("x_"), F.col("lat").alias("y_"))
    at = places.withColumns({"cx": F.floor(F.col("x_") / cell), "cy": F.floor(F.col("y_") / cell)})
    near = at.join(covered(areas.select("area", "at", "polygons"), cell), ["cx", "cy"])
    first = near.filter(in_polygon(F.col("y_"), F.col("x_"), F.col("rings"))).groupBy("key_").agg(F.min_by("area", "at").alias("area"))
    return points.join(first, F.col(key) == F.col("key_"), "left").drop("key_")


def placed(places: DataFrame, boundaries: DataFrame, points: DataFrame) -> DataFrame:
    """places (code, any others) with geometry (polygon, point, or null for none), polygons, and point where there is no polygon.

    boundaries: code, polygons; points: code, lng, lat. Both have a row a place at most.
    """
    rows = places.join(boundaries.select("code", "polygons"), "code", "left").join(points.select("code", F.struct("lng", "lat").alias("point")), "code", "left")
    point = F.when(F.col("polygons").isNull(), F.col("point"))
    return rows.withColumn("point", point).withColumn("geometry", F.when(F.col("polygons").isNotNull(), "polygon").when(F.col("point").isNotNull(), "point"))


def multipolygon(kind: Column, polygon: Column, polygons: Column) -> Column:
    """The polygons of a geometry that is one or several; null for every other kind."""
    return F.when(kind == "MultiPolygon", polygons).when(kind == "Polygon", F.array(polygon))


def polygons_of(members: Column) -> Column:
    """Polygons of a relation's members (type, role, geometry of lat and lon), empty if none has an outer ring.

    Ways of four points and more are rings, closed where they are not; each outer one is a polygon, and all holes
    belong to the first.
    """
    ways = F.filter(members, lambda m: (m["type"] == "way") & (F.size(m["geometry"]) >= 4))
    ring = lambda m: F.transform(m["geometry"], lambda p: F.struct(p["lon"].alias("lng"), p["lat"].alias("lat")))
    closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    of = lambda inner: F.transform(F.filter(ways, lambda m: F.coalesce(m["role"] == "inner", F.lit(False)) == inner), lambda m: closed(ring(m)))
    outers, inners = of(False), of(True)
    return F.coalesce(F.transform(outers, lambda r, i: F.when(i == 0, F.concat(F.array(r), inners)).otherwise(F.array(r))), F.array())


def centroid(polygons: Column) -> Column:
    """Struct x, y: the shoelace centroid of the first polygon's outer ring."""
    outer = F.transform(F.get(F.get(polygons, F.lit(0)), F.lit(0)), lambda p: F.struct(p["lng"].alias("x"), p["lat"].alias("y")))
    return ring_centroid(outer)


def wards_of(elements: DataFrame, cell: float = 1.0) -> DataFrame:
    """wardcode, wardname, lganame, polygons of elements (at, type, id, tags, members): relations of level 8 that have a name and rings.

    A ward's local government is what its tags say, else the first relation of level 6, in the order of the document, that
    holds its centroid, else empty. Areas of level 6 without a name or rings do not count.
    """
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    rows = elements.filter("type = 'relation'").select("at", "id", "tags", tag("admin_level").alias("level"), F.nullif(tag("name"), F.lit("")).alias("name"), polygons_of(F.col("members")).alias("polygons"))
    rows = rows.filter(F.col("name").isNotNull() & (F.size("polygons") > 0))
    lgas = rows.filter("level = '6'").select(F.col("name").alias("area"), "at", "polygons")
    said = F.coalesce(*(F.nullif(tag(t), F.lit("")) for t in IN_TAGS))
    middle = centroid(F.col("polygons"))
    wards = rows.filter("level = '8'").select("at", F.concat(F.lit("OSM-"), F.col("id").cast("string")).alias("wardcode"), F.col("name").alias("wardname"), said.alias("said"), "polygons", middle.alias("c"))
    open_ = wards.filter("said is null and c is not null").select("at", F.col("c.x").alias("lng"), F.col("c.y").alias("lat"))
    found = locate(open_, lgas, "at", cell).select("at", "area")
    return wards.join(found, "at", "left").select("wardcode", "wardname", F.coalesce("said", "area", F.lit("")).alias("lganame"), "polygons")


def geojson_features(rows: DataFrame, properties: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, feature: the GeoJSON text of each row (geometry: a struct of type and coordinates); a missing geometry or property is written as null."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col("geometry"))
    return rows.select(*by, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def geojson_collections(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, collection: one GeoJSON document of the features of each group, in the order of their texts.

    A document is one value: group by what has a bounded number of features, as a local government has of wards.
    """
    held = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return features.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), held, F.lit("]}")).alias("collection"))
