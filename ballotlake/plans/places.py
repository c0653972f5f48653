"""The registered queries of areas, tiles and boundary loads, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile, rollups, spatial, tiles
from ..sources import files, fixture
from ..sources.current import Current, scratch
from .catalog import _PLACE, _live, _places, query

#: Corners of a slanted area and of the hole in it, from the lower left corner of its square of ten degrees.
OUTER, HOLE = ((0, 0), (12, 1), (11, 12), (-1, 11), (0, 0)), ((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))


def _corner(k) -> tuple:
    return k % 5 * 10, F.floor(k / 5) * 10


def _ring(x, y, points, names=("lng", "lat")):
    return F.array(*(F.struct((x + px).cast("double").alias(names[0]), (y + py).cast("double").alias(names[1])) for px, py in points))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted area with a hole for each nation; neighbours overlap, so that the first by order counts."""
    k = F.col("n_nationkey")
    x, y = _corner(k)
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("area"), k.cast("long").alias("at"), F.array(F.array(_ring(x, y, OUTER), _ring(x, y, HOLE))).alias("polygons"))


def _edges_sql(points) -> str:
    return "[" + ", ".join(f"{{'xa': x0 + {a[0]}, 'ya': y0 + {a[1]}, 'xb': x0 + {b[0]}, 'yb': y0 + {b[1]}}}" for a, b in zip(points, points[1:])) + "]"


_INSIDE = "len(list_filter({0}, lambda e: ((e.ya > lat) <> (e.yb > lat)) AND lng < (e.xb - e.xa) * (lat - e.ya) / (e.yb - e.ya) + e.xa)) % 2 = 1"
_POINT = "(c_custkey * 37 % 6000)::DOUBLE / 100 + 0.005 lng, (c_custkey * 53 % 6000)::DOUBLE / 100 + 0.005 lat"
_AREA_SQL = f"areas AS (SELECT n_nationkey k, n_name area, {_edges_sql(OUTER)} outer_, {_edges_sql(HOLE)} hole_ FROM (SELECT *, (n_nationkey % 5 * 10)::DOUBLE x0, (n_nationkey // 5 * 10)::DOUBLE y0 FROM nation))"


@query("D15_area_of_point", f"""WITH {_AREA_SQL}, p AS (SELECT c_custkey, {_POINT} FROM customer)
  SELECT c_custkey, area FROM p LEFT JOIN (SELECT c_custkey, arg_min(area, k) area FROM p, areas WHERE {_INSIDE.format("outer_")} AND NOT ({_INSIDE.format("hole_")}) GROUP BY 1) USING (c_custkey)""", False)
def _(spark, sf_dir):
    return spatial.locate(_points(spark, sf_dir), _areas(spark, sf_dir), "c_custkey", 5.0).select("c_custkey", "area")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda m: (k * m % 6000).cast("double") / 100 + 0.005
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", at(37).alias("lng"), at(53).alias("lat"))


@query("A12_osm_wards", f"""WITH {_AREA_SQL}, p AS (SELECT *, {_POINT} FROM customer WHERE c_custkey % 19 <> 0)
  SELECT 'OSM-' || c_custkey wardcode, c_name wardname, CASE WHEN c_custkey % 7 = 0 THEN 'said' ELSE coalesce(area, '') END lganame, 2::BIGINT polygons
  FROM p LEFT JOIN (SELECT c_custkey, arg_min(area, k) area FROM p, areas WHERE {_INSIDE.format("outer_")} AND NOT ({_INSIDE.format("hole_")}) GROUP BY 1) USING (c_custkey)""", False)
def _(spark, sf_dir):
    """Map relations, written as JSON and read back: areas of level 6 for nations, and small wards of level 8, whose ring is open, for customers."""
    member = lambda role, ring, kind="way": F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), ring.alias("geometry"))
    k = F.col("n_nationkey")
    x, y = _corner(k)
    lonlat = ("lon", "lat")
    relation = lambda id_, tags, *members: F.to_json(F.struct(F.array(F.struct(F.lit("relation").alias("type"), id_.cast("long").alias("id"), tags.alias("tags"), F.array(*members).alias("members"))).alias("elements"))).alias("value")
    tag = lambda level, name, said=None: F.map_filter(F.create_map(F.lit("admin_level"), F.lit(level), F.lit("name"), name, F.lit("is_in:county"), said if said is not None else F.lit(None).cast("string")), lambda _, v: v.isNotNull())
    areas = spark.read.parquet(f"{sf_dir}/nation.parquet").select(relation(k, tag("6", F.col("n_name")), member("outer", _ring(x, y, OUTER, lonlat)), member("inner", _ring(x, y, HOLE, lonlat)), member("admin_centre", _ring(x, y, HOLE[:1], lonlat), "node")))
    c = F.col("c_custkey")
    square = lambda s: _ring(F.col("lng"), F.col("lat"), ((-s, -s), (s, -s), (s, s), (-s, s)), lonlat)
    wards = _points(spark, sf_dir).select(relation(c, tag("8", F.when(c % 19 != 0, F.col("c_name")), F.when(c % 7 == 0, "said")), member("outer", square(0.5)), member("", square(0.25)), member("outer", F.slice(square(1), 1, 3))))
    path = scratch(spark, "osm")
    areas.unionByName(wards).write.text(path)
    elements = files.osm(spark, path, lines=True).withColumn("at", F.col("id"))
    return spatial.wards_of(elements, 5.0).select("wardcode", "wardname", "lganame", F.size("polygons").cast("long").alias("polygons"))


@query("L11_tile_rings")
def _(spark, sf_dir):
    """Rings of all wards and areas, cut and quantised to the tiles of two zooms; tests hold them against a plain version."""
    square = lambda s: _ring(F.col("lng"), F.col("lat"), ((-s, -s), (s, -s), (s, s), (-s, s), (-s, -s)))
    wards = _points(spark, sf_dir).select(F.col("c_name").alias("name"), F.array(square(0.5), square(0.125)).alias("rings"))
    areas = _areas(spark, sf_dir).select(F.col("area").alias("name"), F.col("polygons")[0].alias("rings"))
    found = [tiles.ring_features(rows, zoom).withColumn("zoom", F.lit(zoom)) for rows, zoom in ((areas, 5), (wards, 9))]
    text = F.transform("rings", lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","))
    return found[0].unionByName(found[1]).select("zoom", "tile_x", "tile_y", "name", F.array_join(text, ";").alias("rings"))


_LOCAL = "round(({0} - floor({0})) * 4096)::BIGINT"
_PX, _PY = "((lng + 180) / 360 * 1024)", "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)"


@query("L13_unit_features", f"""SELECT pu, ward, lga, state, floor({_PX})::BIGINT tile_x, floor({_PY})::BIGINT tile_y, {_LOCAL.format(_PX)} x, {_LOCAL.format(_PY)} y,
  (list_position(['no_data', 'single_source', 'inec_published', 'consensus', 'discrepancy', 'inec_confirmed', 'inec_conflict'], status) - 1)::BIGINT status_int,
  CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' WHEN c > b THEN 'C' END leader, round(greatest(a, CASE WHEN a IS NOT NULL THEN b END, CASE WHEN a IS NOT NULL THEN c END)::DOUBLE / valid, 4) leader_share
  FROM {_PLACE} JOIN (SELECT pu, ward, lga, state, status, a, CASE WHEN a IS NOT NULL THEN b END b, CASE WHEN a IS NOT NULL THEN c END c, valid FROM live) USING (pu)""")
def _(spark, sf_dir):
    """Units as points of their tile at zoom 10, with status, leader and its share."""
    units = tiles.unit_attributes(_live(spark, sf_dir)).join(_places(spark, sf_dir), "pu")
    return tiles.point_features(units, 10).drop("lng", "lat")


_DIMENSION = {
    "state": ("SELECT r_regionkey::VARCHAR code, r_name AS name, NULL parent_code, r_regionkey::VARCHAR state_code FROM region", "state"),
    "lga": ("SELECT n_nationkey::VARCHAR code, n_name AS name, n_regionkey::VARCHAR parent_code, n_regionkey::VARCHAR state_code FROM nation", "lga"),
    "ward": ("SELECT concat(n_nationkey, '-', s) code, s AS name, n_nationkey::VARCHAR parent_code, n_regionkey::VARCHAR state_code FROM nation, (SELECT DISTINCT c_mktsegment s FROM customer UNION SELECT 'NOBODY') seg", "ward"),
}


def _dimension(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """code, name, parent_code, state_code of all places of a level; every local government has a ward without units."""
    if level == "state":
        return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_code"), F.col("r_regionkey").cast("string").alias("state_code"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    state, lga = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    if level == "lga":
        return nation.select(lga.alias("code"), F.col("n_name").alias("name"), state.alias("parent_code"), state.alias("state_code"))
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct().agg(F.array_append(F.collect_set("c_mktsegment"), F.lit("NOBODY")).alias("names"))  # a handful
    rows = nation.join(F.broadcast(segments), F.lit(True)).select(lga.alias("lga"), state.alias("state_code"), F.explode("names").alias("name"))
    return rows.select(F.concat_ws("-", "lga", "name").alias("code"), "name", F.col("lga").alias("parent_code"), "state_code")


def _regions(level: str) -> None:
    dimension, column = _DIMENSION[level]
    count = ", ".join(f"count(*) FILTER (status = '{s}') units_{s}" for s in rollups.STATUSES[1:])
    zero = ", ".join(f"coalesce(units_{s}, 0)::BIGINT units_{s}" for s in rollups.STATUSES[1:])

    @query(f"E3_{level}_rows", f""", dim AS ({dimension}), here AS (SELECT * FROM live JOIN (SELECT pu, lat, lng FROM {_PLACE}) USING (pu)),
  bucket AS (SELECT {column}::VARCHAR code, count(*) pu_count, count(*) FILTER (status <> 'no_data') units_reporting, {count}, round(avg(lng), 6) centroid_lng, round(avg(lat), 6) centroid_lat FROM here GROUP BY 1),
  p AS (SELECT {column}::VARCHAR code, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY 1, 2),
  lead AS (SELECT code, arg_min(party, (-n, party)) leader_party, CASE WHEN sum(n) > 0 THEN round(max(n)::DOUBLE / sum(n), 4) END leader_share, concat('{{', string_agg(concat('"', party, '":', n), ',' ORDER BY party), '}}') party_totals_json FROM p GROUP BY 1)
  SELECT '{level}' "level", code, name, parent_code, state_code, coalesce(pu_count, 0)::BIGINT pu_count, coalesce(units_reporting, 0)::BIGINT units_reporting, {zero}, centroid_lng, centroid_lat, leader_party, leader_share, coalesce(party_totals_json, '{{}}') party_totals_json
  FROM dim LEFT JOIN bucket USING (code) LEFT JOIN lead USING (code)""")
    def _(spark, sf_dir):
        """Also D4: every place of the dimension has a row, without units too; and the attributes of its tile feature."""
        live = _live(spark, sf_dir).join(_places(spark, sf_dir), "pu")
        rows = rollups.region_rows(_dimension(spark, sf_dir, level), live, level)
        return rows.withColumns({c: F.round(c, 6) for c in ("centroid_lng", "centroid_lat")})


for _level in _DIMENSION:
    _regions(_level)


@query("D13_boundary_or_point", f""", dim AS ({_DIMENSION["lga"][0]}) SELECT code, CASE WHEN code::INT % 3 = 0 THEN 'polygon' WHEN c.lga IS NOT NULL THEN 'point' END geometry, CASE WHEN code::INT % 3 <> 0 THEN lng END lng FROM dim LEFT JOIN (SELECT lga, round(avg(lng), 6) lng FROM {_PLACE} JOIN (SELECT pu, lga FROM units) USING (pu) GROUP BY 1) c ON c.lga = code::INT""")
def _(spark, sf_dir):
    """A place's boundary, or where it has none the centroid of its units."""
    units = fixture.units(spark, sf_dir).join(_places(spark, sf_dir), "pu")
    points = units.groupBy(F.col("lga").cast("string").alias("code")).agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    boundaries = _areas(spark, sf_dir).filter("at % 3 = 0").select(F.col("at").cast("string").alias("code"), "polygons")
    rows = spatial.placed(_dimension(spark, sf_dir, "lga"), boundaries, points)
    return rows.select("code", "geometry", F.round("point.lng", 6).alias("lng"))


_LOAD = """SELECT c_custkey k, CASE WHEN c_custkey % 5 <> 0 THEN concat('W', c_custkey % 700) END ward_code, (c_custkey % 10)::DOUBLE / 10 + 0.05 confidence, CASE c_custkey % 4 WHEN 0 THEN 'MultiPolygon' WHEN 3 THEN 'Point' ELSE 'Polygon' END kind FROM customer"""
_ACTION = f"SELECT *, CASE WHEN ward_code IS NULL THEN 'skipped_no_match' WHEN confidence < 0.8 THEN 'skipped_low_confidence' WHEN kind = 'Point' THEN 'skipped_bad_geom' ELSE 'loaded' END action FROM ({_LOAD})"


def _load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    k = F.col("c_custkey")
    ring = _ring(F.lit(0.0), F.lit(0.0), ((0, 0), (1, 0), (1, 1), (0, 0)))
    kind = F.when(k % 4 == 0, "MultiPolygon").when(k % 4 == 3, "Point").otherwise("Polygon")
    matches = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("long").alias("at"), k.cast("string").alias("source_id"), F.when(k % 5 != 0, F.concat(F.lit("W"), (k % 700).cast("string"))).alias("ward_code"), ((k % 10).cast("double") / 10 + 0.05).alias("confidence"), F.lit("exact").alias("reason"),
        kind.alias("kind"), F.when(kind == "Polygon", F.array(ring)).alias("polygon"), F.when(kind == "MultiPolygon", F.array(F.array(ring), F.array(ring))).alias("polygons"),
    )
    table = Current(spark, scratch(spark, "boundaries"), ["ward_code"], 8)
    report = scratch(spark, "load-report")
    counts = reconcile.load(matches, table, report)
    return table.read().withColumn("counted", F.lit(counts["loaded"])), counts


@query("B12_boundaries", f"SELECT ward_code, arg_max(k, k)::VARCHAR source_id, arg_max(confidence, k) confidence, arg_max(CASE WHEN kind = 'Polygon' THEN 1 ELSE 2 END, k)::BIGINT polygons, (SELECT count(*) FROM ({_ACTION}) WHERE action = 'loaded')::BIGINT counted FROM ({_ACTION}) WHERE action = 'loaded' GROUP BY 1", False)
def _(spark, sf_dir):
    """Also J9 and L7: the boundaries that a load leaves, the last of a ward, with the load's own count."""
    rows, _counts = _load(spark, sf_dir)
    return rows.select("ward_code", "source_id", "confidence", F.size("polygons").cast("long").alias("polygons"), F.col("counted").cast("long").alias("counted"))
