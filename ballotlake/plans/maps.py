"""The registered queries of map tiles, symbols, places that a map steps through, and exports, and the SQL that each must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, mvt, rollups, spatial, tiles
from ..sources import fixture
from .catalog import _PLACE, _live, _places, query
from .places import _DIMENSION, _areas, _dimension

#: A zoom for each level that a map shows.
ZOOMS = {"state": 5, "lga": 7, "ward": 9, "pu": 11}
_X, _Y = "((lng + 180) / 360 * 2048)", "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048)"
_LOCAL = "round(({0} - floor({0})) * 4096)::BIGINT"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvt.unit_layer(tiles.unit_attributes(_live(spark, sf_dir)).join(_places(spark, sf_dir), "pu").withColumnRenamed("pu", "pu_code"), ZOOMS["pu"])


def _regions(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """A level's features: every third local government has a boundary, all else is drawn at the centroid of its units."""
    live = _live(spark, sf_dir).join(_places(spark, sf_dir), "pu")
    dimension = _dimension(spark, sf_dir, level)
    regions = rollups.region_rows(dimension, live, level)
    boundaries = _areas(spark, sf_dir).filter(F.lit(level == "lga") & (F.col("at") % 3 == 0)).select(F.col("at").cast("string").alias("code"), "polygons")
    points = regions.filter("centroid_lng is not null").select("code", F.col("centroid_lng").alias("lng"), F.col("centroid_lat").alias("lat"))
    return mvt.region_layer(regions, spatial.placed(dimension, boundaries, points), level, ZOOMS[level])


@query("B14_tile_bytes")
def _(spark, sf_dir):
    """Tiles of all four levels at a zoom of each; bytes have no SQL, so the L12 queries read them back and tests decode them."""
    layers = [_regions(spark, sf_dir, level) for level in ("state", "lga", "ward")] + [_units(spark, sf_dir)]
    rows = [x.select("tile_x", "tile_y", "layer", "kind", "geometry", F.to_json("attributes").alias("attributes"), F.lit(z).alias("zoom")) for x, z in zip(layers, ZOOMS.values())]
    return mvt.tile_bytes(reduce(DataFrame.unionByName, rows), ("zoom", "tile_x", "tile_y"))


@query("L12_unit_tiles", f"""SELECT floor({_X})::BIGINT tile_x, floor({_Y})::BIGINT tile_y, {_LOCAL.format(_X)} x, {_LOCAL.format(_Y)} y, 'polling_units' AS layer, pu pu_code, ward, lga, state,
  (list_position(['no_data', 'single_source', 'inec_published', 'consensus', 'discrepancy', 'inec_confirmed', 'inec_conflict'], status) - 1)::BIGINT status_int,
  CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' WHEN c > b THEN 'C' END leader, CASE WHEN a IS NOT NULL THEN round(greatest(a, b, c)::DOUBLE / valid, 4) END leader_share
  FROM {_PLACE} JOIN (SELECT pu, ward, lga, state, status, a, CASE WHEN a IS NOT NULL THEN b END b, CASE WHEN a IS NOT NULL THEN c END c, valid FROM live) USING (pu)""")
def _(spark, sf_dir):
    """What the tiles of all units say, read back from their bytes."""
    rows = mvt.read_tiles(mvt.tile_bytes(_units(spark, sf_dir)))
    told = F.from_json("attributes", "pu_code long, ward string, lga long, state long, status_int long, leader string, leader_share double")
    x, y = mvt.point_of(F.col("geometry"))
    return rows.select("tile_x", "tile_y", x.alias("x"), y.alias("y"), "layer", told.alias("a")).select("tile_x", "tile_y", "x", "y", "layer", "a.*")


@query("L12_region_tiles", f""", dim AS ({_DIMENSION["lga"][0]}) SELECT code, name, parent_code, state_code, count(pu)::BIGINT pu_count, count(*) FILTER (status <> 'no_data')::BIGINT units_reporting, count(*) FILTER (status = 'consensus')::BIGINT units_consensus,
  count(*) FILTER (status = 'discrepancy')::BIGINT units_discrepancy, count(*) FILTER (status = 'inec_conflict')::BIGINT units_inec_conflict, CASE WHEN code::INT % 3 = 0 THEN 'polygon' ELSE 'point' END kind
  FROM dim LEFT JOIN live ON lga::VARCHAR = code GROUP BY ALL HAVING count(pu) > 0 OR code::INT % 3 = 0""")
def _(spark, sf_dir):
    """What the tiles of local governments say of them, read back from their bytes; an area stands in each tile that it meets."""
    rows = mvt.read_tiles(mvt.tile_bytes(_regions(spark, sf_dir, "lga")))
    told = F.from_json("attributes", "code string, name string, parent_code string, state_code string, " + ", ".join(f"{c} long" for c in mvt.COUNTS))
    return rows.select(told.alias("a"), "kind").select("a.*", "kind").distinct()


_ROWS = """, dim AS ({0}), s AS (SELECT code, count(pu) n, count(*) FILTER (status <> 'no_data') r, count(*) FILTER (status IN ('consensus', 'inec_confirmed')) v, count(*) FILTER (status = 'inec_conflict') x, count(*) FILTER (status = 'discrepancy') d
  FROM dim LEFT JOIN live ON {1}::VARCHAR = code GROUP BY 1)"""


@query("L14_symbols", _ROWS.format(*_DIMENSION["ward"]) + """ SELECT code, round(5 + sqrt(n) / sqrt(max(n) OVER ()) * 13, 6) radius, CASE WHEN n = 0 THEN 'none' WHEN v / n >= 0.85 THEN 'most_verified' WHEN v / n >= 0.5 THEN 'half_verified' WHEN v / n >= 0.2 THEN 'some_verified'
  WHEN r / n >= 0.5 THEN 'half_reporting' WHEN r > 0 THEN 'some_reporting' ELSE 'none' END fill, CASE WHEN x > 0 THEN 'conflict' WHEN d > 0 THEN 'discrepancy' ELSE 'plain' END edge FROM s""")
def _(spark, sf_dir):
    live = _live(spark, sf_dir).join(_places(spark, sf_dir), "pu")
    rows = rollups.symbols(rollups.region_rows(_dimension(spark, sf_dir, "ward"), live, "ward"))
    return rows.withColumn("radius", F.round("radius", 6))


@query("C16_focus", f"""WITH d AS (SELECT 'state' "level", code, parent_code FROM ({_DIMENSION["state"][0]}) UNION ALL SELECT 'lga', code, parent_code FROM ({_DIMENSION["lga"][0]}) UNION ALL SELECT 'ward', code, parent_code FROM ({_DIMENSION["ward"][0]}))
  SELECT 'country' "level", NULL::VARCHAR code, 'state' shows, (SELECT count(*) FROM region)::BIGINT n_shown, 'country' up_level, NULL::VARCHAR up_code
  UNION ALL SELECT "level", code, CASE "level" WHEN 'state' THEN 'lga' WHEN 'lga' THEN 'ward' END, CASE "level" WHEN 'state' THEN (SELECT count(*) FROM nation WHERE n_regionkey::VARCHAR = code) WHEN 'lga' THEN (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer) ELSE 0 END::BIGINT,
    CASE "level" WHEN 'state' THEN 'country' WHEN 'lga' THEN 'state' ELSE 'lga' END, parent_code FROM d""", False)
def _(spark, sf_dir):
    levels = [_dimension(spark, sf_dir, level).select(F.lit(level).alias("level"), "code", "parent_code") for level in ("state", "lga", "ward")]
    return access.focus(reduce(DataFrame.unionByName, levels))


@query("B9_results_csv", """ SELECT state state_code, lga lga_code, ward ward_code, pu pu_code, concat('Unit ', pu) pu_name, 'cur' election_id, status verification_status, submission_count, source_count, party, n votes, round(n::DOUBLE / valid, 4) leader_share,
  (4600 + pu % 400)::BIGINT registered_voters, (300 + pu % 50)::BIGINT accredited_voters, valid::BIGINT total_valid_votes, 12::BIGINT rejected_ballots, "cast"::BIGINT total_votes_cast, '' image_sha256, '2024-01-02T00:00:00Z' computed_at
  FROM votes JOIN (SELECT pu, submission_count, source_count, valid, "cast" FROM live) USING (pu)""")
def _(spark, sf_dir):
    """Also D11: all 19 columns of the export."""
    live = _live(spark, sf_dir).withColumns({"name": F.concat(F.lit("Unit "), F.col("pu").cast("string")), "election": F.lit("cur"), "computed_at": F.lit("2024-01-02T00:00:00Z")})
    return rollups.export_rows(live)


@query("L8_collections", """ SELECT lga, concat('{"type":"FeatureCollection","features":[', string_agg(concat('{"type":"Feature","properties":{"ward":"', ward, '"},"geometry":', CASE WHEN n % 2 = 0 THEN concat('{"type":"Point","coordinates":[', n, ',', lga, ']}') ELSE 'null' END, '}'), ',' ORDER BY ward), ']}') collection
  FROM (SELECT ward, lga, count(*) n FROM units GROUP BY ALL) GROUP BY 1""")
def _(spark, sf_dir):
    """The wards of each local government as one document; a ward without a place keeps a null geometry."""
    wards = fixture.units(spark, sf_dir).groupBy("ward", "lga").agg(F.count("*").alias("n"))
    place = F.when(F.col("n") % 2 == 0, F.struct(F.lit("Point").alias("type"), F.array("n", "lga").alias("coordinates")))
    return spatial.geojson_collections(spatial.geojson_features(wards.withColumn("geometry", place), ["ward"], ["lga"]), ["lga"])
