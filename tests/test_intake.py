"""Files, rosters, feed entries and the reconciliation of names on small cases."""

import json

from pyspark.sql import functions as F

from ballotlake.operators import divergence, intake, reconcile
from ballotlake.sources import files

FEATURE = "source_id string, state_code string, state string, lga string, ward string, alt string"
REGISTER = "state_code string, state string, lga string, ward_code string, ward string"


def test_reconcile_reasons(spark):
    register = spark.createDataFrame(
        [("LA", "Lagos", "Maiduguri M. C.", "w1", "Onigbongbo"), ("LA", "Lagos", "Ikeja", "w2", "Alausa"), ("LA", "Lagos", "Ikeja", "w3", "Oke-Ira"), ("OG", "Ogun", "Egbado North", "w4", "Ayetoro I"), ("BO", "Borno", "Kala Balge", "w5", "Rann"), ("BO", "Borno", "Kala Balge", "w6", "Rann Ward")],
        REGISTER,
    )
    features = spark.createDataFrame(
        [
            ("a", "la", None, "IKEJA", "Alausa ward", None), ("b", None, "Lagos", "Ikeja", "nothing", "x, Oke Irá"), ("c", "LA", None, "Maiduguri", "Onigbomgbo", None), ("d", "OG", None, "Yewa North", "Ayetoro I", None),
            ("e", "BR", None, "Kala/Balge", "Rann", None), ("f", "LA", None, "Abuja", "Alausa", None), ("g", "LA", None, "", "", None), ("h", "LA", None, "Ikeja", None, None), (None, "LA", None, "Ikeja", "Alausa", None), ("z", None, None, None, None, None), ("a", "la", None, "IKEJA", "Alausa ward", None),
        ],
        FEATURE,
    )
    overrides = spark.createDataFrame([("f", "w3"), ("a", "gone")], "source_id string, ward_code string")
    got = {r.source_id: (r.ward_code, r.confidence, r.reason) for r in reconcile.reconcile(features, register, overrides).collect()}
    assert got == {
        "a": ("w2", 1.0, "exact"), "b": ("w3", 1.0, "exact"), "c": ("w1", 0.765, "fuzzy"), "d": ("w4", 1.0, "exact"), "e": (None, 0.0, "ambiguous"),
        "f": ("w3", 1.0, "override"), "g": (None, 0.0, "no_lga"), "h": (None, 0.0, "no_ward"), "|Ikeja|Alausa": ("w2", 1.0, "exact"), "z": (None, 0.0, "no_lga"),
    }
    assert reconcile.reconcile(features.limit(0), register, overrides).count() == 0
    assert {r.reason for r in reconcile.reconcile(features, register.limit(0), overrides).collect()} == {"no_lga"}


def test_load_actions(spark):
    rows = spark.createDataFrame([("w", 0.9, True), ("w", 0.79, True), (None, 0.9, True), ("w", 0.8, None)], "code string, x double, polygon boolean")
    assert [r[0] for r in rows.select(reconcile.load_action(F.col("code"), F.col("x"), F.col("polygon"))).collect()] == ["loaded", "skipped_low_confidence", "skipped_no_match", "skipped_bad_geom"]


def test_roster_and_its_application(spark):
    rows = spark.createDataFrame(
        [(2, "A", "0803 123 4567", "u1", None), (3, "", "0", "u1", "en"), (4, "B", "+2348031234567", "u1", "EN"), (5, "C", "07011112222", "", "en"), (6, "D", "07011112222", "u1", "xx"), (7, "E", "123", "u1", "yo"), (8, "F", "2347011112222", "u9", "ha"), (9, None, None, None, None)],
        "line int, name string, phone string, pu_code string, language string",
    )
    read = intake.roster(rows, ("en", "ha", "yo"))
    assert {r.line: r.error for r in read.collect()} == {2: None, 3: "name is empty", 4: "phone is duplicated", 5: "pu_code is empty", 6: "language is unknown", 7: "phone is invalid", 8: None, 9: "name is empty"}
    agents = spark.createDataFrame([("+2348031234567",)], "phone string")
    units = spark.createDataFrame([("u1",)], "pu_code string")
    assert {tuple(r) for r in intake.apply_roster(read, agents, units).collect()} == {("+2348031234567", "u1", "skipped"), ("+2347011112222", "u9", "unknown_unit")}


def test_feed_entries(spark):
    kind = "pu_code string, document struct<url string, size long>, result_updated_time long, updated_at string, is_zero_pu boolean, state string"
    rows = spark.createDataFrame([("01/02", ("u", 5), 1000, "later", None, "s"), ("01/03", ("v", None), None, "then", True, None), ("01/04", None, 1, None, None, None), (None, ("w", 1), 1, None, None, None)], kind)
    assert {tuple(r) for r in intake.feed(rows).collect()} == {("01/02", "u", 5, "1970-01-01T00:00:01.000Z", False, "s"), ("01/03", "v", None, "then", True, None)}


def test_files(spark, tmp_path):
    unit = {"pu_id": "1", "pu_code": "01-01", "pu_name": "School, \"old\"\nhall", "delim": "a/b"}
    (tmp_path / "state.json").write_text(json.dumps({"state_id": "s", "state_name": "S", "lgas": [{"lga_id": "l", "lga_name": "L", "wards": [{"ward_id": "w", "ward_name": "W", "polling_units": [unit, unit | {"pu_id": "2"}]}, {"ward_id": "x", "polling_units": []}]}]}, indent=1))
    roster = files.roster_json(spark, str(tmp_path / "state.json"))
    assert {(r.state_id, r.lga_id, r.ward_id, r.pu_id) for r in roster.collect()} == {("s", "l", "w", "1"), ("s", "l", "w", "2")}
    files.write_csv(roster.select("pu_id", F.col("pu_name").alias(" PU_Name")), str(tmp_path / "out"))
    back = files.csv_table(spark, str(tmp_path / "out"))
    assert back.columns == ["pu_id", "pu_name"] and {tuple(r) for r in back.collect()} == {("1", unit["pu_name"]), ("2", unit["pu_name"])}
    feature = {"type": "Feature", "properties": {"ADM2_EN": " ", "lga": "L"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    (got,) = files.geojson(spark, str(tmp_path / "g.json")).select("geometry_type", "coordinates", files.first_property(F.col("properties"), "ADM2_EN", "none", "lga").alias("name")).collect()
    assert (got.geometry_type, json.loads(got.coordinates), got.name) == ("Polygon", [[[1, 2], [3, 4]]], "L")
    keyed = spark.createDataFrame([('{"10": "c", "2": "b", "0": "a", "x": "d"}',)], "t string")
    assert keyed.select(files.numbered(F.col("t"))).first()[0] == ["a", "b", "c", "d"]


def test_tiers_and_empty_dashboard(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 30.0, 50.0, 75.0, 90.0)], "x double")
    assert [r[0] for r in rows.select(divergence.tier(F.col("x"))).collect()] == ["insufficient", "early", "significant", "strong", "verified"]
    none = spark.createDataFrame([], "party string, n long")
    assert divergence.dashboard(none, 10).count() == 0
    (zero,) = divergence.dashboard(spark.createDataFrame([("A", 0)], "party string, n long"), 10).collect()
    assert tuple(zero) == ("A", 0, 0.0, 0)
