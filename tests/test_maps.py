"""Tiles as bytes, symbols, places that a map steps through, coverage and spread, files that are refused."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ballotlake.operators import access, mvt, registers, rollups, spatial
from ballotlake.operators.consensus import consensus
from ballotlake.sources import files

RING = "array<struct<x long, y long>>"


def rings_of(commands):
    """Plain reader of a polygon's commands: open rings of absolute points."""
    out, at, i = [], [0, 0], 0
    while i < len(commands):
        kind, n = commands[i] & 7, commands[i] >> 3
        i += 1
        if kind == 7:
            continue
        for _ in range(n):
            for axis in (0, 1):
                v = commands[i + axis]
                at[axis] += -(v + 1 >> 1) if v & 1 else v >> 1
            i += 2
            if kind == 1:
                out.append([])
            out[-1].append(tuple(at))
    return out


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def closed(*points):
    return [Row(x=x, y=y) for x, y in (*points, points[0])]


def test_rings_as_commands(spark):
    outer, hole, flat = closed((0, 0), (0, 10), (10, 10), (10, 0)), closed((2, 2), (2, 4), (4, 4), (4, 2)), closed((1, 1), (5, 5), (3, 3))
    rows = spark.createDataFrame([(1, [outer, hole]), (2, [outer[::-1], flat, hole[::-1]]), (3, [flat, hole])], f"k int, rings array<{RING}>")
    found = {r.k: rings_of(r.geometry) for r in mvt.with_ring_commands(rows).collect()}
    assert set(found) == {1, 2}
    for rings in found.values():
        assert [area(r) for r in rings] == [100, -4]
        assert {frozenset(r) for r in rings} == {frozenset((p.x, p.y) for p in r) for r in (outer, hole)}


def test_a_known_polygon(spark):
    """The example of the format's own text."""
    rows = spark.createDataFrame([([closed((3, 6), (8, 12), (20, 34))],)], f"rings array<{RING}>")
    assert mvt.with_ring_commands(rows).first().geometry == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    point = spark.range(1).select(mvt.point_commands(F.lit(25), F.lit(17)).alias("g")).select("g", *(c.alias(a) for a, c in zip("xy", mvt.point_of(F.col("g"))))).first()
    assert (point.g, point.x, point.y) == ([9, 50, 34], 25, 17)


def test_tiles_are_read_back(spark):
    told = "struct<name string, n long, share double, ok boolean>"
    rows = [
        (1, 2, "a", "point", [9, 1, 300], ("ïx", -5, 0.25, True)), (1, 2, "a", "point", [9, 1, 300], ("ïx", -5, 0.25, True)), (1, 2, "b", "polygon", [9, 6, 12, 18, 10, 12, 24, 44, 15], (None, 2**40, None, False)),
        (3, 4, "a", "point", [9, 0, 0], (None, None, None, None)), (5, 6, "a", "point", None, ("lost", 1, 1.0, True)), (5, 6, None, "point", [9, 0, 0], ("lost", 1, 1.0, True)),
    ]
    features = spark.createDataFrame(rows, f"tile_x long, tile_y long, layer string, kind string, geometry array<long>, attributes {told}")
    tiles = mvt.tile_bytes(features)
    assert {(r.tile_x, r.tile_y): bytes(r.tile) for r in tiles.collect()} == {(r.tile_x, r.tile_y): bytes(r.tile) for r in mvt.tile_bytes(features.repartition(3, "kind")).collect()}
    back = [(r.tile_x, r.tile_y, r.layer, r.kind, r.geometry, json.loads(r.attributes)) for r in mvt.read_tiles(tiles).collect()]
    want = [(*r[:5], {k: v for k, v in zip(("name", "n", "share", "ok"), r[5]) if v is not None}) for r in rows[:4]]
    assert sorted(back, key=str) == sorted(want, key=str)
    assert mvt.tile_bytes(features.limit(0)).count() == 0 and mvt.read_tiles(tiles.withColumn("tile", F.lit(b""))).count() == 0


def test_a_tile_byte_by_byte(spark):
    rows = spark.createDataFrame([(0, 0, "p", "point", [9, 50, 34], ("v",))], "tile_x long, tile_y long, layer string, kind string, geometry array<long>, attributes struct<k string>")
    feature = bytes([0x12, 11, 0x12, 2, 0, 0, 0x18, 1, 0x22, 3, 9, 50, 34])
    layer = bytes([0x78, 2, 0x0A, 1]) + b"p" + feature + bytes([0x1A, 1]) + b"k" + bytes([0x22, 3, 0x0A, 1]) + b"v" + bytes([0x28, 0x80, 0x20])
    assert bytes(mvt.tile_bytes(rows).first().tile) == bytes([0x1A, len(layer)]) + layer


def test_symbols(spark):
    schema = "level string, code string, pu_count long, units_reporting long, units_consensus long, units_inec_confirmed long, units_inec_conflict long, units_discrepancy long"
    rows = [("lga", "a", 100, 90, 50, 35, 0, 0), ("lga", "b", 25, 20, 13, 0, 0, 1), ("lga", "c", 4, 2, 1, 0, 1, 1), ("ward", "d", 4, 2, 0, 0, 0, 0), ("ward", "e", 4, 1, 0, 0, 0, 0), ("ward", "f", 0, 0, 0, 0, 0, 0)]
    found = {r.code: tuple(r)[1:] for r in rollups.symbols(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": (28.0, "most_verified", "plain"), "b": (16.5, "half_verified", "discrepancy"), "c": (pytest.approx(9.6), "some_verified", "conflict"), "d": (pytest.approx(9.6), "half_reporting", "plain"), "e": (pytest.approx(9.6), "some_reporting", "plain"), "f": (5.0, "none", "plain")}
    wards = spark.createDataFrame(rows[3:], schema)
    assert {r.code: r.radius for r in rollups.symbols(wards).collect()} == {"d": 18.0, "e": 18.0, "f": 5.0}
    assert [r.radius for r in rollups.symbols(spark.createDataFrame(rows[5:], schema)).collect()] == [5.0]


def test_steps_of_a_map(spark):
    rows = spark.createDataFrame([("state", "S", None), ("state", "T", None), ("lga", "S1", "S"), ("ward", "S1a", "S1"), ("ward", "S1b", "S1")], "level string, code string, parent_code string")
    assert {tuple(r) for r in access.focus(rows).collect()} == {
        ("country", None, "state", 2, "country", None), ("state", "S", "lga", 1, "country", None), ("state", "T", "lga", 0, "country", None),
        ("lga", "S1", "ward", 2, "state", "S"), ("ward", "S1a", None, 0, "lga", "S1"), ("ward", "S1b", None, 0, "lga", "S1"),
    }


LIVE = "state string, status string, votes map<string,long>"


def test_coverage_and_spread(spark):
    live = spark.createDataFrame([("1", "consensus", {"A": 60, "B": 20}), ("1", "single_source", {"A": 7}), ("1", "no_data", None), ("1", "no_data", None), ("2", "no_data", None), ("3", "inec_confirmed", {"B": 200, "A": 10})], LIVE)
    found = {r.code: tuple(r)[1:] for r in rollups.coverage(live, "state").collect()}
    assert found == {"1": (50.0, 50.0, 25.0, "partial", 80, 87), "2": (0.0, 0.0, 0.0, "low", 0, 0), "3": (100.0, 100.0, 100.0, "full", 210, 210)}
    assert {tuple(r) for r in rollups.spread(live, least=2).collect()} == {("A", 1, 70, False, False), ("B", 2, 220, True, True)}
    assert not any(r.wins for r in rollups.spread(live).collect())


def test_sums_and_exports(spark):
    regions = spark.createDataFrame([("a", 2), ("b", 3)], "code string, n long")
    assert {tuple(r) for r in rollups.with_sum(regions, ["n"]).collect()} == {("a", 2), ("b", 3), ("_sum", 5)}
    assert [tuple(r) for r in rollups.with_sum(regions.limit(0), ["n"]).collect()] == [("_sum", 0)]
    schema = "state string, lga string, ward string, pu long, name string, election string, status string, submission_count long, source_count long, votes map<string,long>, registered_voters long, accredited long, valid long, rejected long, cast long, computed_at string"
    unit = lambda pu, state, votes, valid: (state, "l", "w", pu, 'a "b", c', "e", "consensus", 2, 2, votes, 9, 8, valid, 1, 8, "t")
    live = spark.createDataFrame([unit(1, "S", {"A": 2, "B": 1}, 3), unit(2, "T", {"A": 0}, 0), unit(3, "T", None, None)], schema)
    rows = rollups.export_rows(live)
    assert len(rows.columns) == 19 and {(r.pu_code, r.party, r.leader_share, r.total_valid_votes) for r in rows.collect()} == {(1, "A", 0.6667, 3), (1, "B", 0.3333, 3), (2, "A", None, 0)}
    assert {r.pu_code for r in rollups.export_rows(live, state="T").collect()} == {2} and {r.pu_code for r in rollups.export_rows(live, after=1).collect()} == {2}


def test_elections_to_read(spark):
    rows = spark.createDataFrame([("1", "gov", "2023-12-31 23:30:00", "Edo"), ("2", None, "2023-05-01 00:00:00", "Edo"), ("3", "Sen", "2024-01-01 00:00:00", None)], "election string, type string, date string, state string")
    ids = lambda **asked: {r.election for r in registers.elections_to_read(rows, **asked).collect()}
    assert ids() == {"1", "2", "3"} and ids(types=("GOV", "SEN")) == {"1", "3"} and ids(year=2023) == {"1", "2"} and ids(state="EDO", types=("GOV",)) == {"1"} and ids(election="3") == {"3"}


def test_outcomes_and_severity(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, ""), (3, False, "no_votes"), (4, False, None), (5, True, "ignored")], "at int, ok boolean, reason string")
    assert {tuple(r) for r in registers.outcomes(rows, ["at"], "at").collect()} == {("parsed", 2, 1), ("unknown_failure", 2, 2), ("no_votes", 1, 3)}
    hits = spark.createDataFrame([(1,), (3,), (5,), (None,)], "severity int")
    assert [r.severity for r in registers.severity_range(hits, 2).collect()] == [3, 5] and [r.severity for r in registers.severity_range(hits, most=3).collect()] == [1, 3]


def test_only_extracted_forms_count(spark):
    schema = "id long, election string, pu long, submitted_at long, source_type string, party string, approved boolean, processing_status string, votes map<string,long>, valid long"
    rows = [(1, "e", 1, 1, "party_agent", "P", True, "extracted", {"A": 5}, 5), (2, "e", 1, 2, "observer", None, True, "queued", {"A": 6}, 6), (3, "e", 1, 3, "observer", None, True, "extracted", {"A": 5}, 5), (4, "e", 1, 4, "observer", None, True, None, {"A": 9}, 9)]
    found = consensus(spark.createDataFrame(rows, schema)).first()
    assert (found.status, found.submission_count, found.votes) == ("consensus", 2, {"A": 5})


def test_collections(spark):
    rows = spark.createDataFrame([("l", "b", ("Point", [1.0, 2.0])), ("l", "a", None), ("m", None, None)], "lga string, ward string, geometry struct<type string, coordinates array<double>>")
    found = {r.lga: json.loads(r.collection) for r in spatial.geojson_collections(spatial.geojson_features(rows, ["ward"], ["lga"]), ["lga"]).collect()}
    assert [f["properties"]["ward"] for f in found["l"]["features"]] == ["a", "b"] and found["l"]["features"][0]["geometry"] is None and found["m"]["features"][0]["properties"] == {"ward": None}


def test_files_that_are_refused_or_corrected(spark, tmp_path):
    (tmp_path / "wrong.json").write_text(json.dumps({"type": "Feature", "features": []}))
    with pytest.raises(Exception, match="FeatureCollection"):
        files.geojson(spark, str(tmp_path / "wrong.json")).collect()
    (tmp_path / "roster.csv").write_text("Name, PHONE \nx,1\n")
    with pytest.raises(ValueError, match="pu_code"):
        files.roster_csv(spark, str(tmp_path / "roster.csv"))
    (tmp_path / "good.csv").write_text("PU_CODE,Name,Phone,more\n01, x ,1,\n")
    assert files.roster_csv(spark, str(tmp_path / "good.csv")).first().name == "x"
    (tmp_path / "overrides.csv").write_text('source_ward_id,inec_ward_code\n a ,W1\nb,\n,W2\na,W3\nc," W4"\n')
    assert {tuple(r) for r in files.overrides_csv(spark, str(tmp_path / "overrides.csv")).collect()} == {("a", "W3"), ("c", "W4")}
    props = spark.createDataFrame([({"z": "x", "k": "12", "n": "Ward"},), ({"z": ""},)], "p map<string,string>")
    assert {tuple(r) for r in props.select(files.first_number(F.col("p")), files.first_name(F.col("p"))).collect()} == {("12", "Ward"), (None, None)}
