"""Visibility, required columns and files by state on small tables."""

import json

from pyspark.sql import functions as F

from ballotlake.operators import access, rollups
from ballotlake.sources import files


def test_agents_that_a_viewer_sees(spark):
    agents = spark.createDataFrame([("a", "party_agent", "X"), ("b", "party_admin", "X"), ("c", "consortium_reviewer", None), ("d", "party_agent", None), ("e", "party_admin", None)], "id string, role string, party string")
    seen = lambda who: sorted(r.id for r in access.visible_agents(agents, who).collect())
    assert seen("a") == ["a"] and seen("b") == seen("c") == list("abcde") and seen("nobody") == []
    assert sorted((r.admin, r.id) for r in access.party_agents(agents).collect()) == [("b", "a"), ("b", "b")]


def test_missing_columns_are_told_in_order(spark):
    rows = spark.createDataFrame([], "Name string, ` PHONE ` string")
    assert access.missing(rows, "pu_code", "phone", "name", "language") == ["pu_code", "language"]


def roster(state_id, name, units):
    return {"state_id": state_id, "state_name": name, "lgas": [{"lga_id": "1", "lga_name": "L", "wards": [{"ward_id": "w", "ward_name": "W", "polling_units": [{"pu_id": u, "pu_code": u, "pu_name": u, "delim": u} for u in units]}]}]}


def test_rosters_without_files_that_sum_up_others(spark, tmp_path):
    for name, doc in (("abia", roster("AB", "Abia", ["1", "2"])), ("kano", roster("KN", "Kano", ["3"])), ("summary", {"totals": 1}), ("all-polling-units", roster("XX", "All", ["1", "2", "3"])), ("probe-1", roster("YY", "Probe", ["9"]))):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    read = files.roster_json(spark, str(tmp_path))
    assert sorted(r.pu_id for r in files.units_of(read).collect()) == ["1", "2", "3"]
    assert files.units_of(read, "KN").count() == 1 and files.units_of(read, "Abia").count() == 2 and files.units_of(read, "abia").count() == 0


def test_state_files_hold_all_units(spark, tmp_path):
    units = spark.createDataFrame([(1, 1, "w", 1, "a"), (1, 1, "w", 2, "b"), (1, 2, "v", 3, "c"), (2, 5, "u", 4, "d")], "state long, lga long, ward string, pu long, name string")
    counts = {r.state: (r.lgas, r.wards, r.polling_units) for r in files.write_states(units, str(tmp_path)).collect()}
    assert counts == {1: (2, 2, 3), 2: (1, 1, 1), None: (3, 3, 4)}
    back = spark.read.json(f"{tmp_path}/states").select("state", F.explode("polling_units").alias("u"))
    assert sorted((r.state, r.u.pu, r.u["name"]) for r in back.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 4, "d")]


def test_states_without_units_have_no_roll_up_and_units_without_results_count(spark):
    units = spark.createDataFrame([(1, 1), (2, 1)], "pu long, state long")
    results = spark.createDataFrame([("e", 1, "consensus", {"A": 4})], "election string, pu long, status string, votes map<string,long>")
    names = spark.createDataFrame([(1, "One"), (2, "Two")], "state long, name string")
    states = rollups.state_rollup(units, results, names)
    found = {r.election: (r["name"], r.units_reporting, r.units_total, r.units_consensus, r.party_totals) for r in states.collect()}
    assert found == {"e": ("One", 1, 1, 1, '{"A":4}'), None: ("One", 0, 1, 0, None)}
    assert {r.election: r.units_total for r in rollups.national_rollup(states).collect()} == {"e": 1, None: 1}
