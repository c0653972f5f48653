"""Log events, roster loads, pilot verdicts, percentiles and registers on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ballotlake.operators import detail, events, intake, pilot, registers, rollups, validation
from ballotlake.sources.current import Current


def test_a_roster_goes_in_whole_or_not_at_all(spark, tmp_path):
    agents = Current(spark, str(tmp_path / "agents"), ["phone"], 2)
    units = spark.createDataFrame([("u1",), ("u2",)], "pu_code string")
    roster = lambda *rows: spark.createDataFrame([(k, "n", p, u, "en", e) for k, (p, u, e) in enumerate(rows, 2)], "line long, name string, phone string, pu_code string, language string, error string")
    load = lambda rows: intake.load_roster(rows, agents, units, "X", "admin", F.lit("2024-01-01").cast("timestamp"))
    counts, log = load(roster(("1", "u1", None), ("2", "u2", None), ("3", "u9", "phone is invalid")))
    assert counts == {"inserted": 2, "skipped": 0} and {r.phone for r in agents.read().collect()} == {"1", "2"}
    said = {r.entity_id: (r.event_type, r.actor_id, json.loads(r.event_data)) for r in log.collect()}
    assert said["1"] == ("agent.provisioned", "admin", {"party": "X", "pu_code": "u1", "language": "en"})
    with pytest.raises(ValueError, match=r"u7 not in registry \(line 3\)"):
        load(roster(("4", "u1", None), ("5", "u7", None), ("6", "u8", None)))
    assert {r.phone for r in agents.read().collect()} == {"1", "2"}
    counts, log = load(roster(("1", "unknown, but the phone is there", None), ("4", "u1", None)))
    assert counts == {"inserted": 1, "skipped": 1} and log.count() == 1


def test_events_of_one_submission(spark):
    schema = "id long, election string, pu long, image_sha256 string, source_type string, party string, submitted_at timestamp, extracted_at timestamp, confidence double, backend string, arithmetic_ok boolean, retried_at timestamp, previous_error string, started_at timestamp, reviewed_at timestamp, reviewer string, decision string, reason string"
    row = (1, "e", 7, "f" * 64, "observer", None, *[None] * 12)
    rows = spark.createDataFrame([row], schema)
    found = events.of_submissions(rows, F.lit("2024-01-01 10:00:00").cast("timestamp")).collect()
    assert [(r.event_type, json.loads(r.event_data)) for r in found] == [("submission.created", {"election_id": "e", "pu_code": "7", "image_sha256": "f" * 64, "source": "observer", "party": None})]
    stuck = rows.withColumn("started_at", F.lit("2024-01-01 05:00:00").cast("timestamp")).withColumn("decision", F.lit("rejected")).withColumn("reason", F.lit("blurred"))
    kinds = {r.event_type: json.loads(r.event_data) for r in events.of_submissions(stuck, F.lit("2024-01-01 10:00:00").cast("timestamp")).collect()}
    assert kinds["submission.recovery_giveup"] == {"age_seconds": 18000} and kinds["submission.rejected"]["reason"] == "blurred"


def test_approved_observers_become_agents(spark):
    rows = spark.createDataFrame([(1, "A", "org", "approved"), (2, "B", "org", "rejected"), (3, "C", "org", "pending")], "registration_id long, name string, organisation string, decision string")
    assert [tuple(r) for r in events.agents_of_observers(rows).collect()] == [("observer-1", "observer", "A", "org")]
    full = rows.withColumns({"reason": F.lit(None).cast("string"), "reviewer": F.lit("r"), "decided_at": F.lit(None).cast("timestamp")})
    assert {r.event_type: json.loads(r.event_data)["agent_id"] for r in events.of_observers(full).collect()} == {"observer.approved": "observer-1", "observer.rejected": None}


def test_pilot_verdicts(spark):
    attempts = [("good", "success")] * 19 + [("good", "error")] + [("blocked", "image_blocked")] * 3 + [("some", "success")] * 9 + [("some", "image_blocked")] + [("bad", "odd shape")] * 4 + [("low", "success")] + [("low", "unparseable")] * 3 + [("chain", "success")]
    runs = [("good", 20, None), ("blocked", 3, None), ("some", 0, None), ("bad", 4, None), ("low", 4, None), ("chain", 1, 9), ("none", 5, None)]
    found = {r.run: r for r in pilot.verdicts(spark.createDataFrame(attempts, "run string, outcome string"), spark.createDataFrame(runs, "run string, registry long, broken_seq long")).collect()}
    assert {k: r.issues for k, r in found.items()} == {
        "good": [], "blocked": ["all blocked"], "some": ["blocked: 1"], "bad": ["none succeeded"], "low": ["low success percent: 25.0", "unknown shapes: 3"], "chain": ["log broken at: 9"], "none": ["nothing attempted"],
    }
    assert {k for k, r in found.items() if r.ship} == {"good"} and found["bad"].error == 4
    assert (found["good"].success_pct, found["some"].coverage_pct, found["none"].success_pct) == (95.0, 0.0, 0.0)


def test_percentiles_equal_sorted_lists(spark):
    draw = random.Random(2)
    rows = [(g, draw.choice([draw.random(), 0.5, None])) for g in "aaaaaabbc" for _ in range(60)] + [("d", 1.0), ("e", None)]
    found = {(r.g, r.percent): r.value for r in rollups.floor_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v", (0, 50, 95, 100)).collect()}
    expected = {}
    for g in "abcd":
        values = sorted(v for k, v in rows if k == g and v is not None)
        expected |= {(g, p): values[min(len(values) - 1, math.floor(len(values) * p / 100))] for p in (0, 50, 95, 100)}
    assert found == expected


def test_region_rows_come_from_the_dimension(spark):
    dimension = spark.createDataFrame([("1", "One", None, "1"), ("2", "Empty", None, "2")], "code string, name string, parent_code string, state_code string")
    live = spark.createDataFrame([(1, 1, "consensus", {"A": 3, "B": 1}, 2.0, 4.0), (2, 1, "no_data", None, 4.0, 6.0)], "pu long, state long, status string, votes map<string,long>, lng double, lat double")
    one, empty = sorted(rollups.region_rows(dimension, live, "state").collect(), key=lambda r: r.code)
    assert (one.pu_count, one.units_reporting, one.units_consensus, one.centroid_lng, one.leader_party, one.leader_share, one.party_totals_json) == (2, 1, 1, 3.0, "A", 0.75, '{"A":3,"B":1}')
    assert (empty.name, empty.pu_count, empty.units_consensus, empty.centroid_lat, empty.leader_party, empty.party_totals_json) == ("Empty", 0, 0, None, None, "{}")


def test_forms_in_conflict_are_those_named(spark):
    found = spark.createDataFrame([("e", 1, [11, 12, 99]), ("e", 2, [])], "election string, pu long, conflicting array<long>")
    forms = spark.createDataFrame([(11, "observer", None, {"A": 1}, 1), (12, "official", None, {"A": 2}, 2), (13, "official", None, {"A": 3}, 3)], "id long, source_type string, party string, votes map<string,long>, submitted_at long")
    assert sorted(r.submission_id for r in detail.in_conflict(found, forms).collect()) == [11, 12]


def test_form_of_entities_keeps_flags_true_unless_they_are_named(spark):
    entity = "array<struct<type:string,text:string,confidence:double>>"
    rows = [(1, [("party_x", "1", 0.5)]), (2, [("party_x", "1", None), ("presiding_officer_signed", "no", 1.0)]), (3, [("rejected_ballots", "1", 1.0)]), (4, None), (5, [(None, None, None), ("candidate_a_b", "2 1", 1.0)])]
    found = {r.id: r for r in registers.forms_of_entities(spark.createDataFrame(rows, f"id long, entities {entity}"), validation.whole_number).collect()}
    assert [found[1].form.presiding_officer_signed, found[1].form.official_stamp_present, found[2].form.presiding_officer_signed] == [True, True, False]
    assert found[3].form is None and found[4].form is None and found[4].confidence is None
    assert found[5].form.candidate_votes == {"A_B": 21} and found[5].form.total_votes_cast == 21 and found[5].form.pu_code == "unknown"
    assert found[1].confidence == 0.5 and found[2].confidence == 0.0 and set(found[2].confidences) == {"candidate_votes.X"}


def test_unit_detail_holds_every_section_of_the_units_asked_for(spark):
    wanted = spark.createDataFrame([(1,), (9,)], "pu long")
    live = spark.createDataFrame([(1, "consensus", 2, 2), (2, "no_data", None, None)], "pu long, status string, submission_count long, source_count long")
    forms = spark.createDataFrame([(1, 5, True), (1, 6, False), (2, 7, True)], "pu long, id long, approved boolean").withColumns({"source_type": F.lit("observer"), "party": F.lit(None).cast("string"), "valid": F.lit(1), "image_sha256": F.lit("s")})
    found = spark.createDataFrame([(1, "x", 5)], "pu long, anomaly_type string, severity long")
    log = spark.createDataFrame([(k, "e", '{"pu_code":"1"}') for k in range(60)] + [(99, "e", "{}")], "seq long, event_type string, event_data string")
    rows = detail.of_units(wanted, live, forms, found, log).collect()
    count = {s: sum(r.section == s for r in rows) for s in ("unit", "submission", "manifest", "anomaly", "audit")}
    assert count == {"unit": 1, "submission": 1, "manifest": 1, "anomaly": 1, "audit": 50} and {r.pu for r in rows} == {1}
    assert min(int(r.key) for r in rows if r.section == "audit") == 10
