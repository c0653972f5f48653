"""Dashboards, roster checks and the fan-out of events on small rows."""

import json

from pyspark.sql import functions as F

from ballotlake.operators import dashboard, roster
from ballotlake.streaming import fanout

LIVE = "state long, status string, votes map<string,long>, rejected long, registered long, accredited long"


def _live(spark):
    return spark.createDataFrame([
        (1, "consensus", {"A": 30, "B": 30}, 2, 100, 70), (1, "discrepancy", {"B": 900}, 9, 100, 950), (1, "no_data", None, None, 100, None),
        (2, "inec_confirmed", {"C": 10, "Z": 30}, 1, 50, 45), (3, "inec_published", {}, 0, None, 0),
    ], LIVE)


PARTIES = (("A", "Alpha"), ("B", "Beta"), ("C", "Gamma"))


def test_standings_of_states_and_country(spark):
    seats = spark.createDataFrame([("1", 3), ("2", None), ("9", 4), (dashboard.ALL, 7)], "scope string, seats long")
    rows = dashboard.standings(_live(spark), seats, PARTIES).collect()
    found = {(r.scope, r.place): (r.party, r.votes, round(r.support_pct, 6), r.seats) for r in rows}
    assert len(rows) == len(found) == 12  # state 3 has no votes and no seats, state 9 no units
    assert found["1", 1] == ("A", 30, 50.0, 2) and found["1", 2] == ("B", 30, 50.0, 2) and found["1", 3] == ("C", 0, 0.0, 0)
    assert found["2", 1] == ("C", 10, 25.0, None)  # Z is not listed, but counts in the whole
    assert [found["9", i][:3] for i in (1, 2, 3)] == [(p, 0, 0.0) for p in "ABC"]
    assert [found[dashboard.ALL, i] for i in (1, 2, 3)] == [("A", 30, 30.0, 2), ("B", 30, 30.0, 2), ("C", 10, 10.0, 1)]
    assert {r.scope: r.winner for r in dashboard.winners(_live(spark)).collect()} == {"1": "A", "2": "Z", dashboard.ALL: "A"}


def test_headline(spark):
    row = dashboard.headline(_live(spark)).first()
    assert tuple(row)[:6] == (5, 4, 100, 3, 350, 115) and round(row.turnout_pct, 6) == round(115 / 350 * 100, 6)
    none = dashboard.headline(_live(spark).limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, 0.0)


def test_roster_checks(spark):
    schema = "state string, lga string, ward string, code string"
    rows = spark.createDataFrame([
        ("Abia", "a", "w", "01-1-1-1"), ("Kano", "k", "v", "01-1-1-1"), ("Abia", "a", "w", "01-1-1-2"), ("Abia", "a", "w", "01-1-1-2"), ("Abia", "b", "x", "01-1-1"), ("Kano", "k", "v", "01- -1-9"), ("Kano", "k", "v", None),
    ], schema)
    assert [tuple(r) for r in roster.collisions(rows).collect()] == [("01-1-1-1", ["Abia", "Kano"])]
    assert tuple(roster.preflight(rows, ("Abia", "Kano")).first()) == (4, 2, 1, [], "collision")
    assert tuple(roster.preflight(rows, ("Abia",)).first()) == (3, 2, 0, ["Kano"], "unknown_state")
    assert tuple(roster.preflight(rows.limit(0), ("Abia",)).first()) == (0, 0, 0, [], "ok")
    assert tuple(roster.preflight(rows.withColumn("state", F.lit(None).cast("string")), ("Abia",)).first()) == (0, 0, 0, [""], "unknown_state")
    found = {r.state: tuple(r)[1:] for r in roster.counts(rows).collect()}
    assert found == {"Abia": (2, 2, 3, 1), "Kano": (1, 1, 1, 2), None: (3, 3, 4, 3)}


def test_events_reach_those_who_follow_their_election(spark, tmp_path):
    schema = "type string, election_id string, pu_code string, status string, submission_id string, confidence double, anomaly_count long, error string"
    inbox, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    batches = [
        [("verified_result", "e1", "p", None, None, None, None, None), ("submission.failed", None, "p", None, "s", None, None, 'a "b"')],
        [("submission.extracted", "", "q", None, "s", 0.5, 0, None), ("verified_result", "e2", "q", "consensus", None, None, None, None), ("seen", "e1", "p", None, None, None, None, None)],
    ]
    for rows in (*batches, []):  # the last run finds nothing new
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        fanout.start(spark.readStream.schema(schema).parquet(inbox), out, state, availableNow=True).awaitTermination()
    got = {e: sorted((r.event, json.dumps(json.loads(r.data))) for r in fanout.follow(spark, out, e).collect()) for e in ("e1", "e2", "e3")}
    shared = [("submission_extracted", '{"submission_id": "s", "pu_code": "q", "confidence": 0.5, "anomaly_count": 0}'), ("submission_failed", '{"submission_id": "s", "pu_code": "p", "error": "a \\"b\\""}')]
    assert got == {"e1": [*shared, ("verified_result", '{"pu_code": "p"}')], "e2": [*shared, ("verified_result", '{"pu_code": "q", "status": "consensus"}')], "e3": shared}
    frame = fanout.follow(spark, out, "e2").filter("event = 'verified_result'").first().frame
    assert frame == 'event: verified_result\ndata: {"pu_code":"q","status":"consensus"}\n\n'
