"""The collation queries against their SQL, and the operators' edge cases on small tables."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from ballotlake.operators import anomaly, audit, rollups
from ballotlake.operators.consensus import consensus
from ballotlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, data, name):
    ours = catalog.QUERIES[name](spark, data)
    columns = sorted(ours.columns)
    rows = Counter(tuple(_plain(r[c]) for c in columns) for r in ours.collect())
    if name not in catalog.ORACLE:
        return
    sql = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    assert Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in sql.fetchall()) == rows


FORM = "id long, election string, pu long, submitted_at long, source_type string, party string, approved boolean, votes map<string,long>, accredited long, valid long, rejected long, cast long"


def form(i, pu, kind, votes, party=None, approved=True, at=0, rejected=0):
    valid = sum(votes.values()) if votes is not None else None
    return (i, "e", pu, at, kind, party, approved, votes, 100, valid, rejected, None if valid is None else valid + rejected)


def test_consensus_statuses(spark):
    rows = [
        form(1, 1, "official", {"A": 5}),
        form(2, 2, "party_agent", {"A": 5}, "P"),
        form(3, 3, "party_agent", {"A": 5}, "P"), form(4, 3, "observer", {"A": 6}),
        form(5, 4, "party_agent", {"A": 5}, "P"), form(6, 4, "observer", {"A": 5}), form(7, 4, "official", {"A": 7}),
        form(8, 5, "party_agent", {"A": 5}, "P"), form(9, 5, "observer", {"A": 5}), form(10, 5, "official", {"A": 5}),
        form(11, 6, "party_agent", {"A": 5}, "P"), form(12, 6, "observer", {"A": 5}),
        form(13, 7, "party_agent", {"A": 5}, "P", approved=False), form(14, 7, "observer", None),
        form(15, 8, "party_agent", {"A": 5, "B": 1}, "P"), form(16, 8, "observer", {"A": 6}),  # B counts as 0 where it is left out
    ]
    got = {r.pu: r for r in consensus(spark.createDataFrame(rows, FORM)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "inec_published", 2: "single_source", 3: "discrepancy", 4: "inec_conflict", 5: "inec_confirmed", 6: "consensus", 8: "discrepancy"}
    assert got[4].fields == ["valid", "cast", "candidate_votes.A"]
    assert got[8].fields == ["candidate_votes.A", "candidate_votes.B"]
    assert got[3].votes is None and got[6].votes == {"A": 5}
    assert consensus(spark.createDataFrame(rows, FORM), tolerance=2).filter("status = 'discrepancy'").count() == 0


def test_upper_median(spark):
    rows = [form(i, 1, "observer", {"A": v}) for i, v in enumerate((1, 2, 3, 4))]
    assert consensus(spark.createDataFrame(rows, FORM), tolerance=9).first().votes == {"A": 3}


def test_empty_submissions(spark):
    assert consensus(spark.createDataFrame([], FORM)).count() == 0


def test_units_without_results_stay(spark):
    units = spark.createDataFrame([(1, 1, 1, "w", 10), (2, 1, 1, "w", 10)], "pu long, state long, lga long, ward string, registered long")
    live = rollups.live_status(units, consensus(spark.createDataFrame([form(1, 1, "official", {"A": 0})], FORM)), "e")
    row = rollups.region_aggregates(live, "state").first()
    assert (row.total_pus, row.inec_published, row.total_votes, row.leader_share) == (2, 1, 0, None)


def test_insert_ignore_takes_nulls_as_equal(spark):
    kind = "election string, pu long, anomaly_type string, submission_id long"
    old = spark.createDataFrame([("e", 1, "t", None)], kind)
    new = spark.createDataFrame([("e", 1, "t", None), ("e", 1, "t", 5), ("e", 1, "t", 5)], kind)
    assert [tuple(r) for r in anomaly.insert_ignore(old, new).collect()] == [("e", 1, "t", 5)]


def _double(a, b):
    return hashlib.sha256(hashlib.sha256(bytes.fromhex(a + b)).digest()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_merkle_root(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = leaves
    while len(level) > 1:
        level = [_double(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    rows = spark.createDataFrame(list(enumerate(leaves)), "seq long, hash string")
    assert audit.merkle_root(rows, span=3) == (level[0] if level else "0" * 64)


def test_chain_finds_tampering_across_ranges(spark):
    kind = "seq long, event_type string, entity_type string, entity_id string, actor_id string, event_at string, event_data string, prev_hash string, log_hash string"
    rows, prev = [], "0" * 64
    for i in range(1, 9):
        own = hashlib.sha256((prev + "t" + "e" + str(i) + "" + "now" + "{}").encode()).hexdigest()
        rows.append((i * 3, "t", "e", str(i), None, "now", "{}", prev, own))
        prev = own
    assert audit.broken(spark.createDataFrame(rows, kind), span=7).count() == 0
    rows[4] = (*rows[4][:6], '{"x":1}', *rows[4][7:])
    assert [r.seq for r in audit.broken(spark.createDataFrame(rows, kind), span=7).collect()] == [15]
