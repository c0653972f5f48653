"""The registered queries of public reads and registers, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import registers, rollups, spatial
from ..sources import fixture
from .catalog import _live, _results, query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


@query("D1_live_all_elections", "SELECT u.pu, election, coalesce(status, 'no_data') status FROM units u LEFT JOIN results r ON r.pu = u.pu")
def _(spark, sf_dir):
    return rollups.everywhere(fixture.units(spark, sf_dir), _results(spark, sf_dir)).select("pu", "election", "status")


@query("D5_votes_outer", "SELECT l.pu, v.party, v.n FROM live l LEFT JOIN votes v ON v.pu = l.pu")
def _(spark, sf_dir):
    return _live(spark, sf_dir).select("pu", F.explode_outer("votes").alias("party", "n"))


@query("C1_submission_view", """SELECT o_orderkey submission_id, CASE WHEN o_orderkey % 10 <= 4 THEN 'party_agent' WHEN o_orderkey % 10 <= 6 THEN 'observer' ELSE 'official' END source,
  CASE WHEN o_orderkey % 7 = 0 THEN '{}' ELSE concat('{"valid":', v, ',"rejected":12,"cast":', v + 12, '}') END extracted, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 100)::DOUBLE / 100 END confidence
  FROM (SELECT *, (a + b + c)::BIGINT v FROM (SELECT o_orderkey, (CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 3 END) * (o_custkey % 50) + 10 + CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 7 WHEN o_custkey % 5 = 1 AND o_orderkey % 10 >= 7 THEN 9 ELSE 0 END a,
    o_custkey * 7 % 120 + 5 b, CASE WHEN o_custkey % 97 = 0 THEN 4000 ELSE o_custkey * 13 % 90 END c FROM orders))""", False)
def _(spark, sf_dir):
    k = F.col("id")
    rows = fixture.submissions(spark, sf_dir).withColumn("valid", F.when(k % 7 != 0, F.col("valid"))).withColumn("confidence", F.when(k % 4 != 0, (k % 100).cast("double") / 100))
    return registers.submission_view(rows)


@query("C2_optional_filters", "SELECT pu, ward, status FROM live WHERE state = 2 AND ward LIKE '%-BUILDING' AND status = 'discrepancy'")
def _(spark, sf_dir):
    rows = _live(spark, sf_dir).withColumn("kind", F.substring_index("ward", "-", -1))
    return registers.chosen(rows, state=2, kind="BUILDING", status="discrepancy", lga=None).select("pu", "ward", "status")


@query("C3_election_or_none", "SELECT u.pu, election, status FROM units u LEFT JOIN results r ON r.pu = u.pu WHERE election = 'base' OR election IS NULL")
def _(spark, sf_dir):
    every = fixture.units(spark, sf_dir).select("pu").join(_results(spark, sf_dir), "pu", "left")
    return registers.of_election(every, "base").select("pu", "election", "status")


@query("C4_severity_range", "SELECT election, pu, CASE WHEN status = 'inec_conflict' THEN 5 ELSE 3 END::BIGINT severity FROM results WHERE status = 'inec_conflict'")
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).filter(F.size("fields") > 0).select("election", "pu", F.when(F.col("status") == "inec_conflict", 5).otherwise(3).cast("long").alias("severity"))
    return registers.severity_range(rows, 4)


@query("C7_stale_extractions", """SELECT coalesce(CASE WHEN s IS NULL THEN 'skipped' WHEN n - s > 14400 THEN 'failed' WHEN n - s > 1800 THEN 'queued' END, 'running') outcome, count(*)::BIGINT n
  FROM (SELECT CASE WHEN event_id % 17 <> 0 THEN epoch(date_trunc('second', ts)) END s, epoch(TIMESTAMP '2024-01-02 00:00:00') n FROM events) GROUP BY 1""", False)
def _(spark, sf_dir):
    started = F.when(F.col("event_id") % 17 != 0, F.col("ts").cast("timestamp"))
    outcome = registers.recovery(started, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.coalesce(outcome, F.lit("running")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("C13_scrape_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND upper(o_orderpriority) = '1-URGENT' AND o_orderstatus = 'F'", False)
def _(spark, sf_dir):
    """Elections of one type, year and state; ids are not asked for."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("election"), F.lower("o_orderpriority").alias("type"), F.col("o_orderdate").alias("date"), F.lower("o_orderstatus").alias("state"))
    return registers.elections_to_read(rows, types=("1-URGENT",), year=1997, state="F").select("o_orderkey")


@query("C18_retry_guard", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'queued' ELSE 'error: ' || event_type END next FROM events", False)
def _(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", registers.retry(status).alias("next"))


@query("C20_reporting_percent", "SELECT lga, round(count(*) FILTER (status <> 'no_data')::DOUBLE / greatest(1, count(*)) * 100, 1) reporting FROM live GROUP BY 1")
def _(spark, sf_dir):
    return rollups.reporting_percent(_live(spark, sf_dir), "lga")


@query("C23_observer_decision", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'error: not pending' WHEN event_id % 2 = 0 THEN 'approved' WHEN event_id % 3 = 0 THEN 'error: reason required' ELSE 'rejected' END decision FROM events""", False)
def _(spark, sf_dir):
    k = F.col("event_id")
    decision = registers.observer_decision(F.when(k % 2 == 0, "approve").otherwise("reject"), F.when(k % 5 == 0, "approved").otherwise("pending"), F.when(k % 3 == 0, "  ").otherwise("blurred"))
    return _table(spark, sf_dir, "events").select("event_id", decision.alias("decision"))


@query("H2_latest_discrepancies", "SELECT r.election, r.pu, epoch(max(t))::BIGINT seen FROM results r JOIN raw USING (election, pu) WHERE status IN ('discrepancy', 'inec_conflict') GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 500")
def _(spark, sf_dir):
    newest = fixture.submissions(spark, sf_dir).filter("approved").groupBy("election", "pu").agg(F.unix_timestamp(F.max("submitted_at")).alias("seen"))
    found = _results(spark, sf_dir).filter(F.col("status").isin("discrepancy", "inec_conflict")).select("election", "pu")
    return found.join(newest, ["election", "pu"]).orderBy(F.desc("seen"), "election", "pu").limit(500)


@query("H4_parties_by_votes", "SELECT party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def _(spark, sf_dir):
    """Also H10: the four parties with most votes."""
    live = _live(spark, sf_dir).filter(F.col("status").isin(*rollups.VERIFIED))
    return live.select(F.explode("votes").alias("party", "n")).groupBy("party").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "party").limit(4)


@query("H5_keyset_page", "SELECT pu, status FROM live WHERE pu > 100 ORDER BY pu LIMIT 500")
def _(spark, sf_dir):
    return registers.page(_live(spark, sf_dir).select("pu", "status"), "pu", 100)


@query("H6_units_limit", "SELECT pu, status FROM live ORDER BY pu LIMIT 5000")
def _(spark, sf_dir):
    return registers.page(_live(spark, sf_dir).select("pu", "status"), "pu", size=5000)


_LOG = """WITH l AS (SELECT o_orderkey * 2 seq, o_custkey pu, 'submission.created' event_type FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, o_custkey, CASE WHEN o_orderkey % 20 = 19 THEN 'submission.rejected' ELSE 'submission.approved' END FROM orders)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.submissions(spark, sf_dir).withColumn("actor", F.lit(None).cast("string"))
    created = F.when(F.col("event_type") == "submission.created", 0).otherwise(1)
    return registers.audit_events(rows, rows).withColumn("seq", F.col("entity_id").cast("long") * 2 + created)


@query("H7_unit_events", f"{_LOG} SELECT seq, event_type FROM l WHERE pu = 10 ORDER BY seq DESC LIMIT 50", False)
def _(spark, sf_dir):
    """Also C6: the unit is found by its path in the event's JSON."""
    return registers.recent_events(_log(spark, sf_dir), "10").select("seq", "event_type")


@query("H8_audit_page", f"{_LOG} SELECT seq, event_type FROM l WHERE seq > 1000 ORDER BY seq LIMIT 500", False)
def _(spark, sf_dir):
    return registers.page(_log(spark, sf_dir).select("seq", "event_type"), "seq", 1000)


@query("B19_audit_events", """SELECT 'submission.created' event_type, o_orderkey::VARCHAR entity_id, concat('{"pu":', o_custkey, ',"source_type":"', CASE WHEN o_orderkey % 10 <= 4 THEN 'party_agent' WHEN o_orderkey % 10 <= 6 THEN 'observer' ELSE 'official' END, '"}') event_data FROM orders
  UNION ALL SELECT CASE WHEN o_orderkey % 20 = 19 THEN 'submission.rejected' ELSE 'submission.approved' END, o_orderkey::VARCHAR, concat('{"pu":', o_custkey, '}') FROM orders""", False)
def _(spark, sf_dir):
    rows = fixture.submissions(spark, sf_dir).withColumn("actor", F.lit(None).cast("string"))
    return registers.audit_events(rows, rows).select("event_type", "entity_id", "event_data")


@query("E14_mean_confidence", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE ((event_id % 100)::DOUBLE / 100 + 1) / 2 END confidence FROM events", False)
def _(spark, sf_dir):
    k = F.col("event_id")
    fields = F.when(k % 4 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("a"), (k % 100).cast("double") / 100, F.lit("b"), F.lit(1.0)))
    return _table(spark, sf_dir, "events").select("event_id", registers.mean_confidence(fields, 0.5).alias("confidence"))


@query("E18_sum_of_regions", "SELECT coalesce(state::VARCHAR, '_sum') code, count(*)::BIGINT total_pus, count(*) FILTER (status <> 'no_data')::BIGINT reporting FROM live GROUP BY ROLLUP (state)")
def _(spark, sf_dir):
    rows = _live(spark, sf_dir).groupBy(F.col("state").cast("string").alias("code")).agg(F.count("*").alias("total_pus"), F.count_if(F.col("status") != "no_data").alias("reporting"))
    return rollups.with_sum(rows, ("total_pus", "reporting"))


@query("E17_state_seats", """, t AS (SELECT state, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY ALL)
  SELECT state, party, n, n::DOUBLE / sum(n) OVER (PARTITION BY state) * 100 support_pct, floor(n::DOUBLE / sum(n) OVER (PARTITION BY state) * (5 + state) + 0.5)::BIGINT seats FROM t""")
def _(spark, sf_dir):
    live = _live(spark, sf_dir).filter(F.col("status").isin(*rollups.VERIFIED))
    t = live.select("state", F.explode("votes").alias("party", "n")).groupBy("state", "party").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("state"))
    return t.select("state", "party", "n", (share * 100).alias("support_pct"), F.floor(share * (5 + F.col("state")) + 0.5).alias("seats"))


@query("E21_outcomes", "SELECT event_type outcome, count(*)::BIGINT n, arg_min(event_id, (ts, event_id)) example FROM events GROUP BY 1", False)
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", F.lit(False).alias("ok"), F.col("event_type").alias("reason"))
    return registers.outcomes(rows, ("ts", "event_id"), "event_id")


@query("E23_upload_percent", "SELECT lga, round(count(DISTINCT r.pu) * 100.0::DOUBLE / count(DISTINCT u.pu), 2) percent FROM units u LEFT JOIN (SELECT DISTINCT pu FROM raw WHERE official) r ON r.pu = u.pu GROUP BY 1")
def _(spark, sf_dir):
    sent = fixture.submissions(spark, sf_dir).filter("approved and source_type = 'official'")
    return rollups.upload_percent(fixture.units(spark, sf_dir), sent, "lga").select("lga", "percent")


@query("E24_roster_counts", "SELECT state, count(DISTINCT lga)::BIGINT lgas, count(DISTINCT ward)::BIGINT wards, count(*)::BIGINT pus FROM units GROUP BY 1")
def _(spark, sf_dir):
    wards = fixture.units(spark, sf_dir).groupBy("state", "lga", "ward").agg(F.count("*").alias("pus"))
    lgas = wards.groupBy("state", "lga").agg(F.count("*").alias("wards"), F.sum("pus").alias("pus"))
    return lgas.groupBy("state").agg(F.count("*").alias("lgas"), F.sum("wards").alias("wards"), F.sum("pus").alias("pus"))


@query("G7_limits_in_full", """SELECT event_id, count(*) OVER w::BIGINT recent, count(*) OVER w > 3 limited, (CASE WHEN count(*) OVER w > 3 THEN greatest(0, min(s) OVER w + 36000 - s) ELSE 0 END)::BIGINT retry_after
  FROM (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW)""", False)
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", _seconds("ts").alias("at"))
    return registers.rate_limit(rows, "user_id", 36000, 3).select("event_id", "recent", "limited", "retry_after")


@query("O6_minute_buckets", "SELECT user_id, epoch(ts)::BIGINT // 60 * 60 started, count(*)::BIGINT n, count(*) > 240 limited FROM (SELECT user_id, date_trunc('second', ts) ts FROM events) GROUP BY 1, 2", False)
def _(spark, sf_dir):
    at = _seconds("ts")
    return _table(spark, sf_dir, "events").groupBy("user_id", (at - at % 60).alias("started")).agg(F.count("*").alias("n")).withColumn("limited", F.col("n") > 240)


_PEERS = """, t AS (SELECT * FROM turned WHERE election = 'cur'), w AS (SELECT ward, count(*) n, avg(leader_share) m, stddev_pop(leader_share) s FROM t GROUP BY 1),
  hits AS (SELECT pu, state, (leader_share - m) / s z, leader_share, m, s, n FROM t JOIN w USING (ward) WHERE n >= 5 AND s > 0 AND abs((leader_share - m) / s) >= 3)"""


@query("M29_leader_share_outliers", _PEERS + " SELECT pu, (CASE WHEN abs(z) >= 5 THEN 5 WHEN abs(z) >= 4 THEN 4 ELSE 3 END)::BIGINT severity, round(z, 2) z_score, round(leader_share, 4) pu_leader_share, round(m, 4) ward_mean, round(s, 4) ward_stddev, n::BIGINT ward_n FROM hits")
def _(spark, sf_dir):
    """Also M32: the details of a hit, rounded."""
    return registers.leader_outliers(rollups.turnout(_live(spark, sf_dir))).select("pu", "severity", "details.*")


@query("M8_fallback_choice", """SELECT event_id, CASE WHEN (c1 < 0.85 OR NOT k1 OR f < 0.85) AND k2 AND c2 >= c1 THEN 'second' ELSE 'first' END taken FROM (SELECT event_id, (event_id % 100)::DOUBLE / 100 c1, event_id % 7 <> 0 k1, (event_id % 90)::DOUBLE / 90 f,
  (event_id * 13 % 100)::DOUBLE / 100 c2, event_id % 5 <> 0 k2 FROM events)""", False)
def _(spark, sf_dir):
    k = F.col("event_id")
    one = lambda name, c, ok, f: F.struct(F.lit(name).alias("name"), c.alias("confidence"), ok.alias("consistent"), F.create_map(F.lit("a"), f).alias("fields"))
    first = one("first", (k % 100).cast("double") / 100, k % 7 != 0, (k % 90).cast("double") / 90)
    second = one("second", (k * 13 % 100).cast("double") / 100, k % 5 != 0, F.lit(1.0))
    return _table(spark, sf_dir, "events").select("event_id", registers.better(first, second)["name"].alias("taken"))


@query("L4_ring_centroid", "SELECT c_custkey, CASE WHEN w = 0 THEN x ELSE x + w / 2 END cx, CASE WHEN w = 0 THEN y ELSE y + 1 END cy FROM (SELECT c_custkey, (c_custkey % 40)::DOUBLE x, (c_custkey % 30)::DOUBLE y, (c_custkey % 5)::DOUBLE w FROM customer)", False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w = (k % 40).cast("double"), (k % 30).cast("double"), (k % 5).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x + w, y), point(x + w, y + 2), point(x, y + 2), point(x, y))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", registers.ring_centroid(ring).alias("c"))
    return rows.select("c_custkey", F.round("c.x", 9).alias("cx"), F.round("c.y", 9).alias("cy"))


@query("L14_symbol_class", """, t AS (SELECT lga, count(*) total, count(*) FILTER (status <> 'no_data') reporting, avg(greatest(a, b, c)::DOUBLE / valid) share FROM live GROUP BY 1)
  SELECT lga, CASE WHEN reporting::DOUBLE / total < 0.5 THEN 'few' WHEN share >= 0.85 THEN 'strong' WHEN share >= 0.5 THEN 'clear' WHEN share >= 0.2 THEN 'close' ELSE 'none' END class FROM t""")
def _(spark, sf_dir):
    top = F.array_max(F.map_values("votes")) / F.col("valid")
    t = _live(spark, sf_dir).groupBy("lga").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "no_data").alias("reporting"), F.avg(top).alias("share"))
    return t.select("lga", registers.symbol(F.col("total"), F.col("reporting"), F.col("share")).alias("class"))


@query("L8_geojson", """SELECT concat('{"type":"Feature","properties":{"ward":"', ward, '"},"geometry":', CASE WHEN n % 2 = 0 THEN concat('{"type":"Point","coordinates":[', n, ',', lga, ']}') ELSE 'null' END, '}') feature FROM (SELECT ward, lga, count(*) n FROM units GROUP BY ALL)""")
def _(spark, sf_dir):
    wards = fixture.units(spark, sf_dir).groupBy("ward", "lga").agg(F.count("*").alias("n"))
    place = F.when(F.col("n") % 2 == 0, F.struct(F.lit("Point").alias("type"), F.array("n", "lga").alias("coordinates")))
    return spatial.geojson_features(wards.withColumn("geometry", place), ["ward"]).select("feature")


@query("O2_quarantine", "SELECT event_id, event_type FROM events WHERE try_cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) IS NULL OR value < 10", False)
def _(spark, sf_dir):
    number = F.get_json_object("props", "$.k").try_cast("long")
    _, failed = registers.split_failed(_table(spark, sf_dir, "events"), number.isNotNull() & (F.col("value") >= 10))
    return failed.select("event_id", "event_type")


@query("O10_event_fan_out", "SELECT user_id, event_type, count(*)::BIGINT n FROM events WHERE event_type IN ('click', 'error') AND user_id % 2 = 0 GROUP BY ALL", False)
def _(spark, sf_dir):
    rows = registers.chosen(_table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error")).withColumn("odd", F.col("user_id") % 2), odd=0)
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
