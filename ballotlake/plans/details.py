"""The registered queries of whole registers, unit details, log events, roster loads and pilot verdicts, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detail, events, intake, pilot, reconcile, rollups
from ..sources import fixture
from ..sources.current import Current, scratch, written
from .catalog import FIXTURE_SQL, ORACLE, _live, _results, query
from .registers import _PEERS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(sql: str) -> str:
    """A query that goes on from the fixture's tables, as one of their kind."""
    sql = sql.removeprefix(FIXTURE_SQL).strip()
    return f"(WITH {sql.removeprefix(',')})" if sql.startswith(",") else f"({sql})"


_ANOMALIES = " UNION ALL ".join(f"SELECT pu, anomaly_type, severity FROM {_part(x)}" for x in (
    ORACLE["M20_sanity_anomalies"], ORACLE["M27_turnout_outliers"], ORACLE["M30_historical_shifts"],
    _PEERS + " SELECT pu, 'leader_share_outlier_ward' anomaly_type, (CASE WHEN abs(z) >= 5 THEN 5 WHEN abs(z) >= 4 THEN 4 ELSE 3 END)::BIGINT severity FROM hits",
))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Live units of this and of the base election, from results that are computed once."""
    results, units = written(_results(spark, sf_dir), "results"), fixture.units(spark, sf_dir)
    return tuple(rollups.live_status(units, results, election) for election in ("cur", "base"))


@query("M33_anomaly_register", f"SELECT pu, state, lga, anomaly_type, severity FROM units JOIN ({_ANOMALIES}) USING (pu)")
def _(spark, sf_dir):
    """Also I3: the hits of all layers, eleven kinds, in one table."""
    return detail.anomaly_register(fixture.units(spark, sf_dir), detail.anomalies(*_both(spark, sf_dir))).select("pu", "state", "lga", "anomaly_type", "severity")


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrepancies with the ids of the forms in conflict: those of a unit whose votes for A are not the least among them."""
    forms = fixture.submissions(spark, sf_dir).filter("approved").select("election", "pu", "id", F.col("votes")["A"].alias("a"), "submitted_at")
    found = _results(spark, sf_dir).filter(F.col("status").isin("discrepancy", "inec_conflict")).select("election", "pu", F.when(F.col("status") == "inec_conflict", 5).otherwise(3).cast("long").alias("severity"))
    least = forms.groupBy("election", "pu").agg(F.min("a").alias("least"), F.max("submitted_at").alias("detected_at"))
    odd = forms.join(least, ["election", "pu"]).filter("a > least")
    return found.join(odd.groupBy("election", "pu").agg(F.first("detected_at").alias("detected_at"), F.sort_array(F.collect_list("id")).alias("conflicting")), ["election", "pu"])


_CONFLICTS = """, f AS (SELECT election, pu, id, a, t, min(a) OVER w least, max(t) OVER w detected FROM raw WINDOW w AS (PARTITION BY election, pu)),
  g AS (SELECT r.election, r.pu, CASE WHEN status = 'inec_conflict' THEN 5 ELSE 3 END::BIGINT severity, f.id, f.a, f.detected FROM results r JOIN f USING (election, pu) WHERE status IN ('discrepancy', 'inec_conflict') AND f.a > f.least)"""


@query("D9_discrepancy_register", """SELECT r.election, r.pu, state, lga, ward, s.n, s.submissions FROM results r JOIN units u ON u.pu = r.pu
  JOIN (SELECT election, pu, count(*)::BIGINT n, string_agg(concat(id, ':', CASE WHEN id % 10 <= 4 THEN 'party_agent' WHEN id % 10 <= 6 THEN 'observer' ELSE 'official' END, ':', a), ';' ORDER BY id) submissions FROM raw GROUP BY ALL) s ON s.pu = r.pu AND s.election = r.election
  WHERE status IN ('discrepancy', 'inec_conflict')""")
def _(spark, sf_dir):
    """All approved forms of each unit in discrepancy. A unit's forms meet in one row, as its text is one value; M34_forms_in_conflict has a row for each."""
    found = _results(spark, sf_dir).filter(F.col("status").isin("discrepancy", "inec_conflict")).select("election", "pu")
    forms = fixture.submissions(spark, sf_dir).filter("approved").join(found, ["election", "pu"], "left_semi")
    told = F.concat_ws(":", F.col("id").cast("string"), "source_type", F.col("votes")["A"].cast("string"))
    own = forms.groupBy("election", "pu").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", told.alias("told")))).alias("each"))
    rows = own.join(fixture.units(spark, sf_dir).select("pu", "state", "lga", "ward"), "pu")
    return rows.select("election", "pu", "state", "lga", "ward", "n", F.array_join(F.transform("each", lambda e: e["told"]), ";").alias("submissions"))


@query("M34_forms_in_conflict", f"{_CONFLICTS} SELECT election, pu, severity, id submission_id, CASE WHEN id % 10 <= 4 THEN 'party_agent' WHEN id % 10 <= 6 THEN 'observer' ELSE 'official' END source, a votes_a FROM g")
def _(spark, sf_dir):
    """Also D9: each discrepancy with those submissions that its ids name, a row each."""
    rows = detail.in_conflict(_conflicts(spark, sf_dir), fixture.submissions(spark, sf_dir))
    return rows.select("election", "pu", "severity", "submission_id", "source", F.col("votes")["A"].alias("votes_a"))


@query("M34_discrepancy_page", f"""{_CONFLICTS} SELECT p.*, state, lga, ward FROM (SELECT election, pu, severity, epoch(any_value(detected))::BIGINT detected, string_agg(concat(id, ':', a), ';' ORDER BY id) submissions FROM g GROUP BY ALL ORDER BY severity DESC, 4 DESC, election, pu LIMIT 500) p JOIN units USING (pu)""")
def _(spark, sf_dir):
    rows = detail.discrepancy_register(_conflicts(spark, sf_dir), fixture.units(spark, sf_dir), fixture.submissions(spark, sf_dir))
    text = F.array_join(F.transform("submissions", lambda s: F.concat_ws(":", s["submission_id"].cast("string"), s["votes"]["A"].cast("string"))), ";")
    return rows.select("election", "pu", "severity", F.unix_timestamp("detected_at").alias("detected"), text.alias("submissions"), "state", "lga", "ward")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with all the steps that they may have taken."""
    k = F.col("id")
    day = lambda n: F.col("submitted_at") + F.make_dt_interval(F.lit(n))
    when = lambda c, v: F.when(c, v)
    return fixture.submissions(spark, sf_dir).withColumns({
        "image_sha256": F.sha2(k.cast("string"), 256), "extracted_at": when(k % 3 != 0, day(1)), "confidence": (k % 8).cast("double") / 8, "backend": F.lit("first"), "arithmetic_ok": k % 5 != 0,
        "retried_at": when(k % 4 == 0, day(2)), "previous_error": when(k % 8 == 0, "timeout"), "started_at": when(k % 6 != 0, F.lit("2000-01-01 00:00:00").cast("timestamp") - F.make_dt_interval(secs=(k % 300 * 60).cast("decimal(18,6)"))),
        "reviewed_at": day(3), "reviewer": F.lit("r"), "decision": when(k % 7 != 0, F.when(k % 20 == 19, "rejected").otherwise("approved")), "reason": F.lit("blurred"),
    })


_NOW = "2000-01-01 00:00:00"
_PLACE_SQL = '''"election_id":"', e, '","pu_code":"', pu, '"'''
_EVENTS = f"""WITH s AS (SELECT o_orderkey id, o_custkey pu, CASE WHEN year(o_orderdate) >= 1998 THEN 'cur' ELSE 'base' END e, sha256(o_orderkey::VARCHAR) sha, CASE WHEN o_orderkey % 10 <= 4 THEN 'party_agent' WHEN o_orderkey % 10 <= 6 THEN 'observer' ELSE 'official' END src, o_orderkey % 300 * 60 age FROM orders)
  SELECT 'submission.created' event_type, id, NULL actor, concat('{{{_PLACE_SQL},"image_sha256":"', sha, '","source":"', src, '","party":', CASE WHEN id % 10 <= 4 THEN concat('"P', id % 4, '"') ELSE 'null' END, '}}') event_data FROM s
  UNION ALL SELECT 'submission.extracted', id, NULL, concat('{{{_PLACE_SQL},"image_sha256":"', sha, '","confidence":', (id % 8)::DOUBLE / 8, ',"backend":"first","arithmetic_ok":', id % 5 <> 0, '}}') FROM s WHERE id % 3 <> 0
  UNION ALL SELECT 'submission.retry_requested', id, NULL, concat('{{"previous_error":', CASE WHEN id % 8 = 0 THEN '"timeout"' ELSE 'null' END, ',{_PLACE_SQL}}}') FROM s WHERE id % 4 = 0
  UNION ALL SELECT CASE WHEN age > 14400 THEN 'submission.recovery_giveup' ELSE 'submission.recovery_requeued' END, id, NULL, concat('{{"age_seconds":', age, '}}') FROM s WHERE id % 3 = 0 AND id % 6 <> 0 AND age > 1800
  UNION ALL SELECT CASE WHEN id % 20 = 19 THEN 'submission.rejected' ELSE 'submission.approved' END, id, 'r', concat('{{{_PLACE_SQL},"reason":', CASE WHEN id % 20 = 19 THEN '"blurred"' ELSE 'null' END, '}}') FROM s WHERE id % 7 <> 0"""


@query("B19_submission_events", f"SELECT event_type, id::VARCHAR entity_id, actor actor_id, event_data FROM ({_EVENTS})", False)
def _(spark, sf_dir):
    """The seven kinds of events of submissions, in one pass."""
    return events.of_submissions(_steps(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("event_type", "entity_id", "actor_id", "event_data")


@query("B19_observer_events", """SELECT concat('observer.', d) event_type, c_custkey::VARCHAR entity_id, 'r' actor_id, concat('{"observer_org":"', c_mktsegment, '","reason":', CASE WHEN d = 'rejected' THEN '"late"' ELSE 'null' END, ',"agent_id":', CASE WHEN d = 'approved' THEN concat('"observer-', c_custkey, '"') ELSE 'null' END, '}') event_data
  FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'approved' END d FROM customer WHERE c_custkey % 5 <> 0)""", False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    decision = F.when(k % 5 == 0, "pending").when(k % 3 == 0, "rejected").otherwise("approved")
    rows = _table(spark, sf_dir, "customer").select(k.alias("registration_id"), F.col("c_mktsegment").alias("organisation"), decision.alias("decision"), F.when(decision == "rejected", "late").alias("reason"), F.lit("r").alias("reviewer"), F.lit(None).cast("timestamp").alias("decided_at"))
    return events.of_observers(rows).select("event_type", "entity_id", "actor_id", "event_data")


@query("M35_unit_detail", f""", a AS ({_ANOMALIES}), forms AS (SELECT o_orderkey id, o_custkey pu FROM orders WHERE o_orderkey % 20 <> 19),
  log AS (SELECT o_orderkey seq, o_custkey pu, CASE WHEN o_orderkey % 20 = 19 THEN 'submission.rejected' ELSE 'submission.approved' END kind FROM orders)
  SELECT pu, 'unit' section, pu::VARCHAR AS key, concat('{{"status":"', status, '","submission_count":', coalesce(submission_count, 0), ',"source_count":', coalesce(source_count, 0), '}}') body FROM live
  UNION ALL SELECT pu, 'submission', id::VARCHAR, concat('{{"source_type":"', CASE WHEN id % 10 <= 4 THEN 'party_agent' WHEN id % 10 <= 6 THEN 'observer' ELSE 'official' END, '","party":', CASE WHEN id % 10 <= 4 THEN concat('"P', id % 4, '"') ELSE 'null' END, ',"valid":', raw.a + b + c, '}}') FROM raw JOIN units USING (pu)
  UNION ALL SELECT pu, 'manifest', id::VARCHAR, concat('{{"image_sha256":"', sha256(id::VARCHAR), '"}}') FROM forms JOIN units USING (pu)
  UNION ALL SELECT pu, 'anomaly', anomaly_type, concat('{{"severity":', severity, '}}') FROM a
  UNION ALL SELECT pu, 'audit', seq::VARCHAR, concat('{{"event_type":"', kind, '"}}') FROM (SELECT *, row_number() OVER (PARTITION BY pu ORDER BY seq DESC) k FROM log) JOIN units USING (pu) WHERE k <= 50""")
def _(spark, sf_dir):
    """All that is known of every unit: status, forms, anomalies, the last 50 events, hashes."""
    live, base = _both(spark, sf_dir)
    forms = fixture.submissions(spark, sf_dir).withColumn("image_sha256", F.sha2(F.col("id").cast("string"), 256))
    kind = F.when(F.col("approved"), "submission.approved").otherwise("submission.rejected")
    log = forms.select(F.col("id").alias("seq"), kind.alias("event_type"), F.to_json(F.struct(F.col("pu").cast("string").alias("pu_code"))).alias("event_data"))
    return detail.of_units(live.select("pu"), live, forms, detail.anomalies(live, base), log)


@query("B18_roster_load", """SELECT c_custkey::VARCHAR phone, concat('u', c_custkey % 50) pu_code, CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE 'new' END party, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('{"party":"new","pu_code":"u', c_custkey % 50, '","language":"en"}') END event_data FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 <> 0""", False)
def _(spark, sf_dir):
    """Also C10: a roster put in whole, after known phones are skipped; each new agent with its event."""
    k = F.col("c_custkey")
    every = _table(spark, sf_dir, "customer").select(k.alias("line"), k.cast("string").alias("phone"), F.concat(F.lit("u"), (k % 50).cast("string")).alias("pu_code"), F.lit("en").alias("language"), F.lit("n").alias("name"))
    agents = Current(spark, scratch(spark, "agents"), ["phone"], 8)
    agents.upsert(every.filter("line % 4 = 0").select("phone", "name", "pu_code", "language", F.lit("old").alias("party")))
    units = every.select("pu_code").distinct()
    error = F.when((F.col("line") % 3 == 0) & (F.col("line") % 4 != 0), "phone is invalid")
    _, log = intake.load_roster(every.withColumn("error", error), agents, units, "new", "admin", F.lit(None).cast("timestamp"))
    return agents.read().select("phone", "pu_code", "party").join(log.select(F.col("entity_id").alias("phone"), "event_data"), "phone", "left")


@query("E13_match_reasons", """SELECT reason, count(*)::BIGINT n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'override' WHEN c_custkey % 5 = 1 THEN 'no_lga' WHEN c_custkey % 5 = 2 THEN 'no_ward' ELSE 'exact' END reason FROM customer) GROUP BY 1""", False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, "override").when(k % 5 == 1, "no_lga").when(k % 5 == 2, "no_ward").otherwise("exact").alias("reason"))
    return reconcile.reasons(rows)


@query("E20_exact_percentiles", """SELECT event_type, p::BIGINT percent, v[least(len(v), len(v) * p // 100 + 1)] AS value FROM (SELECT event_type, list_sort(list(value)) v FROM events GROUP BY 1), (SELECT unnest([50, 95, 99]) p)""", False)
def _(spark, sf_dir):
    """By ranges of values, so that no task holds a type's values."""
    return rollups.floor_percentiles(_table(spark, sf_dir, "events"), "event_type", "value", (50, 95, 99))


_PILOT = """WITH t AS (SELECT user_id % 20 run, count(*) attempted, count(*) FILTER (event_type = 'purchase') succeeded, count(*) FILTER (event_type = 'view') not_uploaded, count(*) FILTER (event_type = 'click') blocked, count(*) FILTER (value > 90 AND event_type = 'error') odd FROM events GROUP BY 1)"""


@query("E19_pilot_verdict", _PILOT + """ SELECT run, attempted::BIGINT attempted, round(100.0::DOUBLE * succeeded / attempted, 2) success_pct, round(100.0::DOUBLE * succeeded / (2 * attempted), 2) coverage_pct,
  (CASE WHEN succeeded = 0 THEN 1 WHEN blocked > 0 THEN 1 ELSE 0 END + CASE WHEN run % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN succeeded > 0 AND succeeded::DOUBLE / attempted < 0.5 THEN 1 ELSE 0 END + CASE WHEN odd > 0 THEN 1 ELSE 0 END)::BIGINT issues,
  blocked = 0 AND run % 4 <> 1 AND odd = 0 AND succeeded::DOUBLE / attempted >= 0.9 ship FROM t""", False)
def _(spark, sf_dir):
    run = (F.col("user_id") % 20).alias("run")
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "not_uploaded").when(F.col("event_type") == "click", "image_blocked").when((F.col("event_type") == "error") & (F.col("value") > 90), "unparseable").otherwise("error")
    attempts = _table(spark, sf_dir, "events").select(run, outcome.alias("outcome"))
    sizes = attempts.groupBy("run").agg((F.count("*") * 2).alias("registry")).withColumn("broken_seq", F.when(F.col("run") % 4 == 1, F.col("run")))
    rows = pilot.verdicts(attempts, sizes)
    return rows.select("run", "attempted", "success_pct", "coverage_pct", F.size("issues").cast("long").alias("issues"), "ship")
