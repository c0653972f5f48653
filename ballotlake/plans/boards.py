"""The registered queries of the dashboard, roster checks and the fan-out of events, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, roster
from ..operators.consensus import VERIFIED
from ..sources import fixture
from ..sources.current import scratch
from ..streaming import fanout
from .catalog import _live, query

PARTIES = (("A", "Alpha"), ("B", "Beta"), ("C", "Gamma"), ("D", "Delta"))
_VERIFIED = ", ".join(f"'{s}'" for s in VERIFIED)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seats a nation; region 0 shares none out."""
    each = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("scope")).agg((F.count("*") * 3).alias("seats"))
    country = each.agg(F.lit(dashboard.ALL).alias("scope"), F.sum("seats").alias("seats"))
    return each.withColumn("seats", F.when(F.col("scope") != "0", F.col("seats"))).unionByName(country)


_SUMS = f", t AS (SELECT coalesce(state::VARCHAR, '_all') AS scope, party, sum(n) n FROM votes WHERE status IN ({_VERIFIED}) GROUP BY GROUPING SETS ((state, party), (party)))"


@query("E16_standings", _SUMS + """, p AS (SELECT unnest([1, 2, 3, 4]) i, unnest(['A', 'B', 'C', 'D']) party, unnest(['Alpha', 'Beta', 'Gamma', 'Delta']) AS name),
  k AS (SELECT n_regionkey::VARCHAR AS scope, CASE WHEN n_regionkey <> 0 THEN count(*) * 3 END seats FROM nation GROUP BY n_regionkey UNION ALL SELECT '_all', count(*) * 3 FROM nation),
  j AS (SELECT scope, seats, i, party, name, coalesce(n, 0) votes, coalesce(n, 0)::DOUBLE / sum(n) OVER (PARTITION BY scope) share FROM k CROSS JOIN p LEFT JOIN t USING (scope, party))
  SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY votes DESC, i)::INTEGER place, party, name, votes::BIGINT votes, round(coalesce(share, 0) * 100, 6) support_pct, floor(coalesce(share, 0) * seats + 0.5)::BIGINT seats FROM j""")
def _(spark, sf_dir):
    """Also E17: the country's table and each state's, from one pass."""
    rows = dashboard.standings(_live(spark, sf_dir), _seats(spark, sf_dir), PARTIES)
    return rows.withColumn("support_pct", F.round("support_pct", 6))


@query("E16_winners", _SUMS + " SELECT scope, arg_min(party, (-n, party)) winner FROM t GROUP BY 1")
def _(spark, sf_dir):
    return dashboard.winners(_live(spark, sf_dir))


@query("E16_headline", f""", h AS (SELECT count(*)::BIGINT units_total, count(*) FILTER (status <> 'no_data')::BIGINT units_completed, coalesce(sum(valid) FILTER (status IN ({_VERIFIED})), 0)::BIGINT total_valid_votes,
  (12 * count(*) FILTER (status IN ({_VERIFIED}) AND a IS NOT NULL))::BIGINT total_rejected_ballots, sum(registered)::BIGINT total_registered_voters, coalesce(sum(300 + pu % 50) FILTER (status IN ({_VERIFIED}) AND a IS NOT NULL), 0)::BIGINT total_accredited_voters FROM live)
  SELECT *, round(total_accredited_voters::DOUBLE / total_registered_voters * 100, 9) turnout_pct FROM h""")
def _(spark, sf_dir):
    return dashboard.headline(_live(spark, sf_dir)).withColumn("turnout_pct", F.round("turnout_pct", 9))


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units under codes of four parts; some parts are blank, and some codes come from several states."""
    pu = F.col("pu")
    code = F.concat_ws("-", F.lit("01"), F.when(pu % 29 == 0, " ").otherwise((pu % 7).cast("string")), (pu % 70).cast("string"), F.floor(pu / 140).cast("string"))
    return fixture.units(spark, sf_dir).select(F.col("state").cast("string").alias("state"), "lga", "ward", code.alias("code"))


_ROSTER = ", r AS (SELECT state::VARCHAR AS state, lga, ward, pu % 29 <> 0 AS ok, concat_ws('-', '01', pu % 7, pu % 70, pu // 140) code FROM units)"


@query("D17_code_claims", _ROSTER + " SELECT code, string_agg(DISTINCT state, ',' ORDER BY state) owners FROM r WHERE ok GROUP BY 1 HAVING count(DISTINCT state) > 1")
def _(spark, sf_dir):
    return roster.collisions(_roster(spark, sf_dir)).select("code", F.array_join("owners", ",").alias("owners"))


@query("D17_preflight", _ROSTER + " SELECT count(*) FILTER (ok AND state <> '4')::BIGINT units, count(DISTINCT code) FILTER (ok AND state <> '4')::BIGINT codes, '4' unknown, 'unknown_state' verdict FROM r")
def _(spark, sf_dir):
    row = roster.preflight(_roster(spark, sf_dir), ("0", "1", "2", "3"))
    return row.select("units", "codes", F.array_join("unknown", ",").alias("unknown"), "verdict")


@query("E24_roster_report", _ROSTER + " SELECT state, count(DISTINCT lga)::BIGINT lgas, count(DISTINCT (lga, ward))::BIGINT wards, count(*) FILTER (ok)::BIGINT pus, count(*) FILTER (NOT ok)::BIGINT skipped FROM r GROUP BY ROLLUP (state)")
def _(spark, sf_dir):
    return roster.counts(_roster(spark, sf_dir))


@query("B15_event_stream", r"""SELECT concat('event: ', CASE event_type WHEN 'click' THEN 'verified_result' WHEN 'purchase' THEN 'submission_extracted' ELSE 'submission_failed' END, chr(10), 'data: ',
  CASE event_type WHEN 'click' THEN concat('{"pu_code":"', user_id, '"', CASE WHEN event_id % 2 = 0 THEN ',"status":"consensus"' END, '}')
    WHEN 'purchase' THEN concat('{"submission_id":"', event_id, '","pu_code":"', user_id, '","confidence":', (event_id % 8) / 8, ',"anomaly_count":', event_id % 4, '}')
    ELSE concat('{"submission_id":"', event_id, '","pu_code":"', user_id, '","error":"', replace(props, '"', '\"'), '"}') END, chr(10), chr(10)) frame
  FROM events WHERE event_type IN ('click', 'purchase', 'error') AND event_id % 3 <> 2""", False)
def _(spark, sf_dir):
    """Events come in three slices; what goes to one election is read back. Also O10."""
    k, inbox, out, state = F.col("event_id"), *(scratch(spark, n) for n in ("events", "sent", "sent-state"))
    kind = F.when(F.col("event_type") == "click", "verified_result").when(F.col("event_type") == "purchase", "submission.extracted").when(F.col("event_type") == "error", "submission.failed").otherwise("other")
    rows = _table(spark, sf_dir, "events").select(
        kind.alias("type"), F.when(k % 3 == 0, "").when(k % 3 == 1, "cur").otherwise("base").alias("election_id"), F.col("user_id").cast("string").alias("pu_code"), F.when(k % 2 == 0, "consensus").alias("status"),
        k.cast("string").alias("submission_id"), ((k % 8) / 8).alias("confidence"), (k % 4).alias("anomaly_count"), F.col("props").alias("error"),
    )
    for part in range(3):
        rows.filter(F.col("submission_id").cast("long") % 5 % 3 == part).write.mode("append").parquet(inbox)
        fanout.start(spark.readStream.schema(rows.schema).parquet(inbox), out, state, availableNow=True).awaitTermination()
    return fanout.follow(spark, out, "cur").select("frame")
