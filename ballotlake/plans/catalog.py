"""The registered queries of the collation operators and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import geofence, haversine, in_polygon, in_ring, mercator, tile
from ..operators import anomaly, divergence, intake, reconcile, rollups, validation
from ..operators import registers as registers_of
from ..operators.consensus import VERIFIED, consensus
from ..sources import files, fixture
from ..sources.current import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FIXTURE_SQL = """
WITH units AS (
  SELECT c_custkey::BIGINT pu, n_regionkey::BIGINT state, c_nationkey::BIGINT lga, concat(c_nationkey, '-', c_mktsegment) ward,
    (CASE WHEN c_custkey % 41 = 0 THEN 0 WHEN c_custkey % 37 = 0 THEN 50 ELSE 4600 + c_custkey % 400 END)::BIGINT registered
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw AS (
  SELECT o_orderkey id, o_custkey pu, o_orderdate t, CASE WHEN year(o_orderdate) >= 1998 THEN 'cur' ELSE 'base' END election, o_orderkey % 10 >= 7 official,
    CASE WHEN o_orderkey % 10 <= 4 THEN 'party:P' || (o_orderkey % 4) WHEN o_orderkey % 10 <= 6 THEN 'observer:' || o_orderkey ELSE 'inec_irev' END source,
    (CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 3 END) * (o_custkey % 50) + 10
      + CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 7 WHEN o_custkey % 5 = 1 AND o_orderkey % 10 >= 7 THEN 9 ELSE 0 END a,
    o_custkey * 7 % 120 + 5 b, CASE WHEN o_custkey % 97 = 0 THEN 4000 ELSE o_custkey * 13 % 90 END c,
    o_custkey % 23 <> 0 OR o_orderkey % 2 = 0 signed, o_orderkey % 3 marks
  FROM orders WHERE o_orderkey % 20 <> 19),
grouped AS (
  SELECT election, pu, count(*) submission_count, count(DISTINCT source) source_count, count(DISTINCT source) FILTER (NOT official) independent,
    count(*) FILTER (official) officials, max(a) FILTER (NOT official) - min(a) FILTER (NOT official) gap,
    list_sort(list(a) FILTER (NOT official)) own, arg_min(a, (t, id)) FILTER (official) official_a, arg_min(a, (t, id)) first_a, min(b) b, min(c) c,
    count(DISTINCT signed) FILTER (NOT official) > 1 unsigned, arg_min(signed, (t, id)) FILTER (official) official_signed, arg_min(signed, (t, id)) FILTER (NOT official) first_signed
  FROM raw GROUP BY election, pu),
agreed AS (
  SELECT *, own[len(own) // 2 + 1] median_a,
    CASE WHEN independent = 0 THEN 'inec_published' WHEN independent < 2 AND officials = 0 THEN 'single_source' WHEN gap > 0 OR unsigned THEN 'discrepancy'
      WHEN officials > 0 AND (own[len(own) // 2 + 1] <> official_a OR first_signed <> official_signed) THEN 'inec_conflict' WHEN officials > 0 THEN 'inec_confirmed' ELSE 'consensus' END status
  FROM grouped),
results AS (
  SELECT election, pu, status, submission_count::BIGINT submission_count, source_count::BIGINT source_count,
    CASE WHEN status = 'discrepancy' THEN concat_ws(',', CASE WHEN gap > 0 THEN 'valid,cast,candidate_votes.A' END, CASE WHEN unsigned THEN 'presiding_officer_signed' END)
      WHEN status = 'inec_conflict' THEN concat_ws(',', CASE WHEN median_a <> official_a THEN 'valid,cast,candidate_votes.A' END, CASE WHEN first_signed <> official_signed THEN 'presiding_officer_signed' END) END fields,
    CASE status WHEN 'inec_published' THEN official_signed WHEN 'discrepancy' THEN NULL ELSE first_signed END signed, b::BIGINT b, c::BIGINT c,
    (CASE status WHEN 'inec_published' THEN official_a WHEN 'single_source' THEN first_a WHEN 'discrepancy' THEN NULL ELSE median_a END)::BIGINT a
  FROM agreed),
every AS (
  SELECT e.election, u.*, coalesce(r.status, 'no_data') status, r.submission_count, r.source_count, r.a, r.b, r.c, r.a + r.b + r.c valid, r.a + r.b + r.c + 12 "cast"
  FROM units u CROSS JOIN (SELECT unnest(['cur', 'base']) election) e LEFT JOIN results r ON r.pu = u.pu AND r.election = e.election),
live AS (SELECT * FROM every WHERE election = 'cur'),
votes AS (
  SELECT pu, state, lga, ward, status, p.party, p.n FROM live, LATERAL (SELECT unnest(['A', 'B', 'C']) party, unnest([a, b, c]) n) p WHERE a IS NOT NULL),
turned AS (
  SELECT election, pu, state, lga, ward, status, "cast"::DOUBLE / registered turnout, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END leader,
    greatest(a, b, c)::DOUBLE / valid leader_share
  FROM every WHERE registered > 0 AND a IS NOT NULL)
"""


def query(name: str, sql: str | None = None, fixture_sql: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (FIXTURE_SQL if fixture_sql else "") + sql
        return f

    return add


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(fixture.submissions(spark, sf_dir))


def _live(spark: SparkSession, sf_dir: str, election: str = "cur") -> DataFrame:
    return rollups.live_status(fixture.units(spark, sf_dir), _results(spark, sf_dir), election)


@query("F7_consensus_status", "SELECT election, pu, status, submission_count, source_count FROM results")
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("election", "pu", "status", "submission_count", "source_count")


@query("F6_consensus_votes", "SELECT election, pu, p.party, p.n FROM results, LATERAL (SELECT unnest(['A', 'B', 'C']) party, unnest([a, b, c]) n) p WHERE a IS NOT NULL")
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("election", "pu", F.explode("votes").alias("party", "n"))


_MODES = """, marks AS (SELECT election, pu, marks, count(*) n, min((t, id)) seen FROM raw WHERE NOT official GROUP BY ALL),
  own_marks AS (SELECT election, pu, arg_min(marks, (-n, seen)) own_marks FROM marks GROUP BY ALL),
  firsts AS (SELECT election, pu, arg_min(marks, (t, id)) first_marks, arg_min(marks, (t, id)) FILTER (official) official_marks FROM raw GROUP BY ALL)
  SELECT election, pu, signed presiding_officer_signed, status <> 'discrepancy' OR NULL official_stamp_present,
    (CASE status WHEN 'inec_published' THEN official_marks WHEN 'single_source' THEN first_marks WHEN 'discrepancy' THEN NULL ELSE own_marks END)::BIGINT agent_signatures,
    CASE WHEN status <> 'discrepancy' THEN 4600 + pu % 400 END::BIGINT registered_voters
  FROM results LEFT JOIN own_marks USING (election, pu) JOIN firsts USING (election, pu)"""


@query("F5_consensus_flags", _MODES)
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("election", "pu", "presiding_officer_signed", "official_stamp_present", "agent_signatures", "registered_voters")


@query("F12_discrepancies", "SELECT election, pu, CASE WHEN status = 'inec_conflict' THEN 5 ELSE 3 END::BIGINT severity, fields FROM results WHERE status IN ('discrepancy', 'inec_conflict')")
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).filter(F.size("fields") > 0)
    return rows.select("election", "pu", F.when(F.col("status") == "inec_conflict", 5).otherwise(3).cast("long").alias("severity"), F.concat_ws(",", "fields").alias("fields"))


@query("D2_live_status", "SELECT pu, state, lga, ward, status, coalesce(submission_count, 0)::BIGINT submission_count FROM live")
def _(spark, sf_dir):
    return _live(spark, sf_dir).select("pu", "state", "lga", "ward", "status", F.coalesce("submission_count", F.lit(0)).alias("submission_count"))


@query("C9_status_codes", "SELECT pu, (list_position(['no_data', 'single_source', 'inec_published', 'consensus', 'discrepancy', 'inec_confirmed', 'inec_conflict'], status) - 1)::BIGINT code FROM live")
def _(spark, sf_dir):
    return _live(spark, sf_dir).select("pu", rollups.status_code().alias("code"))


def _region_sql(level: str) -> str:
    counts = ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT {s}" for s in rollups.STATUSES[1:])
    return f""", t AS (SELECT {level}::VARCHAR code, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, party) k, sum(n) OVER (PARTITION BY code) total FROM t),
    bucket AS (SELECT {level}::VARCHAR code, count(*)::BIGINT total_pus, {counts} FROM live GROUP BY 1)
    SELECT b.*, coalesce(total, 0)::BIGINT total_votes, leader, coalesce(leader_votes, 0)::BIGINT leader_votes, round(leader_votes::DOUBLE / total, 4) leader_share, '{level}' "level"
    FROM bucket b LEFT JOIN (SELECT code, party leader, n leader_votes, total FROM top WHERE k = 1) USING (code)"""


def _regions(level: str, name: str) -> None:
    @query(name, _region_sql(level))
    def _(spark, sf_dir):
        return rollups.region_aggregates(_live(spark, sf_dir), level)


_regions("state", "E3_state_aggregates")
_regions("lga", "E3_lga_aggregates")
_regions("ward", "E3_ward_aggregates")


@query("E4_state_rollup", "SELECT state::VARCHAR code, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed') GROUP BY 1, 2")
def _(spark, sf_dir):
    return rollups.party_totals(_live(spark, sf_dir), "state", ("consensus", "inec_confirmed"))


@query("E5_national_rollup", "SELECT election, count(*)::BIGINT pus, count(*) FILTER (status IN ('consensus', 'inec_confirmed'))::BIGINT verified, count(*) FILTER (status = 'discrepancy')::BIGINT discrepancies FROM results GROUP BY 1")
def _(spark, sf_dir):
    s = F.col("status")
    return _results(spark, sf_dir).groupBy("election").agg(F.count("*").alias("pus"), F.count_if(s.isin("consensus", "inec_confirmed")).alias("verified"), F.count_if(s == "discrepancy").alias("discrepancies"))


def _distribution(name: str, level: str, least: int) -> None:
    @query(name, f"SELECT {level}::VARCHAR code, count(*)::BIGINT n, round(avg(turnout), 6) mean, round(stddev_samp(turnout), 6) sd FROM turned WHERE election = 'cur' GROUP BY 1 HAVING count(*) >= {least}")
    def _(spark, sf_dir):
        rows = rollups.distribution(rollups.turnout(_live(spark, sf_dir)), level, least)
        return rows.select(F.col(level).cast("string").alias("code"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_distribution("E6_ward_turnout", "ward", 5)
_distribution("E7_lga_turnout", "lga", 10)


@query("E25_bottom_up_totals", "SELECT coalesce(state, -1) state, coalesce(lga, -1) lga, coalesce(ward, '') ward, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'single_source', 'inec_confirmed') GROUP BY GROUPING SETS ((party, state, lga, ward), (party, state, lga), (party, state), (party))")
def _(spark, sf_dir):
    return rollups.bottom_up(_live(spark, sf_dir)).select(F.coalesce("state", F.lit(-1).cast("long")).alias("state"), F.coalesce("lga", F.lit(-1).cast("long")).alias("lga"), F.coalesce("ward", F.lit("")).alias("ward"), "party", "n")


@query("E26_coverage", """, t AS (SELECT lga::VARCHAR code, 100.0::DOUBLE * count(*) FILTER (status <> 'no_data') / count(*) covered,
    100.0::DOUBLE * count(*) FILTER (status IN ('consensus', 'inec_confirmed')) / greatest(1, count(*) FILTER (status <> 'no_data')) verified,
    coalesce(sum(valid) FILTER (status IN ('consensus', 'inec_confirmed')), 0)::BIGINT sce_total, coalesce(sum(valid) FILTER (status IN ('consensus', 'inec_confirmed', 'single_source')), 0)::BIGINT sce_total_single FROM live GROUP BY 1)
  SELECT code, round(covered, 2) coverage_pct, round(verified, 2) verified_pct, round(covered * verified / 100, 2) sce_confidence, CASE WHEN covered >= 100 THEN 'full' WHEN covered >= 50 THEN 'partial' ELSE 'low' END display, sce_total, sce_total_single FROM t""")
def _(spark, sf_dir):
    return rollups.coverage(_live(spark, sf_dir), "lga")


@query("E27_spread_rule", """, t AS (SELECT state, party, sum(n) n, sum(sum(n)) OVER (PARTITION BY state) w FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY 1, 2),
  p AS (SELECT party, count(*) FILTER (w > 0 AND n * 100 >= w * 25)::BIGINT states, sum(n)::BIGINT votes FROM t GROUP BY 1) SELECT *, states >= 4 AS spread, states >= 4 AND party = (SELECT arg_min(party, (-votes, party)) FROM p) wins FROM p""")
def _(spark, sf_dir):
    """Two thirds of five states are four."""
    return rollups.spread(_live(spark, sf_dir), least=4)


@query("D11_results_export", 'SELECT pu, ward, status, party, n votes, round(n::DOUBLE / NULLIF(valid, 0), 4) share FROM votes JOIN (SELECT pu, valid FROM live) USING (pu)')
def _(spark, sf_dir):
    rows = _live(spark, sf_dir).select("pu", "ward", "status", "valid", F.explode("votes").alias("party", "votes"))
    return rows.select("pu", "ward", "status", "party", "votes", F.round(F.col("votes") / F.when(F.col("valid") > 0, F.col("valid")), 4).alias("share"))


_SANITY = """SELECT pu, 'votes_exceed_registered' anomaly_type, 5::BIGINT severity FROM live WHERE registered > 0 AND "cast" > registered
UNION ALL SELECT pu, 'turnout_exceeds_accreditation', 5 FROM live WHERE "cast" > 300 + pu % 50
UNION ALL SELECT pu, 'rejected_exceeds_cast', 5 FROM live WHERE 12 > "cast" AND "cast" > 0
UNION ALL SELECT pu, 'zero_registered_voters', 4 FROM live WHERE registered = 0 AND a IS NOT NULL
UNION ALL SELECT pu, 'leader_extreme_share', 4 FROM live WHERE valid > 30 AND greatest(a, b, c)::DOUBLE / valid >= 0.97"""


@query("M20_sanity_anomalies", _SANITY)
def _(spark, sf_dir):
    return anomaly.sanity(_live(spark, sf_dir))


@query("H1_top_anomalies", f"SELECT * FROM ({_SANITY}) ORDER BY severity DESC, pu, anomaly_type LIMIT 500")
def _(spark, sf_dir):
    return anomaly.sanity(_live(spark, sf_dir)).orderBy(F.desc("severity"), "pu", "anomaly_type").limit(500)


@query("M27_turnout_outliers", """, t AS (SELECT * FROM turned WHERE election = 'cur'),
w AS (SELECT ward, avg(turnout) m, stddev_samp(turnout) s FROM t GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT lga, avg(turnout) m, stddev_samp(turnout) s FROM t GROUP BY 1 HAVING count(*) >= 10),
z AS (SELECT pu, coalesce(w.s > 0, false) usable, abs(turnout - w.m) / w.s zw, abs(turnout - l.m) / l.s zl FROM t LEFT JOIN w USING (ward) LEFT JOIN l USING (lga) WHERE status IN ('consensus', 'inec_confirmed', 'inec_published'))
SELECT pu, 'turnout_outlier_ward' anomaly_type, (CASE WHEN zw >= 5 THEN 5 WHEN zw >= 4 THEN 4 ELSE 3 END)::BIGINT severity FROM z WHERE usable AND zw >= 3
UNION ALL SELECT pu, 'turnout_outlier_lga', (CASE WHEN zl >= 4 THEN 4 ELSE 3 END)::BIGINT FROM z WHERE NOT usable AND zl >= 3""")
def _(spark, sf_dir):
    rows = rollups.turnout(_live(spark, sf_dir))
    return anomaly.turnout_outliers(rows, rows.filter(F.col("status").isin(*VERIFIED)))


@query("M30_historical_shifts", """, j AS (SELECT n.pu, abs(n.turnout - o.turnout) * 100 t, abs(n.leader_share - o.leader_share) * 100 s, n.leader <> o.leader other
  FROM turned n JOIN turned o ON n.pu = o.pu AND o.election = 'base' WHERE n.election = 'cur' AND n.status IN ('consensus', 'inec_confirmed'))
SELECT pu, 'turnout_shift' anomaly_type, (CASE WHEN t >= 70 THEN 5 WHEN t >= 50 THEN 4 ELSE 3 END)::BIGINT severity FROM j WHERE t >= 40
UNION ALL SELECT pu, 'leader_party_shift', (CASE WHEN s >= 70 THEN 5 ELSE 4 END)::BIGINT FROM j WHERE other AND s >= 50""")
def _(spark, sf_dir):
    now = rollups.turnout(_live(spark, sf_dir)).filter(F.col("status").isin("consensus", "inec_confirmed"))
    return anomaly.historical(now, rollups.turnout(_live(spark, sf_dir, "base")))


@query("G7_rate_limit", "SELECT event_id, count(*) OVER w::BIGINT recent, (count(*) OVER w > 3) limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)", False)
def _(spark, sf_dir):
    # a double that becomes a whole number is rounded in SQL, the half to the even one
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86400, 0)
    n = F.count("*").over(w)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", n.alias("recent"), (n > 3).alias("limited"))


@query("G6_latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1", False)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_id", "event_type")


@query("E20_floor_percentile", "SELECT event_type, v[least(len(v), len(v) * 95 // 100 + 1)] p95 FROM (SELECT event_type, list_sort(list(value)) v FROM events GROUP BY 1)", False)
def _(spark, sf_dir):
    """By ranges of values, so that no task holds a type."""
    rows = rollups.floor_percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", [95])
    return rows.select("event_type", F.col("value").alias("p95"))


@query("E22_histogram", "SELECT event_type, b.le, count(*) FILTER (value <= b.le)::BIGINT n FROM events, (SELECT unnest([1.0, 10.0, 50.0, 100.0]::DOUBLE[]) le) b GROUP BY 1, 2", False)
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate((1.0, 10.0, 50.0, 100.0))))
    return rows.select("event_type", F.inline(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((1.0, 10.0, 50.0, 100.0))))))


@query("L2_geofence", "SELECT pu, round(m, 3) metres, CASE WHEN m <= 100 THEN 'ok' WHEN m <= 2000 THEN 'warning' ELSE 'violation' END verdict FROM (SELECT pu, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(d) / 2), 2) + cos(radians(y)) * cos(radians(y + d)) * pow(sin(radians(d) / 2), 2))) m FROM (SELECT pu, (4 + pu % 9)::DOUBLE y, (pu % 300)::DOUBLE / 10000 d FROM units))")
def _(spark, sf_dir):
    y, d = (4 + F.col("pu") % 9).cast("double"), (F.col("pu") % 300).cast("double") / 10000
    m = haversine(y, F.lit(3.0), y + d, F.lit(3.0) + d)
    return fixture.units(spark, sf_dir).select("pu", F.round(m, 3).alias("metres"), geofence(m).alias("verdict"))


@query("C19_recovery", "SELECT CASE WHEN h > 4 THEN 'failed' WHEN h * 60 > 30 THEN 'queued' ELSE 'skipped' END outcome, count(*)::BIGINT n FROM (SELECT (event_id % 300)::DOUBLE / 60 h FROM events) GROUP BY 1", False)
def _(spark, sf_dir):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    started = now - F.make_dt_interval(mins=(F.col("event_id") % 300).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.coalesce(registers_of.recovery(started, now), F.lit("skipped")).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


_UPLOAD = "o_orderkey * 7919 % 15000000 image_bytes, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2500 END metres, CASE WHEN o_orderkey % 50 = 0 THEN 'XYZ' ELSE sha256(o_orderkey::VARCHAR) END sha"


_ELECTION_DAY = "1998-05-01"
_M1_SQL = f"""WITH u AS (SELECT o_orderkey id, {_UPLOAD}, o_orderdate t, o_custkey pu, CASE WHEN year(o_orderdate) >= 1998 THEN 'cur' ELSE 'base' END election, CASE WHEN o_orderkey % 10 <= 4 THEN 'P' || (o_orderkey % 4) END party,
    CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Adobe Photoshop 24' ELSE 'Camera 1.0' END software, CASE o_orderkey % 8 WHEN 0 THEN 'yesterday' WHEN 1 THEN strftime(o_orderdate, '%Y:%m:%d 10:00:00') WHEN 2 THEN NULL ELSE '1998:05:02 08:30:00' END taken FROM orders),
  e AS (SELECT *, try_strptime(taken, '%Y:%m:%d %H:%M:%S') shot,
    CASE WHEN NOT regexp_full_match(sha, '[0-9a-f]{{64}}') THEN 'hash_malformed' WHEN image_bytes > 12000000 THEN 'image_too_large' WHEN metres > 2000 THEN 'gps_violation' END r FROM u),
  f AS (SELECT *, coalesce(contains(lower(software), 'photoshop'), false) edited, coalesce(abs(shot::DATE - DATE '{_ELECTION_DAY}') > 1, false) moved, software IS NOT NULL OR taken IS NOT NULL present,
    row_number() OVER (PARTITION BY election, pu, party, r IS NULL ORDER BY t, id) nth FROM e),
  g AS (SELECT *, present AND NOT edited AND NOT moved AND (taken IS NULL OR shot IS NOT NULL) ok, CASE WHEN r IS NULL AND party IS NOT NULL AND nth > 1 THEN 'duplicate_party_submission' ELSE r END reject FROM f)
"""


@query("M1_ingestion", _M1_SQL + """SELECT id, CASE WHEN reject IS NULL THEN 'accepted' ELSE 'rejected' END verdict, coalesce(reject, CASE WHEN f = '' THEN 'ok' ELSE f END) flags FROM (SELECT *,
    concat_ws(',', CASE WHEN image_bytes < 60000 THEN 'image_too_small' END, CASE WHEN metres IS NULL THEN 'gps_missing' WHEN metres > 100 THEN 'gps_warning' END, CASE WHEN NOT present THEN 'exif_missing' END,
      CASE WHEN edited THEN 'exif_software_warning' END, CASE WHEN moved THEN 'exif_datetime_mismatch' END) f FROM g)""", False)
def _(spark, sf_dir):
    return validation.ingestion(_uploads(spark, sf_dir), election_day=_ELECTION_DAY)


@query("M4_exif", _M1_SQL + "SELECT id, present exif_present, ok exif_integrity_ok, edited exif_software_warning, moved exif_datetime_mismatch FROM g", False)
def _(spark, sf_dir):
    return _uploads(spark, sf_dir).select("id", F.inline(F.array(validation.exif(F.col("exif"), _ELECTION_DAY))))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = fixture.submissions(spark, sf_dir).withColumn("image_bytes", k * 7919 % 15000000).withColumn("metres", F.when(k % 6 != 0, k % 2500))
    software = F.when(k % 9 == 1, "Adobe Photoshop 24").when(k % 9 > 1, "Camera 1.0")
    taken = F.when(k % 8 == 0, "yesterday").when(k % 8 == 1, F.date_format("submitted_at", "yyyy:MM:dd 10:00:00")).when(k % 8 > 2, "1998:05:02 08:30:00")
    exif = F.map_filter(F.create_map(F.lit("Software"), software, F.lit("DateTimeOriginal"), taken), lambda _, v: v.isNotNull())
    return rows.withColumn("exif", exif).withColumn("sha256", F.when(k % 50 == 0, "XYZ").otherwise(F.sha2(k.cast("string"), 256)))


_FORMS = """, f AS (SELECT id, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END + a + b + c valid, a + b + c votes, a + b + c + 12 "cast", pu % 50 + 300 accredited, registered FROM raw JOIN units USING (pu)),
g AS (SELECT id, concat_ws(',', CASE WHEN votes <> valid THEN 'candidate_votes_sum_neq_total_valid' END, CASE WHEN valid + 12 <> "cast" THEN 'valid_plus_rejected_neq_cast' END, CASE WHEN "cast" > accredited THEN 'cast_exceeds_accredited' END, CASE WHEN accredited > registered THEN 'accredited_exceeds_registered' END) failures FROM f)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.submissions(spark, sf_dir).filter("approved").join(fixture.units(spark, sf_dir), "pu")
    wrong = rows.withColumn("valid", F.col("valid") + F.when(F.col("id") % 11 == 0, 1).otherwise(0))
    return wrong.select("id", validation.arithmetic(wrong).alias("failures"))


@query("M7_arithmetic", _FORMS + " SELECT id, failures FROM g WHERE failures <> ''")
def _(spark, sf_dir):
    return _forms(spark, sf_dir).filter("failures <> ''")


@query("M9_auto_approve", _FORMS + " SELECT id, CASE WHEN id % 100 >= 85 AND failures = '' THEN 'auto_approved' ELSE 'pending_review' END status FROM g")
def _(spark, sf_dir):
    return _forms(spark, sf_dir).select("id", validation.approval((F.col("id") % 100) / 100, F.col("failures")).alias("status"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("C17_review_guard", "SELECT event_id, CASE WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN 'error: reject requires a reason' WHEN event_id % 5 = 0 THEN 'error: not pending_review' WHEN event_id % 2 = 0 THEN 'reviewed_accepted' ELSE 'reviewed_rejected' END outcome FROM events", False)
def _(spark, sf_dir):
    k = F.col("event_id")
    action, status, reason = F.when(k % 2 == 0, "approve").otherwise("reject"), F.when(k % 5 == 0, "failed").otherwise("pending_review"), F.when(k % 3 != 0, "because")
    return _events(spark, sf_dir).select("event_id", validation.review(action, status, reason).alias("outcome"))


@query("C21_device_binding", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'first_login' WHEN user_id % 7 = event_id % 7 THEN 'same_device' ELSE 'denied' END outcome FROM events", False)
def _(spark, sf_dir):
    stored = F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 7)
    return _events(spark, sf_dir).select("event_id", validation.device(stored, F.col("event_id") % 7).alias("outcome"))


@query("C22_one_time_code", "SELECT CASE WHEN event_id % 2 = 0 THEN 'consumed' WHEN event_id % 3 = 0 THEN 'expired' WHEN event_id % 9 >= 5 THEN 'too_many_attempts' WHEN event_id % 7 <> 0 THEN 'mismatch' ELSE 'ok' END outcome, count(*)::BIGINT n FROM events GROUP BY 1", False)
def _(spark, sf_dir):
    k = F.col("event_id")
    return _events(spark, sf_dir).groupBy(validation.one_time_code(k % 2 == 0, k % 3 == 0, k % 9, k % 7 == 0).alias("outcome")).agg(F.count("*").alias("n"))


@query("M19_kebab_names", "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') slug FROM customer", False)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", validation.kebab(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))


@query("M10_clean_numbers", "SELECT c_custkey, regexp_replace(c_name, '[^0-9-]', '', 'g') digits, abs(regexp_replace(replace(c_name, '#', ''), '[^0-9]', '', 'g')::BIGINT) n FROM customer", False)
def _(spark, sf_dir):
    name = F.replace(F.replace("c_name", F.lit("#")), F.lit("-"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.regexp_replace("c_name", r"[^\d-]", "").alias("digits"), validation.whole_number(name).alias("n"))


@query("K9_code_hash", "SELECT o_orderkey, sha256(concat(o_custkey, ':', o_orderkey)) digest FROM orders", False)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 256).alias("digest"))


_PLACE = "(SELECT pu, 4 + (pu % 900)::DOUBLE / 100 lat, 3 + (pu % 1100)::DOUBLE / 100 lng FROM units)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.units(spark, sf_dir).select("pu", (4 + (F.col("pu") % 900).cast("double") / 100).alias("lat"), (3 + (F.col("pu") % 1100).cast("double") / 100).alias("lng"))


@query("L10_tile_of_unit", f"SELECT pu, floor((lng + 180) / 360 * 1024)::BIGINT x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)::BIGINT y FROM {_PLACE}")
def _(spark, sf_dir):
    x, y = tile(F.col("lat"), F.col("lng"), 10)
    return _places(spark, sf_dir).select("pu", x.alias("x"), y.alias("y"))


@query("L9_mercator", f"SELECT pu, round(radians(lng) * 6378137, 2) x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) y FROM {_PLACE}")
def _(spark, sf_dir):
    x, y = mercator(F.col("lat"), F.col("lng"))
    return _places(spark, sf_dir).select("pu", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("L5_point_in_ring", f"""SELECT pu, in_outer inside, in_outer AND NOT (lat >= 6 AND lat < 8 AND lng >= 5 AND lng < 6) inside_polygon FROM (
  SELECT *, lat >= 5 AND lat < 10 AND lng >= 4 AND lng < (11 - 6)::DOUBLE * (lat - 5) / (10 - 5)::DOUBLE + 6 in_outer FROM {_PLACE})""")
def _(spark, sf_dir):
    """A ray to the east: of a ring's edges the lower end belongs to it and the upper does not, the western does and the eastern does not."""
    ring = lambda *points: F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in points))
    outer, hole = ring((4.0, 5.0), (6.0, 5.0), (11.0, 10.0), (4.0, 10.0), (4.0, 5.0)), ring((5.0, 6.0), (6.0, 6.0), (6.0, 8.0), (5.0, 8.0), (5.0, 6.0))
    lat, lng = F.col("lat"), F.col("lng")
    return _places(spark, sf_dir).select("pu", in_ring(lat, lng, outer).alias("inside"), in_polygon(lat, lng, F.array(outer, hole)).alias("inside_polygon"))


@query("L3_centroids", f"SELECT lga, round(avg(lat), 6) lat, round(avg(lng), 6) lng, count(*)::BIGINT pus FROM {_PLACE} JOIN (SELECT pu, lga FROM units) USING (pu) GROUP BY 1")
def _(spark, sf_dir):
    rows = _places(spark, sf_dir).join(fixture.units(spark, sf_dir).select("pu", "lga"), "pu")
    return rows.groupBy("lga").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), F.count("*").alias("pus"))


@query("D17_anti_collision", "SELECT ward_name, count(DISTINCT lga)::BIGINT lgas FROM (SELECT lga, split_part(ward, '-', 2) ward_name FROM units) GROUP BY 1 HAVING count(DISTINCT lga) > 1")
def _(spark, sf_dir):
    rows = fixture.units(spark, sf_dir).select("lga", F.split_part("ward", F.lit("-"), F.lit(2)).alias("ward_name"))
    return rows.groupBy("ward_name").agg(F.countDistinct("lga").alias("lgas")).filter("lgas > 1")


@query("B3_first_seen_code", "SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) code FROM customer", False)
def _(spark, sf_dir):
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.first("c_custkey").over(w).alias("code"))


@query("B6_newest_official", "SELECT election, pu, arg_max(id, (t, id)) id FROM raw WHERE official GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = fixture.submissions(spark, sf_dir).filter("approved and source_type = 'official'")
    return rows.groupBy("election", "pu").agg(F.max_by("id", F.struct("submitted_at", "id")).alias("id"))


@query("G4_state_winners", ", t AS (SELECT state, party, sum(n)::BIGINT n FROM votes WHERE status IN ('consensus', 'inec_confirmed', 'inec_published') GROUP BY 1, 2) SELECT state::VARCHAR code, party winner, n votes FROM t QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, party) = 1")
def _(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "party"))
    return rollups.party_totals(_live(spark, sf_dir), "state").withColumn("at", place).filter("at = 1").select("code", F.col("party").alias("winner"), F.col("n").alias("votes"))


@query("D10_across_elections", "SELECT n.pu, n.status now, b.status before FROM results n JOIN results b ON n.pu = b.pu WHERE n.election = 'cur' AND b.election = 'base'")
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).select("pu", "election", "status")
    before = rows.filter("election = 'base'").select("pu", F.col("status").alias("before"))
    return rows.filter("election = 'cur'").join(before, "pu").select("pu", F.col("status").alias("now"), "before")


@query("H3_review_queue", "SELECT id, pu FROM (SELECT o_orderkey id, o_custkey pu, o_orderdate t FROM orders WHERE o_orderkey % 20 = 19) ORDER BY t, id LIMIT 100", False)
def _(spark, sf_dir):
    return fixture.submissions(spark, sf_dir).filter("not approved").orderBy("submitted_at", "id").limit(100).select("id", "pu")


@query("C11_public_rows", "SELECT id, pu, election FROM raw")
def _(spark, sf_dir):
    return fixture.submissions(spark, sf_dir).filter("approved").select("id", "pu", "election")


@query("O6_tumbling_counts", "SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT started, count(*)::BIGINT n FROM events GROUP BY 1, 2", False)
def _(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp(F.col("w.start")).alias("started"), "n")


@query("E15_party_totals", "SELECT state::VARCHAR code, party, sum(n)::BIGINT n FROM votes GROUP BY GROUPING SETS ((state, party), (party))")
def _(spark, sf_dir):
    rows = _live(spark, sf_dir).filter("votes is not null").select("state", F.explode("votes").alias("party", "n"))
    return rows.groupingSets([["state", "party"], ["party"]], "state", "party").agg(F.sum("n").alias("n")).select(F.col("state").cast("string").alias("code"), "party", "n")


@query("E16_dashboard", ", t AS (SELECT party, sum(n)::BIGINT votes FROM votes GROUP BY 1), s AS (SELECT *, votes::DOUBLE / sum(votes) OVER () share FROM t) SELECT party, votes, round(share * 100, 6) support_pct, floor(share * 469 + 0.5)::BIGINT seats FROM s")
def _(spark, sf_dir):
    rows = _live(spark, sf_dir).filter("votes is not null").select(F.explode("votes").alias("party", "n"))
    return divergence.dashboard(rows, 469).select("party", "votes", F.round("support_pct", 6).alias("support_pct"), "seats")


_ALTERED = ", d AS (SELECT state, lga, ward, party, sum(n)::BIGINT computed, sum(CASE WHEN party = 'A' AND pu % 25 = 3 THEN 7 ELSE 0 END)::BIGINT difference FROM votes WHERE status IN ('consensus', 'single_source', 'inec_confirmed') GROUP BY 1, 2, 3, 4)"


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows as a forged collation would have them: seven more votes for A in some units."""
    more = F.when(F.col("pu") % 25 == 3, 7).otherwise(0)
    forged = F.transform_values("votes", lambda k, v: v + F.when(k == "A", more).otherwise(0))
    return _live(spark, sf_dir).withColumn("votes", forged)


@query("M36_divergence", _ALTERED + """, t AS (SELECT lga::VARCHAR code, party, sum(computed + difference)::BIGINT declared, sum(computed)::BIGINT computed, sum(difference)::BIGINT difference FROM d GROUP BY 1, 2),
c AS (SELECT lga::VARCHAR code, 100.0::DOUBLE * count(*) FILTER (status <> 'no_data') / count(*) x FROM live GROUP BY 1)
SELECT t.*, CASE WHEN round(x, 2) < 30 THEN 'insufficient' WHEN round(x, 2) < 50 THEN 'early' WHEN round(x, 2) < 75 THEN 'significant' WHEN round(x, 2) < 90 THEN 'strong' ELSE 'verified' END tier FROM t JOIN c USING (code) WHERE difference <> 0""")
def _(spark, sf_dir):
    used = ("consensus", "single_source", "inec_confirmed")
    live = _live(spark, sf_dir)
    return divergence.divergences(rollups.party_totals(_declared(spark, sf_dir), "lga", used), rollups.party_totals(live, "lga", used), rollups.coverage(live, "lga"))


@query("M36_localised", _ALTERED + " SELECT CASE WHEN lga IS NULL THEN 'state' WHEN ward IS NULL THEN 'lga' ELSE 'ward' END \"level\", state, lga, ward, party, sum(difference)::BIGINT difference FROM d GROUP BY GROUPING SETS ((party, state, lga, ward), (party, state, lga), (party, state)) HAVING sum(difference) <> 0")
def _(spark, sf_dir):
    live = written(_live(spark, sf_dir), "live")
    more = F.when((F.col("party") == "A") & (F.col("pu") % 25 == 3), 7).otherwise(0)
    rows = live.filter(F.col("status").isin(*divergence.COUNTED)).select("state", "lga", "ward", F.explode("votes").alias("party", "n"), "pu").withColumn("n", F.col("n") + more)
    sets = [["party", *divergence.PATH[:depth]] for depth in (1, 2, 3)]
    forms = rows.groupingSets(sets, "party", "state", "lga", "ward").agg(F.sum("n").alias("n")).withColumns({"pu": F.lit(None).cast("long"), "own": F.lit(None).cast("boolean")})
    return divergence.localise(divergence.compared(forms, live)).filter("level <> 'pu'").select("level", "state", "lga", "ward", "party", "difference")


@query("J7_reconcile", """SELECT c_custkey::VARCHAR source_id, CASE WHEN c_custkey % 5 = 1 THEN 'qqqqqqqq' ELSE n_name END lga, CASE WHEN c_custkey % 5 = 2 THEN 'zzzz' WHEN c_custkey % 5 = 3 THEN c_mktsegment || ' Ward' ELSE c_mktsegment END ward,
  CASE WHEN c_custkey % 5 IN (1, 2) AND c_custkey % 7 <> 0 THEN NULL ELSE concat(c_nationkey, '-', c_mktsegment) END ward_code, (CASE WHEN c_custkey % 5 IN (1, 2) AND c_custkey % 7 <> 0 THEN 0 ELSE 1 END)::DOUBLE confidence,
  CASE WHEN c_custkey % 7 = 0 THEN 'override' WHEN c_custkey % 5 = 1 THEN 'no_lga' WHEN c_custkey % 5 = 2 THEN 'no_ward' ELSE 'exact' END reason FROM customer JOIN nation ON c_nationkey = n_nationkey""", False)
def _(spark, sf_dir):
    """Wards under their own and under wrong names against the register of nations and segments; every seventh is overridden."""
    k = F.col("c_custkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("ward_code", F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    register = rows.select(F.concat(F.lit("R"), "n_regionkey").alias("state_code"), F.lit("").alias("state"), F.col("n_name").alias("lga"), "ward_code", F.col("c_mktsegment").alias("ward")).distinct()
    ward = F.when(k % 5 == 2, "zzzz").when(k % 5 == 3, F.concat("c_mktsegment", F.lit(" Ward"))).otherwise(F.col("c_mktsegment"))
    features = rows.select(k.cast("string").alias("source_id"), F.concat(F.lit("r"), "n_regionkey").alias("state_code"), F.lit("").alias("state"), F.when(k % 5 == 1, "qqqqqqqq").otherwise(F.col("n_name")).alias("lga"), ward.alias("ward"), F.lit(None).cast("string").alias("alt"))
    overrides = rows.filter(k % 7 == 0).select(k.cast("string").alias("source_id"), "ward_code")
    return reconcile.reconcile(features, register, overrides).drop("state")


@query("M11_label_field", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pu_code' WHEN 1 THEN 'registered_voters' WHEN 2 THEN 'rejected_ballots' WHEN 3 THEN 'total_votes_cast' END field FROM events", False)
def _(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("Polling Unit Code", "TOTAL REGISTERED voters", "Rejected votes", "Total ballot cast", "remarks"))), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", intake.field_of(label).alias("field"))


@query("M16_roster", """SELECT line, CASE WHEN line % 13 = 0 THEN 'name is empty' WHEN line % 11 = 0 THEN 'language is unknown' WHEN line % 7 = 0 THEN 'phone is invalid' WHEN row_number() OVER (PARTITION BY u, line % 13 = 0 OR line % 11 = 0 OR line % 7 = 0 ORDER BY line) > 1 THEN 'phone is duplicated' END error
FROM (SELECT event_id line, user_id u FROM events)""", False)
def _(spark, sf_dir):
    line = F.col("event_id")
    number = F.concat(F.lit("0803 "), F.lpad(F.col("user_id").cast("string"), 7, "0"))
    rows = _events(spark, sf_dir).select(line.alias("line"), F.when(line % 13 != 0, "A B").alias("name"), F.when(line % 7 == 0, "12").otherwise(number).alias("phone"), F.lit("01-02").alias("pu_code"), F.when(line % 11 == 0, "fr").otherwise("EN ").alias("language"))
    return intake.roster(rows, ("en", "ha", "yo", "ig", "pcm")).select("line", "error")


@query("B11_hash_manifest", "SELECT o_orderkey id, o_custkey pu, CASE WHEN o_orderkey % 10 <= 4 THEN 'P' || (o_orderkey % 4) ELSE '' END party, sha256(o_orderkey::VARCHAR) sha256, epoch(o_orderdate)::BIGINT submitted_at FROM orders", False)
def _(spark, sf_dir):
    rows = fixture.submissions(spark, sf_dir).withColumn("sha256", F.sha2(F.col("id").cast("string"), 256))
    return files.hash_manifest(rows).withColumn("submitted_at", F.unix_timestamp("submitted_at"))


from . import access, boards, details, extraction, maps, places, registers, streams  # noqa: E402, F401  their queries join these
