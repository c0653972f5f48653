"""The registered queries of visibility, roll-ups in full and files by state, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, audit, rollups
from ..sources import files, fixture
from ..sources.current import scratch
from .catalog import _results, query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT units_{s}" for s in rollups.COUNTS)
_STATES = f""", j AS (SELECT election, u.pu, state, status, a, b, c FROM units u LEFT JOIN results r ON r.pu = u.pu),
  k AS (SELECT election, state, count(*) FILTER (status <> 'no_data')::BIGINT units_reporting, count(*)::BIGINT units_total, {_COUNTS} FROM j GROUP BY 1, 2),
  s AS (SELECT election, state, concat('{{"A":', sum(a)::BIGINT, ',"B":', sum(b)::BIGINT, ',"C":', sum(c)::BIGINT, '}}') party_totals FROM j WHERE status IN ('consensus', 'inec_confirmed') GROUP BY 1, 2),
  rollup_ AS (SELECT k.election, k.state, r_name AS name, k.* EXCLUDE (election, state), party_totals FROM k JOIN region ON r_regionkey = k.state LEFT JOIN s ON s.election = k.election AND s.state = k.state)"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("state"), F.col("r_name").alias("name"))
    return rollups.state_rollup(fixture.units(spark, sf_dir), _results(spark, sf_dir), names)


@query("E4_state_rollup_rows", f"{_STATES} SELECT * FROM rollup_")
def _(spark, sf_dir):
    return _rollup(spark, sf_dir)


@query("E5_national_rollup_rows", f"{_STATES} SELECT election, sum(units_reporting)::BIGINT units_reporting, sum(units_total)::BIGINT units_total, {', '.join(f'sum(units_{s})::BIGINT units_{s}' for s in rollups.COUNTS)} FROM rollup_ GROUP BY 1")
def _(spark, sf_dir):
    """The country as the sum of its states."""
    return rollups.national_rollup(_rollup(spark, sf_dir))


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 100 == 5, "party_admin").when(k % 100 == 6, "consortium_reviewer").otherwise("party_agent")
    return _table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), role.alias("role"), F.when(k % 9 != 0, F.concat(F.lit("P"), (k % 40).cast("string"))).alias("party"))


@query("D18_party_agents", """WITH a AS (SELECT c_custkey::VARCHAR id, CASE WHEN c_custkey % 100 = 5 THEN 'party_admin' END role, CASE WHEN c_custkey % 9 <> 0 THEN concat('P', c_custkey % 40) END party FROM customer)
  SELECT x.id admin, y.id FROM a x JOIN a y USING (party) WHERE x.role = 'party_admin'""", False)
def _(spark, sf_dir):
    return access.party_agents(_agents(spark, sf_dir))


@query("C12_public_submissions", "SELECT o_orderkey id, o_custkey pu, CASE WHEN o_orderkey % 10 <= 4 THEN 'party_agent' WHEN o_orderkey % 10 <= 6 THEN 'observer' ELSE 'official' END source_type, false leaks FROM orders WHERE o_orderkey % 20 <> 19", False)
def _(spark, sf_dir):
    """Submissions without the columns that identify people; leaks tells if one is still there."""
    rows = access.public_submissions(fixture.submissions(spark, sf_dir).withColumns({c: F.lit("secret") for c in access.IDENTITY}))
    return rows.select("id", "pu", "source_type", F.lit(bool(set(access.IDENTITY) & set(rows.columns))).alias("leaks"))


@query("C14_unfinished", "SELECT o_orderkey id FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 5 IN (1, 2)", False)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    review = F.when(k % 6 == 0, "pending_review").otherwise("auto_approved")
    status = F.when(k % 5 == 1, "queued").when(k % 5 == 2, "processing").otherwise("extracted")
    return access.unfinished(_table(spark, sf_dir, "orders").select(k.alias("id"), review.alias("review_status"), status.alias("processing_status"))).select("id")


@query("C15_zoom_layer", "SELECT event_id, CASE WHEN z <= 5 THEN 'state' WHEN z <= 8 THEN 'lga' WHEN z <= 10 THEN 'ward' WHEN z <= 18 THEN 'pu' END AS layer FROM (SELECT event_id, event_id % 21 z FROM events)", False)
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", access.layer(F.col("event_id") % 21).alias("layer"))


@query("K7_hash_lookup", "SELECT e.event_id, o_orderkey id FROM events e JOIN orders ON o_orderkey = e.event_id * 3", False)
def _(spark, sf_dir):
    """Every event asks for a submission by the hash of its image, in capitals."""
    asked = _table(spark, sf_dir, "events").select("event_id", F.upper(F.sha2((F.col("event_id") * 3).cast("string"), 256)).alias("asked"))
    forms = fixture.submissions(spark, sf_dir).select("id", F.sha2(F.col("id").cast("string"), 256).alias("image_sha256"))
    return access.submissions_of(forms, asked, "asked").select("event_id", "id")


@query("B13_state_files", "SELECT CASE WHEN grouping(state) = 0 THEN state END state, count(DISTINCT lga)::BIGINT lgas, count(DISTINCT ward)::BIGINT wards, count(*)::BIGINT polling_units FROM units GROUP BY ROLLUP (state)")
def _(spark, sf_dir):
    units = fixture.units(spark, sf_dir).withColumn("name", F.concat(F.lit("Unit "), F.col("pu").cast("string")))
    return files.write_states(units, scratch(spark, "states"))


@query("A8_log_csv", "SELECT c_custkey seq, CASE WHEN c_custkey % 2 = 0 THEN 'x' END actor_id FROM customer", False)
def _(spark, sf_dir):
    """A log that is exported as CSV, with commas, quotes and line breaks in it, and read back; its links hold, as none is broken."""
    k = F.col("c_custkey")
    data = F.concat(F.lit('{"n": "a ""quoted"", \\n line", "k": '), k.cast("string"), F.lit("}"))
    data = F.replace(data, F.lit('""'), F.lit('\\"'))
    events = _table(spark, sf_dir, "customer").select(k.cast("long").alias("seq"), F.lit("e").alias("event_type"), F.lit("n").alias("entity_type"), F.col("c_name").alias("entity_id"), F.when(k % 2 == 0, "x").alias("actor_id"), F.lit("t,1").alias("event_at"), data.alias("event_data"), F.col("c_nationkey").alias("own"))
    path = scratch(spark, "log-csv")
    files.write_csv(audit.append(events.drop("own")), path)
    log = files.log_csv(spark, path)
    return log.join(audit.broken(log), "seq", "left_anti").select("seq", "actor_id")
