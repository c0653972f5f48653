"""Steps that read their input once, or deal a large group over tasks."""

from pyspark.sql import functions as F

from ballotlake.operators import access, detail, rollups
from ballotlake.streaming import recompute

from .test_consensus_growth import records


def marked(df, name):
    """df as a shuffle of its own, so that a second evaluation would show in the plan."""
    return df.repartition(3, name)


def scans(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_state_rollup_reads_results_once(spark):
    units = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "pu long, state long")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "state long, name string")
    results = spark.createDataFrame([("e", 1, "consensus", {"A": 5}), ("e", 2, "inec_confirmed", None), ("e", 3, "discrepancy", {"A": 9})], "election string, pu long, status string, votes map<string,long>")
    rows = rollups.state_rollup(units, marked(results, "pu").filter("pu > 0"), names)
    assert scans(rows, "RepartitionByExpression") == 1
    assert sorted((r.state, r.units_reporting, r.units_total, r.units_consensus, r.party_totals) for r in rows.collect()) == [(1, 2, 2, 1, '{"A":5}'), (2, 1, 1, 0, None)]


def test_a_page_of_discrepancies_computes_them_once(spark):
    found = spark.createDataFrame([("e", 1, 5, 10, [3, 2]), ("e", 2, 3, 11, [9]), ("e", 3, 3, 9, [])], "election string, pu long, severity long, detected_at long, conflicting array<long>")
    units = spark.createDataFrame([(k, 1, 1, "w") for k in (1, 2, 3)], "pu long, state long, lga long, ward string")
    forms = spark.createDataFrame([(k, "observer", None, {"A": k}, 0) for k in (2, 3, 4)], "id long, source_type string, party string, votes map<string,long>, submitted_at long")
    rows = detail.discrepancy_register(marked(found, "pu"), units, forms, most=2)
    assert scans(rows, "RepartitionByExpression") == 1
    got = {r.pu: (r.severity, r.ward, None if r.submissions is None else [s.submission_id for s in r.submissions]) for r in rows.collect()}
    assert got == {1: (5, "w", [2, 3]), 2: (3, "w", None)}


def test_agents_of_one_party_are_dealt(spark):
    k = F.col("id")
    agents = spark.range(20_000).select(k.cast("string").alias("id"), F.when(k < 50, "party_admin").otherwise("party_agent").alias("role"), F.lit("P").alias("party")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = access.party_agents(agents)
        sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1_000_000 and max(sizes) < 500_000


def test_touched_forms_are_computed_once(spark, tmp_path):
    from ballotlake.sources.current import Current

    history = Current(spark, f"{tmp_path}/h", ["election", "pu", "id"], 2)
    batch = spark.createDataFrame([("e", k % 5, k, "x") for k in range(100)], "election string, pu long, id long, v string")
    forms = recompute.touched_history(batch, history, 0)
    assert "Join" not in forms._jdf.queryExecution().optimizedPlan().toString()
    before = records(spark)
    assert forms.count() == 100 and forms.distinct().count() == 100
    assert records(spark) - before < 250
