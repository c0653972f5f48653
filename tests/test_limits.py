"""Windows of time whose edge lies within a second."""

import datetime as dt

import duckdb

from ballotlake.plans import catalog


def test_rate_limit_rounds_seconds_as_its_sql(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = [(0.4, 86400.3), (0.6, 86401.4), (0.6, 86400.4), (0.5, 86400.9), (1.5, 86402.2), (0.2, 86400.6)]
    rows = [(2 * user + k, user, start + dt.timedelta(seconds=s)) for user, pair in enumerate(at) for k, s in enumerate(pair)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(path)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT event_id, user_id, ts::TIMESTAMP ts FROM '{path}/*.parquet'")
    found = {tuple(r) for r in catalog.QUERIES["G7_rate_limit"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(catalog.ORACLE["G7_rate_limit"]).fetchall())
