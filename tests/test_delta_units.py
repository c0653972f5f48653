"""Totals by deltas over many units, and batches that stop half way."""

import time

import pytest
from pyspark.sql import functions as F

from ballotlake.sources.current import Current
from ballotlake.streaming import deltas

from .test_streaming import RESULT, rows_of


def test_many_units_cost_little_each(spark, tmp_path):
    pu = F.col("id")
    rows = spark.range(40_000).select(F.lit("e").alias("election"), pu.alias("pu"), F.lit(1).cast("long").alias("seq"), F.lit("consensus").alias("status"), F.create_map(F.lit("A"), F.lit(2).cast("long")).alias("votes"), (pu % 3).alias("state"), (pu % 6).alias("lga"), F.lit("w").alias("ward"))
    rows.write.parquet(f"{tmp_path}/in")
    start = time.monotonic()
    deltas.start(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/totals", f"{tmp_path}/cp").awaitTermination()
    assert time.monotonic() - start < 25
    totals = Current(spark, f"{tmp_path}/totals", deltas.TOTAL_KEY).read()
    assert rows_of(totals.filter("state is null"), "party", "n", "units") == [("A", 80_000, 40_000)]


def test_a_batch_that_stops_after_the_totals_counts_once(spark, tmp_path, monkeypatch):
    def put(rows):
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        deltas.start(spark.readStream.schema(RESULT).parquet(f"{tmp_path}/in"), f"{tmp_path}/totals", f"{tmp_path}/cp").awaitTermination()

    put([("e", 1, 1, "consensus", {"A": 5}, 1, 1, "w"), ("e", 1, 2, "consensus", {"A": 6}, 1, 1, "w"), ("e", 2, 1, "consensus", {"A": 1}, 1, 1, "w")])
    run()
    put([("e", 1, 3, "consensus", {"A": 2}, 1, 1, "v")])
    upsert = Current.upsert

    def stops(table, *args, **kwargs):
        if kwargs.get("tag", ("",))[0] == "units":
            raise RuntimeError("stopped")
        return upsert(table, *args, **kwargs)

    monkeypatch.setattr(Current, "upsert", stops)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.setattr(Current, "upsert", upsert)
    run()
    put([("e", 1, 2, "consensus", {"A": 9}, 1, 1, "w")])
    run()
    totals = Current(spark, f"{tmp_path}/totals", deltas.TOTAL_KEY).read().filter("units > 0 and ward is not null")
    assert rows_of(totals, "ward", "n", "units") == [("v", 2, 1), ("w", 1, 1)]
