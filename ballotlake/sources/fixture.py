"""An election derived from the star-schema tables: units from customers, submissions from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pu, state, lga, ward, registered of every polling unit."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    pu = F.col("c_custkey")
    registered = F.when(pu % 41 == 0, 0).when(pu % 37 == 0, 50).otherwise(4600 + pu % 400)
    return (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(pu.cast("long").alias("pu"), F.col("n_regionkey").cast("long").alias("state"), F.col("c_nationkey").cast("long").alias("lga"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("ward"), registered.cast("long").alias("registered"))
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a result form: id, pu, election, submitted_at, source_type, party, approved, the form's fields and a votes map."""
    k, pu = F.col("o_orderkey"), F.col("o_custkey")
    current = F.year("o_orderdate") >= 1998
    kind = F.when(k % 10 <= 4, "party_agent").when(k % 10 <= 6, "observer").otherwise("official")
    shift = F.when(pu % 5 == 0, k % 7).when((pu % 5 == 1) & (k % 10 >= 7), 9).otherwise(0)
    a = F.when(current, 1).otherwise(3) * (pu % 50) + 10 + shift
    b, c = pu * 7 % 120 + 5, F.when(pu % 97 == 0, 4000).otherwise(pu * 13 % 90)
    row = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.cast("long").alias("id"), pu.cast("long").alias("pu"), F.when(current, "cur").otherwise("base").alias("election"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"), kind.alias("source_type"),
        F.when(k % 10 <= 4, F.concat(F.lit("P"), (k % 4).cast("string"))).alias("party"), (k % 20 != 19).alias("approved"),
        F.create_map(F.lit("A"), a.cast("long"), F.lit("B"), b.cast("long"), F.lit("C"), c.cast("long")).alias("votes"), (a + b + c).cast("long").alias("valid"),
    )
    return row.select("*", F.lit(12).cast("long").alias("rejected"), (F.col("valid") + 12).alias("cast"), (F.col("pu") % 50 + 300).alias("accredited"), (4600 + F.col("pu") % 400).alias("registered_voters"), F.when(F.col("pu") % 23 == 0, F.col("id") % 2 == 0).otherwise(True).alias("presiding_officer_signed"), F.lit(True).alias("official_stamp_present"), (F.col("id") % 3).alias("agent_signatures"))
