"""Checks and counts of a flat roster before it is loaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registers import code_parts


def collisions(rows: DataFrame, code: str = "code", owner: str = "state") -> DataFrame:
    """code, owners: codes that more than one owner claims, the owners in order. Malformed codes claim nothing.

    A code gathers owners, not rows: as many as there are states at most, and repeats are dropped before the shuffle.
    """
    claims = rows.filter(code_parts(F.col(code)).isNotNull() & F.col(owner).isNotNull()).groupBy(F.col(code).alias("code"))
    return claims.agg(F.array_sort(F.collect_set(owner)).alias("owners")).filter(F.size("owners") > 1)


def preflight(rows: DataFrame, known: Sequence[str], code: str = "code", owner: str = "state") -> DataFrame:
    """One row: units, codes, collisions, unknown (names of owners that are not known, in order), verdict.

    Units of unknown states and units with malformed codes do not count. The verdict is unknown_state before collision, else ok;
    an empty roster is ok.
    """
    right = F.col("known") & F.col("right")
    marked = rows.select(F.col(code).alias("code"), F.col(owner).alias("owner"), F.coalesce(F.col(owner).isin(*known), F.lit(False)).alias("known"), code_parts(F.col(code)).isNotNull().alias("right"))
    each = marked.groupBy(F.when(right, F.col("code")).alias("code")).agg(
        F.count_if(right).alias("units"), F.collect_set(F.when(right, F.col("owner"))).alias("owners"), F.collect_set(F.when(~F.col("known"), F.coalesce("owner", F.lit("")))).alias("unknown")
    )
    row = each.agg(
        F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"), F.count("code").alias("codes"), F.count_if(F.size("owners") > 1).alias("collisions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("unknown")))).alias("unknown"),
    )
    return row.withColumn("verdict", F.when(F.size("unknown") > 0, "unknown_state").when(F.col("collisions") > 0, "collision").otherwise("ok"))


def counts(rows: DataFrame, code: str = "code") -> DataFrame:
    """state, lgas, wards, pus, skipped of each state, and their totals under a null state. Rows with malformed codes are skipped.

    rows: state (not null), lga, ward, code. A local government or ward whose units are all skipped still counts.
    """
    right = code_parts(F.col(code)).isNotNull()
    wards = rows.groupBy("state", "lga", "ward").agg(F.count_if(right).alias("pus"), F.count_if(~right).alias("skipped"))
    lgas = wards.groupBy("state", "lga").agg(F.count("*").alias("wards"), F.sum("pus").alias("pus"), F.sum("skipped").alias("skipped"))
    return lgas.rollup("state").agg(F.count("*").alias("lgas"), *(F.sum(c).alias(c) for c in ("wards", "pus", "skipped")))
