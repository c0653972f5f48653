"""Sanity, peer-distribution and historical checks; each gives rows pu, anomaly_type, severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import distribution


def _hits(rows: DataFrame, checks: list) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("anomaly_type"), F.lit(sev).cast("long").alias("severity"))) for name, cond, sev in checks)))
    return rows.select("pu", F.inline(found))


def sanity(live: DataFrame) -> DataFrame:
    """Checks of one form against itself and the register."""
    c = F.col
    top = F.array_max(F.map_values("votes"))
    return _hits(live.filter("votes is not null"), [
        ("votes_exceed_registered", (c("registered") > 0) & (c("cast") > c("registered")), 5),
        ("turnout_exceeds_accreditation", (c("accredited") > 0) & (c("cast") > c("accredited")), 5),
        ("rejected_exceeds_cast", (c("rejected") > c("cast")) & (c("cast") > 0), 5),
        ("cast_zero_but_votes_recorded", (c("cast") == 0) & (c("valid") > 0), 5),
        ("zero_registered_voters", c("registered") == 0, 4),
        ("leader_extreme_share", (c("valid") > 30) & (top / F.when(c("valid") > 0, c("valid")) >= 0.97), 4),
    ])


def turnout_outliers(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Units whose turnout is far from their ward's, or from the local government's where the ward's is unusable."""
    ward = distribution(rows, "ward", 5).select("ward", F.col("mean").alias("wm"), F.col("sd").alias("ws"))
    lga = distribution(rows, "lga", 10).select("lga", F.col("mean").alias("lm"), F.col("sd").alias("ls"))
    both = verified.join(ward, "ward", "left").join(lga, "lga", "left")
    usable = F.coalesce(F.col("ws") > 0, F.lit(False))
    zw, zl = F.abs(F.col("turnout") - F.col("wm")) / F.when(F.col("ws") > 0, F.col("ws")), F.abs(F.col("turnout") - F.col("lm")) / F.when(F.col("ls") > 0, F.col("ls"))
    return _hits(both, [
        ("turnout_outlier_ward", usable & (zw >= 5), 5), ("turnout_outlier_ward", usable & (zw >= 4) & (zw < 5), 4), ("turnout_outlier_ward", usable & (zw >= 3) & (zw < 4), 3),
        ("turnout_outlier_lga", ~usable & (zl >= 4), 4), ("turnout_outlier_lga", ~usable & (zl >= 3) & (zl < 4), 3),
    ])


def historical(now: DataFrame, before: DataFrame) -> DataFrame:
    """Shifts of turnout, and of the leading party's share, against the baseline election (points, subtracted first)."""
    b = before.select("pu", F.col("turnout").alias("t0"), F.col("leader").alias("l0"), F.col("leader_share").alias("s0"))
    rows = now.join(b, "pu")
    t, s = F.abs(F.col("turnout") - F.col("t0")) * 100, F.abs(F.col("leader_share") - F.col("s0")) * 100
    other = F.col("leader") != F.col("l0")
    return _hits(rows, [
        ("turnout_shift", t >= 70, 5), ("turnout_shift", (t >= 50) & (t < 70), 4), ("turnout_shift", (t >= 40) & (t < 50), 3),
        ("leader_party_shift", other & (s >= 70), 5), ("leader_party_shift", other & (s >= 50) & (s < 70), 4),
    ])


def insert_ignore(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found that existing lacks by key, nulls equal."""
    key = ["election", "pu", "anomaly_type", "submission_id"]
    other = existing.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return found.dropDuplicates(key).join(other, cond, "left_anti")
