"""Whole registers of anomalies and discrepancies, and all that is known of a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anomaly, registers, rollups
from .consensus import VERIFIED

PLACE = ["pu", "state", "lga", "ward"]


def anomalies(live: DataFrame, base: DataFrame) -> DataFrame:
    """pu, anomaly_type, severity of all layers: sanity, peers' turnout, peers' leader share, and shifts against the base election.

    live and base: units with their results in this and the election before (see rollups.live_status).
    """
    turned = rollups.turnout(live)
    now = turned.filter(F.col("status").isin("consensus", "inec_confirmed"))
    layers = [
        anomaly.sanity(live), anomaly.turnout_outliers(turned, turned.filter(F.col("status").isin(*VERIFIED))),
        registers.leader_outliers(turned).drop("details"), anomaly.historical(now, rollups.turnout(base)),
    ]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def anomaly_register(units: DataFrame, found: DataFrame) -> DataFrame:
    """found (pu, anomaly_type, severity) with each unit's place; hits of unknown units are left out."""
    return units.select(*PLACE).join(found, "pu")


def in_conflict(found: DataFrame, submissions: DataFrame) -> DataFrame:
    """found (election, pu, conflicting: ids, any others) as a row for each id that is a submission, with its form.

    submission_id, source, party, votes, submitted_at. Ids are joined one by one and never gathered, so a unit with a large
    share of all forms is no large row; an id that is no submission gives no row.
    """
    ids = found.withColumn("submission_id", F.explode("conflicting")).drop("conflicting")
    forms = submissions.select(F.col("id").alias("submission_id"), F.col("source_type").alias("source"), "party", "votes", "submitted_at")
    return ids.join(forms, "submission_id")


def discrepancy_register(found: DataFrame, units: DataFrame, submissions: DataFrame, most: int = 500) -> DataFrame:
    """The most severe and newest discrepancies (election, pu, severity, detected_at, conflicting), at most so many, with place and submissions as an array by id.

    The page is chosen before anything is gathered, so what is gathered are the forms of its units.
    """
    page = found.orderBy(F.desc("severity"), F.desc("detected_at"), "election", "pu").limit(most)
    rest = [c for c in page.columns if c not in ("election", "pu", "conflicting")]
    forms = submissions.select(F.struct(F.col("id").alias("submission_id"), F.col("source_type").alias("source"), "party", "votes", "submitted_at").alias("form"))
    # what is found is computed once: the page carries its own columns to the forms and back
    ids = page.withColumn("submission_id", F.explode_outer("conflicting")).drop("conflicting")
    named = ids.join(forms, F.col("submission_id") == F.col("form.submission_id"), "left")
    by_id = lambda a, b: F.when(a["submission_id"] < b["submission_id"], -1).when(a["submission_id"] > b["submission_id"], 1).otherwise(0)
    gathered = named.groupBy("election", "pu").agg(*(F.first(c).alias(c) for c in rest), F.array_sort(F.collect_list("form"), by_id).alias("submissions"))
    out = gathered.withColumn("submissions", F.when(F.size("submissions") > 0, F.col("submissions"))).join(units.select(*PLACE), "pu")
    return out.select("election", "pu", *rest, *PLACE[1:], "submissions")


def of_units(wanted: DataFrame, live: DataFrame, submissions: DataFrame, found: DataFrame, log: DataFrame, events: int = 50) -> DataFrame:
    """pu, section, key, body (JSON) of all that is known of the wanted units (pu): a row for each thing.

    Sections: unit (status and counts), submission (approved ones, by id), anomaly (by type), audit (the last events whose data
    name the unit, by seq, so many a unit), manifest (hashes of the approved submissions' images). Unknown units give none.
    A reader of one unit sorts its few rows; nothing is gathered by unit here.
    """
    text = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    section = lambda rows, name, key, *body: rows.select("pu", F.lit(name).alias("section"), key.cast("string").alias("key"), text(*body).alias("body"))
    here = lambda rows: rows.join(wanted.select("pu").distinct(), "pu", "left_semi")
    known = here(live)
    forms = here(submissions.filter("approved"))
    forms = forms.join(known.select("pu"), "pu", "left_semi")
    named = here(log.withColumn("pu", F.get_json_object("event_data", "$.pu_code").try_cast("long")))
    last = named.withColumn("place", F.row_number().over(Window.partitionBy("pu").orderBy(F.desc("seq")))).filter(F.col("place") <= events)
    parts = [
        section(known, "unit", F.col("pu"), "status", F.coalesce("submission_count", F.lit(0)).alias("submission_count"), F.coalesce("source_count", F.lit(0)).alias("source_count")),
        section(forms, "submission", F.col("id"), "source_type", "party", "valid"), section(forms, "manifest", F.col("id"), "image_sha256"),
        section(here(found), "anomaly", F.col("anomaly_type"), "severity"), section(last, "audit", F.col("seq"), "event_type"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
