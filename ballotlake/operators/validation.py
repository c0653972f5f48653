"""Checks of uploads and forms, and the guards of review, retry, device and one-time-code decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALLEST, LARGEST = 60_000, 12_000_000


#: Software whose name in a picture's metadata speaks for an edit.
EDITORS = ("photoshop", "gimp", "snapseed", "lightroom", "facetune", "pixelmator")


def exif(data: Column, election_day: str | None = None) -> Column:
    """Struct exif_present, exif_integrity_ok, exif_software_warning, exif_datetime_mismatch of a map of metadata.

    Without metadata nothing else is checked. A date that cannot be read is no mismatch, but spoils integrity.
    """
    present = F.coalesce(F.size(data) > 0, F.lit(False))
    name = F.lower(F.coalesce(F.try_element_at(data, F.lit("Software")), F.lit("")))
    edited = F.lit(False)
    for e in EDITORS:
        edited = edited | name.contains(e)
    said = F.nullif(F.try_element_at(data, F.lit("DateTimeOriginal")), F.lit("")) if election_day else F.lit(None).cast("string")
    at = F.try_to_timestamp(said, F.lit("yyyy:MM:dd HH:mm:ss"))
    moved = F.coalesce(F.abs(F.datediff(at, F.lit(election_day).cast("date"))) > 1, F.lit(False))
    unread = said.isNotNull() & at.isNull()
    return F.struct(present.alias("exif_present"), (present & ~edited & ~moved & ~unread).alias("exif_integrity_ok"), (present & edited).alias("exif_software_warning"), (present & moved).alias("exif_datetime_mismatch"))


def ingestion(uploads: DataFrame, soft: float = 100, hard: float = 2000, election_day: str | None = None) -> DataFrame:
    """verdict and flags of each upload (id, sha256, image_bytes, metres, source_type, election, pu, party, submitted_at, and a map exif if there is one).

    Rules go in order and the first that rejects is the only flag. A party's later form for one election and unit is a
    duplicate of one that passed the other rules, as rejected ones are not stored. Null metres: no position was sent.
    """
    c = F.col
    reject = F.when(~c("sha256").rlike("^[0-9a-f]{64}$"), "hash_malformed").when(c("image_bytes") > LARGEST, "image_too_large").when(c("metres") > hard, "gps_violation")
    rows = uploads.withColumn("reject", reject)
    # forms that cannot be duplicates go by their own id, so that no unit gathers them
    party = c("reject").isNull() & (c("source_type") == "party_agent")
    nth = F.row_number().over(Window.partitionBy("election", "pu", "party", F.when(party, F.lit(-1)).otherwise(c("id"))).orderBy("submitted_at", "id"))
    rows = rows.withColumn("reject", F.coalesce("reject", F.when(party & (nth > 1), "duplicate_party_submission")))
    checked = []
    if "exif" in uploads.columns:
        e = exif(c("exif"), election_day)
        checked = [F.when(~e["exif_present"], "exif_missing"), F.when(e["exif_software_warning"], "exif_software_warning"), F.when(e["exif_datetime_mismatch"], "exif_datetime_mismatch")]
    flags = F.concat_ws(",", F.when(c("image_bytes") < SMALLEST, "image_too_small"), F.when(c("metres").isNull(), "gps_missing").when(c("metres") > soft, "gps_warning"), *checked)
    return rows.select("id", F.when(c("reject").isNull(), "accepted").otherwise("rejected").alias("verdict"), F.coalesce("reject", F.when(flags == "", "ok").otherwise(flags)).alias("flags"))


def arithmetic(forms: DataFrame) -> Column:
    """Names of the sums that do not hold in a form, joined by commas."""
    c = F.col
    votes = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.concat_ws(
        ",", F.when(votes != c("valid"), "candidate_votes_sum_neq_total_valid"), F.when(c("valid") + c("rejected") != c("cast"), "valid_plus_rejected_neq_cast"),
        F.when(c("cast") > c("accredited"), "cast_exceeds_accredited"), F.when(c("accredited") > c("registered"), "accredited_exceeds_registered"),
    )


def review(action: Column, status: Column, reason: Column) -> Column:
    """The new review status, or what forbids the step."""
    return (
        F.when((action == "reject") & (F.coalesce(reason, F.lit("")) == ""), "error: reject requires a reason").when(status != "pending_review", "error: not pending_review")
        .when(action == "approve", "reviewed_accepted").otherwise("reviewed_rejected")
    )


def device(stored: Column, shown: Column) -> Column:
    return F.when(stored.isNull(), "first_login").when(stored == shown, "same_device").otherwise("denied")


def one_time_code(consumed: Column, expired: Column, attempts: Column, matches: Column) -> Column:
    return F.when(consumed, "consumed").when(expired, "expired").when(attempts >= 5, "too_many_attempts").when(~matches, "mismatch").otherwise("ok")


def approval(confidence: Column, failures: Column) -> Column:
    return F.when((confidence >= 0.85) & (failures == ""), "auto_approved").otherwise("pending_review")


def kebab(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def whole_number(text: Column) -> Column:
    """Digits and minus signs of a text as a number; 0 for none, null if they make no number."""
    kept = F.regexp_replace(text, r"[^\d-]", "")
    return F.when(kept == "", F.lit(0).cast("long")).otherwise(kept.try_cast("long"))
