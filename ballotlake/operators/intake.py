"""Rosters, feed entries and form labels brought into the types of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.current import Current, written

#: Form fields and the patterns of their labels, the first that fits wins.
LABELS = (
    ("pu_code", "polling.?unit.?code|pu.?code"),
    ("registered_voters", "registered.?voters|total.?registered"),
    ("accredited_voters", "accredited.?voters|total.?accredited"),
    ("total_valid_votes", "total.?valid.?votes|valid.?votes"),
    ("rejected_ballots", "rejected.?(ballots|votes)"),
    ("total_votes_cast", "total.?(votes|ballot).?cast|votes.?cast"),
)


def field_of(label: Column) -> Column:
    """The form field that a label names; null if none."""
    return F.coalesce(*(F.when(F.lower(label).rlike(pattern), name) for name, pattern in LABELS))


def phone(text: Column) -> Column:
    """A Nigerian mobile number as +234 and ten digits; null if it is none. An approximation by pattern."""
    bare = F.regexp_replace(text, r"[\s().-]", "")
    return F.when(bare.rlike(r"^(\+?234|0)[789]\d{9}$"), F.concat(F.lit("+234"), F.right(bare, F.lit(10))))


def roster(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """line, name, phone, pu_code, language and error (null: fine) of roster rows; null counts as empty.

    Checks go in order: name, unit, language, phone, and a phone that an earlier fine line holds.
    """
    c = F.col
    said = [F.trim(F.coalesce(c(x), F.lit(""))).alias(x) for x in ("name", "phone", "pu_code")]
    language = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    read = rows.select("line", *said, F.when(language == "", "en").otherwise(language).alias("language")).withColumn("number", phone(c("phone")))
    error = F.when(c("name") == "", "name is empty").when(c("pu_code") == "", "pu_code is empty").when(~c("language").isin(*languages), "language is unknown").when(c("number").isNull(), "phone is invalid")
    read = read.withColumn("error", error)
    # only fine lines can be duplicates; the others go by their own line, so that no phone gathers them
    nth = F.row_number().over(Window.partitionBy("number", F.when(F.col("error").isNull(), F.lit(-1)).otherwise(F.col("line"))).orderBy("line"))
    twice = F.when(F.col("error").isNull() & (nth > 1), "phone is duplicated")
    return read.withColumn("error", F.coalesce("error", twice)).select("line", "name", F.coalesce("number", "phone").alias("phone"), "pu_code", "language", "error")


def feed(entries: DataFrame) -> DataFrame:
    """The entries that have a unit and a document: pu_code, image_url, document_size, submitted_at, is_zero_pu, state_id.

    A missing time of the result falls back to the time of the entry's last change; times are ISO texts in UTC.
    """
    c = F.col
    at = F.when(c("result_updated_time") > 0, F.date_format(F.timestamp_millis("result_updated_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(c("updated_at"))
    kept = entries.filter((F.coalesce("pu_code", F.lit("")) != "") & (F.coalesce("document.url", F.lit("")) != ""))
    return kept.select("pu_code", c("document.url").alias("image_url"), c("document.size").alias("document_size"), at.alias("submitted_at"), F.coalesce("is_zero_pu", F.lit(False)).alias("is_zero_pu"), c("state").alias("state_id"))


def _outcomes(rows: DataFrame, agents: DataFrame, units: DataFrame) -> DataFrame:
    known = agents.select("phone", F.lit(True).alias("known")).distinct()
    there = units.select("pu_code", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("known"), "skipped").when(F.col("there").isNull(), "unknown_unit").otherwise("inserted")
    fine = rows.filter("error is null").join(known, "phone", "left").join(there, "pu_code", "left")
    return fine.withColumn("outcome", outcome)


def apply_roster(rows: DataFrame, agents: DataFrame, units: DataFrame) -> DataFrame:
    """phone, pu_code and outcome of fine roster rows: skipped (the phone is known), else unknown_unit or inserted."""
    return _outcomes(rows, agents, units).select("phone", "pu_code", "outcome")


def load_roster(rows: DataFrame, agents: Current, units: DataFrame, party: str, actor: str, now: Column) -> tuple[dict[str, int], DataFrame]:
    """Put all new agents of a roster (see roster) into agents (phone, name, pu_code, language, party), or none.

    Gives the counts of inserted and skipped rows, and the events of the inserted. A row whose phone is new and whose unit is
    not in the register ends the load before anything is written; the error names the first such line.
    """
    known = agents.read()
    known = known if known is not None else rows.select("phone").limit(0)
    found = written(_outcomes(rows, known, units).select("line", "phone", "name", "pu_code", "language", "outcome"), "roster")
    wrong = found.filter("outcome = 'unknown_unit'").agg(F.min(F.struct("line", "pu_code")).alias("first")).first()["first"]
    if wrong is not None:
        raise ValueError(f"unknown_pu: polling unit {wrong['pu_code']} not in registry (line {wrong['line']})")
    counts = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
    new = found.filter("outcome = 'inserted'").select("phone", "name", "pu_code", "language", F.lit(party).alias("party"))
    agents.upsert(new)
    from .events import of_agents  # events reads this module's labels

    return {k: counts.get(k, 0) for k in ("inserted", "skipped")}, of_agents(new.withColumns({"actor": F.lit(actor), "loaded_at": now}))
