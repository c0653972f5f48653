"""The registered queries of forms read from documents and of names, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registers, validation
from .catalog import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_M12 = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 9 ELSE a END votes_apc, CASE WHEN event_id % 3 = 0 THEN b END votes_pdp, v valid, CASE WHEN event_id % 4 = 0 THEN 7 ELSE 0 END::BIGINT rejected, CASE WHEN event_id % 9 = 0 THEN 1000 ELSE v + CASE WHEN event_id % 4 = 0 THEN 7 ELSE 0 END END total,
  CASE WHEN event_id % 8 = 0 THEN 412 ELSE 0 END::BIGINT registered, CASE WHEN event_id % 5 = 0 THEN true ELSE event_id % 2 = 0 END signed, event_id % 6 <> 0 stamp, CASE WHEN event_id % 10 = 0 THEN 3 ELSE 0 END::BIGINT signatures,
  CASE WHEN event_id % 8 = 0 AND event_id % 12 NOT IN (0, 3) THEN '01-02' WHEN event_id % 2 = 0 THEN 'hint' WHEN event_id % 12 = 3 THEN '25-12' ELSE 'unknown' END pu_code,
  (0.9 + CASE WHEN event_id % 3 = 0 THEN 0.6 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0 END + CASE WHEN event_id % 9 = 0 THEN 0.75 ELSE 0 END + CASE WHEN event_id % 8 = 0 THEN 0.5 ELSE 0 END + CASE WHEN event_id % 8 = 0 AND event_id % 12 NOT IN (0, 3) THEN 0.125 ELSE 0 END + CASE WHEN event_id % 12 IN (0, 3) THEN 0.375 ELSE 0 END)
   / (1 + (event_id % 3 = 0)::INT + (event_id % 4 = 0)::INT + (event_id % 9 = 0)::INT + (event_id % 8 = 0)::INT + (event_id % 8 = 0 AND event_id % 12 NOT IN (0, 3))::INT + (event_id % 12 IN (0, 3))::INT) confidence
  FROM (SELECT event_id, event_id % 1000 a, event_id % 77 b, CASE WHEN event_id % 7 = 0 THEN 9 ELSE event_id % 1000 END + CASE WHEN event_id % 3 = 0 THEN event_id % 77 ELSE 0 END v FROM events) WHERE event_id % 11 <> 0"""


@query("M12_entity_pivot", f"SELECT * REPLACE (round(confidence, 9) AS confidence) FROM ({_M12})", False)
def _(spark, sf_dir):
    """Entities with parties under both names, flags that are missing, and totals and codes that only a general form's fields give."""
    k = F.col("event_id")

    def entity(name, text, sure, when=None, key="type"):
        row = F.struct(F.lit(name).alias(key), text.alias("text"), F.lit(sure).alias("confidence"))
        return row if when is None else F.when(when, row)

    text = lambda c: c.cast("string")
    some = k % 11 != 0
    entities = F.array_compact(F.array(
        entity("Party_apc", F.concat(F.lit(" "), text(k % 1000), F.lit(" votes")), 0.9, some), entity("candidate_pdp", text(k % 77), 0.6, some & (k % 3 == 0)), entity("candidate_APC", F.lit("9"), 0.9, some & (k % 7 == 0)),
        entity("rejected_ballots", F.lit("7"), 0.5, k % 4 == 0), entity("total_votes_cast", F.lit("12"), 0.1, k % 9 == 0), entity("total_votes_cast", F.lit("1,000"), 0.75, k % 9 == 0),
        entity("presiding_officer_signed", F.when(k % 2 == 0, " Yes").otherwise("no"), 0.1, k % 5 != 0), entity("official_stamp_present", F.lit("no"), 0.1, k % 6 == 0), entity("agent_signatures_detected", F.lit("3"), 0.1, k % 10 == 0),
        entity("polling_unit_code", F.lit(" 25-11 "), 0.125, k % 12 == 0), entity("pu_code", F.lit("25-12"), 0.375, k % 12 == 3), entity("PU_CODE", F.lit("other"), 0.375, k % 12 == 0),
    ))
    label = lambda *a: entity(*a, key="label")
    fields = F.array_compact(F.array(label("Total registered voters", F.lit("412"), 0.5, k % 8 == 0), label("registered voters", F.lit("1"), 0.25, k % 8 == 0), label("PU code", F.lit(" 01-02"), 0.125, k % 8 == 0), label("remarks", F.lit("x"), 1.0)))
    rows = _table(spark, sf_dir, "events").select("event_id", entities.alias("entities"), fields.alias("fields"), F.when(k % 2 == 0, "hint").otherwise("unknown").alias("hint"))
    rows = registers.forms_of_entities(rows, validation.whole_number, fields="fields", hint="hint").filter("form is not null")
    votes = lambda p: F.try_element_at("form.candidate_votes", F.lit(p))
    named = {"valid": "total_valid_votes", "rejected": "rejected_ballots", "total": "total_votes_cast", "registered": "registered_voters", "signed": "presiding_officer_signed", "stamp": "official_stamp_present", "signatures": "agent_signatures_detected", "pu_code": "pu_code"}
    return rows.select("event_id", votes("APC").alias("votes_apc"), votes("PDP").alias("votes_pdp"), *(F.col(f"form.{c}").alias(n) for n, c in named.items()), F.round("confidence", 9).alias("confidence"))


@query("M13_vision_parse", """SELECT event_id, event_id % 50 votes_apc, coalesce(nullif(event_id % 4, 0), event_id % 50) valid, coalesce(nullif(event_id % 4, 0), event_id % 50) + 2 total, 400::BIGINT registered, CASE WHEN event_id % 3 = 0 THEN 287 ELSE 0 END::BIGINT accredited, event_id % 5 <> 0 AND event_id % 7 <> 0 signed, true stamp, 3::BIGINT signatures,
  CASE WHEN event_id % 2 = 0 THEN '25-11' ELSE 'u' END pu_code, CASE WHEN event_id % 8 = 0 THEN 0.5 ELSE 0.625 END::DOUBLE confidence FROM events WHERE event_id % 6 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0""", False)
def _(spark, sf_dir):
    """Answers that are errors with votes, none, no JSON, or forms whose flags are false, null or left out."""
    k = F.col("event_id")
    signed = F.when(k % 5 == 0, ', "presiding_officer_signed": false').when(k % 7 == 0, ', "presiding_officer_signed": null').otherwise("")
    body = F.concat(
        F.lit('"candidate_votes": {" apc ": '), (k % 50).cast("string"), F.lit(', "pdp": null}, "rejected_ballots": 2, "registered_voters": "400", "agent_signatures_detected": 3, "total_valid_votes": '), (k % 4).cast("string"), signed,
        F.when(k % 3 == 0, ', "accredited_voters": 287').otherwise(""), F.when(k % 2 == 0, ', "pu_code": "25-11"').otherwise(""), F.when(k % 8 == 0, "").otherwise(', "confidence": {"a": 0.25, "b": 1, "c": "high"}'), F.lit("}"),
    )
    answer = F.when(k % 6 == 0, F.concat(F.lit('{"error": "not_an_ec8a", '), body)).when(k % 13 == 0, '{"candidate_votes": {}}').when(k % 17 == 0, "no JSON").otherwise(F.concat(F.lit("{"), body))
    rows = _table(spark, sf_dir, "events").select("event_id", answer.alias("answer"), F.lit("u").alias("hint"))
    rows = registers.forms_of_answers(rows, hint="hint").filter("form is not null")
    named = {"valid": "total_valid_votes", "total": "total_votes_cast", "registered": "registered_voters", "accredited": "accredited_voters", "signed": "presiding_officer_signed", "stamp": "official_stamp_present", "signatures": "agent_signatures_detected", "pu_code": "pu_code"}
    return rows.select("event_id", F.try_element_at("form.candidate_votes", F.lit("APC")).alias("votes_apc"), *(F.col(f"form.{c}").alias(n) for n, c in named.items()), "confidence")


@query("M18_clean_names", "SELECT c_custkey, 'Ìbàdàn ' || array_to_string(list_transform(string_split(lower(replace(c_mktsegment, 'I', 'i-x')), '-'), lambda x: upper(x[1]) || x[2:]), '-') || chr(39) || 'S Ward' name FROM customer", False)
def _(spark, sf_dir):
    text = F.concat(F.lit("  ÌBÀDÀN  "), F.replace(F.col("c_mktsegment"), F.lit("I"), F.lit("i-x")), F.lit("'s  WARD "))
    return _table(spark, sf_dir, "customer").select("c_custkey", registers.clean_name(text).alias("name"))


@query("M18_code_parts", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '01| 02|a/b|3' WHEN 3 THEN concat('25|11|04|', c_custkey) END parts FROM customer", False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, "01- 02-a/b-3").when(k % 4 == 1, "01- -04-007").when(k % 4 == 2, "01/02/04/007").otherwise(F.concat(F.lit("25-11-04-"), k.cast("string")))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(registers.code_parts(code), "|").alias("parts"))


@query("L6_rings", """SELECT area, count(*) FILTER (outer_ring)::BIGINT outers, CASE WHEN bool_or(outer_ring) THEN count(*) FILTER (NOT outer_ring) ELSE 0 END::BIGINT holes, CASE WHEN bool_or(outer_ring) THEN sum(n + open) ELSE 0 END::BIGINT points
  FROM (SELECT c_nationkey area, c_custkey % 4 <> 0 outer_ring, 3 + c_custkey % 3 n, (c_custkey % 5 = 0)::INT open FROM customer WHERE 3 + c_custkey % 3 >= 4) GROUP BY 1""", False)
def _(spark, sf_dir):
    """Rings of four and five points, every fifth of them open; ways of three points are none, and an area of holes alone has no polygon."""
    k = F.col("c_custkey")
    n = 3 + k % 3
    point = lambda i: F.struct(i.cast("double").alias("x"), F.lit(1.0).alias("y"))
    ring = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.when((i == n) & (k % 5 != 0), point(F.lit(1))).otherwise(point(i)))
    ways = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("area"), k.alias("at"), F.when(k % 4 == 0, "inner").otherwise("outer").alias("role"), ring.alias("ring"))
    rows = registers.assemble_rings(ways)
    rings = F.flatten("polygons")
    points = F.aggregate(rings, F.lit(0), lambda a, r: a + F.size(r)).cast("long")
    return rows.select("area", F.size("polygons").cast("long").alias("outers"), (F.size(rings) - F.size("polygons")).cast("long").alias("holes"), points.alias("points"))
