"""Public reads and registers: filters, pages, detail records, event feeds, limits and extraction choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intake import field_of


def submission_view(submissions: DataFrame) -> DataFrame:
    """The public columns of a submission; missing fields are {} and a missing confidence is 0."""
    data = F.coalesce(F.to_json(F.struct("valid", "rejected", "cast")), F.lit("{}")) if "valid" in submissions.columns else F.lit("{}")
    return submissions.select(F.col("id").alias("submission_id"), F.col("source_type").alias("source"), F.when(F.col("valid").isNull(), "{}").otherwise(data).alias("extracted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def chosen(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value that is given; a value of None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def of_election(rows: DataFrame, election: str) -> DataFrame:
    """Rows of one election and those of none."""
    return rows.filter((F.col("election") == election) | F.col("election").isNull())


def severity_range(rows: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Rows of at least this severity, and at most that."""
    found = rows.filter(F.col("severity") >= least)
    return found if most is None else found.filter(F.col("severity") <= most)


def elections_to_read(elections: DataFrame, election: str | None = None, types: Sequence[str] = (), year: int | None = None, state: str | None = None) -> DataFrame:
    """Of elections (election, type, date, state) those of this id, one of these types, this year in UTC, and this state.

    Types and states are told in capitals; what is not asked for does not count, and a row that lacks what is asked for is out.
    """
    found = chosen(elections, election=election)
    found = found.filter(F.upper("type").isin(*types)) if types else found
    found = found if year is None else found.filter(F.year(F.to_utc_timestamp(F.col("date").cast("timestamp"), F.current_timezone())) == year)
    return found if state is None else found.filter(F.upper("state") == state)


def outcomes(attempts: DataFrame, order: Sequence[str], example: str) -> DataFrame:
    """outcome, n, example of attempts (ok, reason): parsed, or why not; the example is the first of its kind in this order."""
    kind = F.when(F.col("ok"), "parsed").otherwise(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unknown_failure")))
    return attempts.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.min_by(example, F.struct(*order)).alias("example"))


def page(rows: DataFrame, key: str, after=None, size: int = 500) -> DataFrame:
    """The next rows by key, after the last key of the page before."""
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(size)


def recovery(started_at: Column, now: Column, stale_minutes: int = 30, give_up_hours: int = 4) -> Column:
    """What becomes of an extraction that began then: failed, queued, skipped without a start, or null where it is not stale yet."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(started_at)
    return F.when(started_at.isNull(), "skipped").when(seconds > give_up_hours * 3600, "failed").when(seconds > stale_minutes * 60, "queued")


def retry(status: Column) -> Column:
    """Only failed work is queued again."""
    return F.when(status == "failed", "queued").otherwise(F.concat(F.lit("error: "), F.coalesce(status, F.lit("unknown"))))


def observer_decision(action: Column, status: Column, reason: Column) -> Column:
    """approved or rejected, or what forbids the step; a rejection needs a reason that is not blank."""
    return F.when(status != "pending", "error: not pending").when(action == "approve", "approved").when(F.trim(F.coalesce(reason, F.lit(""))) == "", "error: reason required").otherwise("rejected")


def rate_limit(requests: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Every request (columns key, at in epoch seconds) with recent, limited and retry_after: seconds until the oldest one leaves the window.

    The window sorts one key's requests; a key without end is one that the limit itself keeps short.
    """
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds, 0)
    n = F.count("*").over(w)
    wait = F.greatest(F.lit(0), F.min("at").over(w) + seconds - F.col("at"))
    return requests.withColumn("recent", n).withColumn("limited", n > most).withColumn("retry_after", F.when(n > most, wait).otherwise(0))


def audit_events(submissions: DataFrame, approvals: DataFrame) -> DataFrame:
    """event_type, entity_type, entity_id, actor_id, event_at, event_data: what submissions and their reviews add to the log."""
    def of(rows: DataFrame, kind: Column, *data: str) -> DataFrame:
        return rows.select(kind.alias("event_type"), F.lit("submission").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.col("actor").alias("actor_id"), F.col("submitted_at").alias("event_at"), F.to_json(F.struct(*data)).alias("event_data"))

    return of(submissions, F.lit("submission.created"), "pu", "source_type").unionByName(of(approvals, F.when(F.col("approved"), "submission.approved").otherwise("submission.rejected"), "pu"))


def recent_events(events: DataFrame, pu: str, most: int = 50) -> DataFrame:
    """The last events whose data name a unit, newest first."""
    return events.filter(F.get_json_object("event_data", "$.pu") == pu).orderBy(F.desc("seq")).limit(most)


def leader_outliers(turnout: DataFrame, threshold: float = 3.0, peers: int = 5) -> DataFrame:
    """Units whose leader's share is far from their ward's (population deviation, five peers at least), with rounded details."""
    ward = turnout.groupBy("ward").agg(F.count("leader_share").alias("ward_n"), F.avg("leader_share").alias("mean"), F.stddev_pop("leader_share").alias("sd")).filter((F.col("ward_n") >= peers) & (F.col("sd") > 0))
    z = (F.col("leader_share") - F.col("mean")) / F.col("sd")
    rows = turnout.join(ward, "ward").withColumn("z", z).filter(F.abs("z") >= threshold)
    severity = F.when(F.abs("z") >= 5, 5).when(F.abs("z") >= 4, 4).otherwise(3).cast("long")
    details = F.struct(F.round("z", 2).alias("z_score"), F.round("leader_share", 4).alias("pu_leader_share"), F.round("mean", 4).alias("ward_mean"), F.round("sd", 4).alias("ward_stddev"), "ward_n")
    return rows.select("pu", F.lit("leader_share_outlier_ward").alias("anomaly_type"), severity.alias("severity"), details.alias("details"))


def needs_second(confidence: Column, consistent: Column, fields: Column, floor: float = 0.85) -> Column:
    """Whether a first extraction asks for another one."""
    return (confidence < floor) | ~consistent | F.exists(F.map_values(fields), lambda c: c < floor)


def better(first: Column, second: Column, floor: float = 0.85) -> Column:
    """Of two extractions (structs confidence, consistent, fields, ...): the second if it was needed, holds together and is as sure."""
    use = needs_second(first["confidence"], first["consistent"], first["fields"], floor) & second["consistent"] & (second["confidence"] >= first["confidence"])
    return F.when(use, second).otherwise(first)


def mean_confidence(fields: Column, none: float = 0.0) -> Column:
    """The mean of a map of confidences; none where there are none."""
    total = F.aggregate(F.map_values(fields), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, total / F.size(fields)).otherwise(none)


_TOTALS = ("registered_voters", "accredited_voters", "total_valid_votes", "rejected_ballots", "total_votes_cast")
_FLAGS = ("presiding_officer_signed", "official_stamp_present")
_TRUE = ("true", "yes", "1", "y")
_UNIT = ("pu_code", "polling_unit_code")
_SIGNATURES = "agent_signatures_detected"


def _said(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: what an array of one struct gives is not put into later expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def forms_of_entities(rows: DataFrame, number, entities: str = "entities", fields: str | None = None, hint: str | None = None) -> DataFrame:
    """rows with form, confidences and confidence of an array of entities (type, text, confidence); all null without party entities.

    party_X and candidate_X are votes of X; the last entity of a type counts, but for the unit's code: the first one, and only
    where the hint (a column) is missing or unknown. fields, an array of (label, text, confidence) of a general form, fills
    totals that no entity gives, the first of a kind, and the unit's code if no entity has one. Flags that nothing names are
    true, other totals are summed or 0. confidences: by field; confidence: their mean. number turns text into a number.
    """
    none = F.array().cast("array<struct<k:string,t:string,c:double>>")
    party = "^(party|candidate)_"
    # the part before the first _ goes: party_X and candidate_X are one field
    name = lambda t: F.when(t.rlike(party), F.concat(F.lit("candidate_votes."), F.upper(F.regexp_replace(t, party, "")))).when(t.isin(*_UNIT), "pu_code").otherwise(t)
    text = lambda x: F.coalesce(x, F.lit(""))
    own = F.transform(F.coalesce(F.col(entities), F.array().cast(rows.schema[entities].dataType)), lambda e: F.struct(name(F.lower(text(e["type"]))).alias("k"), text(e["text"]).alias("t"), F.coalesce(e["confidence"].cast("double"), F.lit(0.0)).alias("c")))
    other = none
    if fields is not None:
        known = F.filter(F.transform(F.col(fields), lambda f: F.struct(field_of(text(f["label"])).alias("k"), text(f["text"]).alias("t"), F.coalesce(f["confidence"].cast("double"), F.lit(0.0)).alias("c"))), lambda f: f["k"].isNotNull())
        other = F.coalesce(known, none)
    read = _said(rows, own_=own, other_=other)
    placed = lambda c, sign: F.array_sort(F.transform(c, lambda e, i: F.struct(e["k"].alias("k"), (sign * i).alias("i"), e["t"].alias("t"), e["c"].alias("c"))))
    read = _said(read, own_s=placed("own_", 1), other_s=placed("other_", -1))
    # of each run of one name in order the last one stays
    last = lambda c: F.map_from_entries(F.transform(F.filter(c, lambda e, i: ~F.coalesce(F.get(c, i + 1)["k"] == e["k"], F.lit(False))), lambda e: F.struct(e["k"], F.struct(e["t"].alias("t"), e["c"].alias("c")))))
    coded = F.get(F.filter("own_", lambda e: (e["k"] == "pu_code") & ~F.trim(e["t"]).isin("", "unknown")), F.lit(0))["t"]
    read = _said(read, m_=last(F.col("own_s")), o_=last(F.col("other_s")), coded_=coded).drop("own_", "other_", "own_s", "other_s")
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    total = {k: F.coalesce(get("m_", k), get("o_", k)) for k in _TOTALS}
    votes = F.map_from_entries(F.transform(F.filter(F.map_entries("m_"), lambda e: e["key"].startswith("candidate_votes.")), lambda e: F.struct(F.replace(e["key"], F.lit("candidate_votes.")), F.coalesce(number(e["value"]["t"]), F.lit(0)))))
    sure = F.map_filter("m_", lambda k, v: k.startswith("candidate_votes.") | k.isin(*_TOTALS, "pu_code"))
    more = F.map_filter("o_", lambda k, v: k.isin(*_TOTALS, "pu_code") & ~F.map_contains_key("m_", k))
    read = _said(read, votes_=votes, sure_=F.transform_values(F.map_concat(sure, more), lambda k, v: v["c"]), **{f"{k}_": F.when(v.isNotNull(), F.coalesce(number(v["t"]), F.lit(0))) for k, v in total.items()})
    summed = F.aggregate(F.map_values("votes_"), F.lit(0).cast("long"), lambda a, x: a + x)
    valid, rejected = F.coalesce("total_valid_votes_", summed), F.coalesce("rejected_ballots_", F.lit(0))
    truth = lambda k: F.coalesce(F.lower(F.trim(get("m_", k)["t"])).isin(*_TRUE), F.lit(True)).alias(k)
    given = F.nullif(F.nullif(F.col(hint), F.lit("")), F.lit("unknown")) if hint else F.lit(None).cast("string")
    labelled = F.when(~F.map_contains_key("m_", "pu_code"), F.trim(get("o_", "pu_code")["t"]))
    code = F.coalesce(F.nullif(labelled, F.lit("")), given, F.trim("coded_"), F.lit("unknown"))
    form = F.struct(
        code.alias("pu_code"), F.coalesce("registered_voters_", F.lit(0)).alias("registered_voters"), F.coalesce("accredited_voters_", F.lit(0)).alias("accredited_voters"), F.col("votes_").alias("candidate_votes"),
        valid.alias("total_valid_votes"), rejected.alias("rejected_ballots"), F.coalesce("total_votes_cast_", valid + rejected).alias("total_votes_cast"),
        *map(truth, _FLAGS), F.coalesce(number(get("m_", _SIGNATURES)["t"]), F.lit(0)).alias(_SIGNATURES),
    )
    some = F.size("votes_") > 0
    out = _said(read, form=F.when(some, form), confidences=F.when(some, F.col("sure_")), confidence=F.when(some, mean_confidence(F.col("sure_"))))
    return out.drop("m_", "o_", "coded_", "votes_", "sure_", *(f"{k}_" for k in _TOTALS))


_VISION = ", ".join(f"{c} string" for c in ("error", "pu_code", *_TOTALS, *_FLAGS, _SIGNATURES)) + ", candidate_votes map<string,string>, confidence map<string,string>"
#: Fixed value: what a model answers that saw no form.
NOT_A_FORM = "not_an_ec8a"


def forms_of_answers(rows: DataFrame, answer: str = "answer", hint: str | None = None) -> DataFrame:
    """rows with form, confidences and confidence of a model's JSON answer; all null where it is no JSON, says that it saw no form, or has no votes.

    Codes of parties are trimmed and in capitals, the last of one code counts; null votes are dropped. Totals of 0 count as
    missing: they are summed, or 0. A flag that the answer leaves out is true, one that is null is false. Without any
    confidences the mean is 0.5.
    """
    read = _said(rows, p_=F.from_json(answer, _VISION), keys_=F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>")))
    number = lambda t: F.coalesce(t.try_cast("double").cast("long"), F.lit(0))
    entries = F.filter(F.map_entries("p_.candidate_votes"), lambda e: e["value"].isNotNull())
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(F.upper(F.trim(e["key"])).alias("k"), i.alias("i"), number(e["value"]).alias("n"))))
    read = _said(read, s_=placed)
    votes = F.map_from_entries(F.transform(F.filter("s_", lambda e, i: ~F.coalesce(F.get("s_", i + 1)["k"] == e["k"], F.lit(False))), lambda e: F.struct(e["k"], e["n"])))
    sure = F.filter(F.transform(F.map_entries("p_.confidence"), lambda e: F.struct(e["key"], e["value"].try_cast("double").alias("value"))), lambda e: e["value"].isNotNull())
    good = F.col("p_").isNotNull() & ~F.coalesce(F.col("p_.error") == NOT_A_FORM, F.lit(False))
    read = _said(read, votes_=F.when(good, votes), sure_=F.coalesce(F.map_from_entries(sure), F.create_map().cast("map<string,double>")))
    p = {k: number(F.col(f"p_.{k}")) for k in (*_TOTALS, _SIGNATURES)}
    some = lambda n: F.nullif(n, F.lit(0))
    summed = F.aggregate(F.map_values("votes_"), F.lit(0).cast("long"), lambda a, x: a + x)
    valid = F.coalesce(some(p["total_valid_votes"]), summed)
    truth = lambda k: F.when(F.array_contains("keys_", k), ~F.coalesce(F.lower(f"p_.{k}"), F.lit("")).isin("", "0", "0.0", "false")).otherwise(True).alias(k)
    form = F.struct(
        F.coalesce(F.nullif("p_.pu_code", F.lit("")), F.nullif(F.col(hint), F.lit("")) if hint else F.lit(None), F.lit("unknown")).alias("pu_code"), p["registered_voters"].alias("registered_voters"), p["accredited_voters"].alias("accredited_voters"),
        F.col("votes_").alias("candidate_votes"), valid.alias("total_valid_votes"), p["rejected_ballots"].alias("rejected_ballots"), F.coalesce(some(p["total_votes_cast"]), valid + p["rejected_ballots"]).alias("total_votes_cast"),
        *map(truth, _FLAGS), p[_SIGNATURES].alias(_SIGNATURES),
    )
    held = F.coalesce(F.size("votes_") > 0, F.lit(False))
    out = _said(read, form=F.when(held, form), confidences=F.when(held, F.col("sure_")), confidence=F.when(held, mean_confidence(F.col("sure_"), 0.5)))
    return out.drop("p_", "keys_", "s_", "votes_", "sure_")


def clean_name(text: Column) -> Column:
    """White space collapsed, each run of letters with a capital first: letters are those that have capitals, marked ones too."""
    words = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"([^\p{Lu}\p{Ll}\p{Lt}]+)", "\u0001$1\u0001")
    return F.array_join(F.transform(F.split(words, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def code_parts(code: Column) -> Column:
    """The four parts of a unit's code between hyphens, as they are; null if there are not four or one is blank."""
    parts = F.split(code, "-")
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: F.trim(p) == ""), parts)


def ring_centroid(ring: Column) -> Column:
    """Struct x, y: the shoelace centroid of a closed ring (array of structs x, y); its first point without area, null under three points."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0).cast("double"), lambda a, p: a + f(p))
    area = total(lambda p: p["c"]) * 0.5
    flat = F.struct(ring[0]["x"].alias("x"), ring[0]["y"].alias("y"))
    middle = F.struct((total(lambda p: p["x"] * p["c"]) / F.nullif(6 * area, F.lit(0.0))).alias("x"), (total(lambda p: p["y"] * p["c"]) / F.nullif(6 * area, F.lit(0.0))).alias("y"))
    return F.when(F.size(ring) >= 3, F.when(area == 0, flat).otherwise(middle))


def assemble_rings(members: DataFrame) -> DataFrame:
    """area, polygons of ways (area, at, role, ring): rings of four points at least, closed; holes go to the first outer ring.

    An area's ways meet in one row, as its geometry is one value.
    """
    ring = F.when(F.element_at("ring", 1) != F.element_at("ring", -1), F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    rows = members.filter(F.size("ring") >= 4).withColumn("ring", ring).withColumn("hole", F.coalesce(F.col("role") == "inner", F.lit(False)))
    sides = rows.groupBy("area").agg(*(F.array_sort(F.collect_list(F.when(F.col("hole") == hole, F.struct("at", "ring")))).alias(name) for name, hole in (("outer", False), ("inner", True))))
    rings = lambda c: F.transform(c, lambda r: r["ring"])
    return sides.select("area", F.transform(rings("outer"), lambda r, i: F.when(i == 0, F.concat(F.array(r), rings(F.col("inner")))).otherwise(F.array(r))).alias("polygons"))


def symbol(total: Column, reporting: Column, share: Column) -> Column:
    """The colour class of a region's symbol: by its leader's share once half of its units report."""
    return F.when(reporting / F.greatest(total, F.lit(1)) < 0.5, "few").when(share >= 0.85, "strong").when(share >= 0.5, "clear").when(share >= 0.2, "close").otherwise("none")


def split_failed(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others for quarantine; null counts as failed."""
    held = F.coalesce(good, F.lit(False))
    return rows.filter(held), rows.filter(~held)
