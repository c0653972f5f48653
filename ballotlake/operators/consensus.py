"""Whether independent sources of a unit's result agree with each other and with the official form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = ("registered_voters", "accredited", "valid", "rejected", "cast")
FLAGS = ("presiding_officer_signed", "official_stamp_present")
SIGNATURES = "agent_signatures"
VERIFIED = ("consensus", "inec_confirmed", "inec_published")
KEY = ["election", "pu"]
_VOTES = "candidate_votes."
#: Forms of a unit that meet in one row.
GATHERED = 1000


def source_key() -> Column:
    """party:<code>, observer:<submission>, or inec_irev."""
    return F.when(F.col("source_type") == "party_agent", F.concat(F.lit("party:"), F.coalesce("party", F.lit("unknown")))).when(F.col("source_type") == "observer", F.concat(F.lit("observer:"), F.col("id").cast("string"))).otherwise("inec_irev")


def _value_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """By unit, field and value: own forms with it and the first of them; a row of null field and value holds the unit's forms.

    A hot unit's forms meet partly summed in each task, and then as one row for each distinct value of a field.
    """
    order, own = F.struct("submitted_at", "id"), F.col("own")
    unit = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("value"))
    scalar = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields))
    votes = F.transform(F.map_entries("votes"), lambda e: F.struct(F.concat(F.lit(_VOTES), e["key"]).alias("field"), e["value"].cast("long").alias("value")))
    every = rows.select(*KEY, "own", "source_type", "party", order.alias("order"), F.struct(*fields, "votes").alias("whole"), F.inline(F.concat(F.array(unit), scalar, votes)))
    form = F.col("field").isNull()
    body, at = F.when(form, F.col("whole")), F.when(form, F.col("order"))
    party = F.when(form & (F.col("source_type") == "party_agent"), F.coalesce("party", F.lit("unknown")))
    return every.groupBy(*KEY, "field", "value").agg(
        F.count_if("own").alias("n"), F.min(F.when(own, F.col("order"))).alias("seen"), F.count_if(form).alias("forms"), F.count_if(form & ~own).alias("officials"),
        F.count_if(form & (F.col("source_type") == "observer")).alias("observers"), F.collect_set(party).alias("parties"),
        F.min_by(body, F.when(own, at)).alias("first"), F.min_by(body, F.when(~own, at)).alias("official"),
    )


def _merged(rows: DataFrame, fields: list[str]) -> DataFrame:
    """What _gathered gives, for units of any number of forms: what meets in one row are the different values of each field."""
    once = lambda c: F.first(F.when(F.col("field").isNull(), F.col(c)), ignorenulls=True).alias(c)
    units = _value_counts(rows, fields).groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value", "n", "seen"))).alias("vals"),
        *map(once, ("forms", "officials", "observers", "parties", "first", "official")),
    )
    units = units.withColumn("fields_", F.expr("array_sort(array_distinct(transform(vals, v -> v.field)))"))
    each = F.expr(f"""transform(fields_, f -> struct(f as field, filter(vals, v -> v.field = f and v.n > 0 and v.value is not null) as own,
        f like '{_VOTES}%' as voted))""")
    filled = F.expr("""transform(each, e -> struct(e.field as field, e.voted as voted, size(e.own) > 0 as held, array_sort(concat(transform(e.own, v -> struct(v.value as value, v.n as n)),
        if(e.voted and aggregate(e.own, 0L, (a, v) -> a + v.n) < forms - officials, array(struct(0L as value, forms - officials - aggregate(e.own, 0L, (a, v) -> a + v.n) as n)), array()))) as own))""")
    spread = F.expr("""transform(filled, e -> struct(e.field as field, e.voted as voted, e.held as held, try_element_at(e.own, -1).value - get(e.own, 0).value as gap,
        aggregate(e.own, struct(aggregate(e.own, 0L, (a, v) -> a + v.n) div 2 as left, cast(null as bigint) as value),
            (a, v) -> struct(a.left - v.n as left, if(a.value is null and a.left < v.n, v.value, a.value) as value)).value as median))""")
    mode = F.expr(f"get(array_sort(filter(vals, v -> v.field = '{SIGNATURES}' and v.n > 0), (a, b) -> case when a.n <> b.n then if(a.n > b.n, -1, 1) when a.seen < b.seen then -1 when a.seen > b.seen then 1 else 0 end), 0).value")
    units = units.withColumn("each", each).withColumn("filled", filled).withColumn("stats", spread).withColumn("mode", mode)
    by_field = lambda value: F.map_from_entries(F.transform("stats", lambda e: F.struct(e["field"], e[value])))
    units = units.withColumns({"gap_": by_field("gap"), "median_": by_field("median")})
    of = lambda m: F.struct(*(F.try_element_at(F.col(m), F.lit(f)).alias(f) for f in fields))
    voted = F.transform(F.filter("stats", lambda e: e["voted"]), lambda e: F.struct(F.substr(e["field"], F.lit(len(_VOTES) + 1)).alias("name"), e["held"].alias("held"), e["gap"].alias("gap"), e["median"].alias("median")))
    return units.select(*KEY, "forms", "officials", (F.size("parties") + F.col("observers")).alias("independent"), "first", "official", "mode", of("gap_").alias("gap"), of("median_").alias("median"), voted.alias("voted"))


def _gathered(rows: DataFrame, fields: list[str]) -> DataFrame:
    """By unit: forms, officials, independent sources, first own and first official form, the most frequent signatures, and of the own values
    of each field, and of each party (left out: 0), how far they lie apart and their upper median.

    A unit's forms meet in one row, by time: each is shuffled once and whole. Fields are arrays of plain numbers here, as functions with a
    comparator or a structure for each value took most of the time.
    """
    party = F.when(F.col("source_type") == "party_agent", F.coalesce("party", F.lit("unknown"))).alias("party")
    form = F.struct(F.struct("submitted_at", "id").alias("order"), party, *fields, F.map_entries("votes").alias("entries"))
    rows = rows.select(*KEY, "own", (F.col("source_type") == "observer").alias("observer"), form.alias("form")).repartition(*KEY)
    units = rows.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("own"), F.col("form")))).alias("own_"), F.sort_array(F.collect_list(F.when(~F.col("own"), F.col("form")))).alias("other_"), F.count_if("observer").alias("observers"),
    )
    values = {f"{f}_": F.expr(f"sort_array(array_compact(cast(own_.{f} as array<bigint>)))") for f in fields}
    marks = {"marks": F.expr(f"cast(own_.{SIGNATURES} as array<bigint>)")} if SIGNATURES in fields else {}
    units = units.withColumns(values | marks | {"said": F.expr("flatten(own_.entries)")})
    voted = F.expr("""transform(transform(
        transform(sort_array(array_distinct(concat(said.key, flatten(other_.entries).key))), p -> struct(p as name, cast(filter(said, e -> e.key = p and e.value is not null).value as array<bigint>) as seen)),
        v -> struct(v.name as name, size(v.seen) > 0 as held, sort_array(concat(v.seen, array_repeat(0L, size(own_) - size(v.seen)))) as own)),
        v -> struct(v.name as name, v.held as held, try_element_at(v.own, -1) - get(v.own, 0) as gap, get(v.own, size(v.own) div 2) as median))""")
    mode = "array_max(transform(array_distinct(marks), (d, i) -> struct(size(filter(marks, m -> m <=> d)) as n, -i as at, d as value))).value" if marks else "cast(null as bigint)"
    first = lambda forms: F.when(F.size(forms) > 0, F.struct(*(F.get(forms, F.lit(0))[f].alias(f) for f in fields), F.map_from_entries(F.get(forms, F.lit(0))["entries"]).alias("votes")))
    of = lambda value: F.struct(*(F.expr(value.format(f"{f}_")).alias(f) for f in fields))
    return units.select(
        *KEY, F.expr("cast(size(own_) + size(other_) as bigint)").alias("forms"), F.size("other_").cast("long").alias("officials"), (F.size(F.array_compact(F.array_distinct("own_.party"))) + F.col("observers")).alias("independent"),
        first("own_").alias("first"), first("other_").alias("official"), F.expr(mode).alias("mode"), of("try_element_at({0}, -1) - get({0}, 0)").alias("gap"), of("get({0}, size({0}) div 2)").alias("median"), voted.alias("voted"),
    )


def consensus(submissions: DataFrame, min_sources: int = 2, tolerance: int = 0, gathered: int = GATHERED) -> DataFrame:
    """One row an election and unit: status, submission_count, source_count, the agreed fields, votes map, differing fields.

    Of SCALARS, FLAGS and SIGNATURES those count that submissions has. A party that a form leaves out counts as 0; nulls
    of other fields do not count. "First" means by (submitted_at, id). Numbers agree within tolerance, flags exactly, and
    signatures need not: the most frequent count is taken, the first seen of equal ones. With a processing_status, only
    forms that are extracted count. Units of more forms than gathered are counted by field and value before these meet, which
    shuffles a row for each field of a form; the result is the same.
    """
    scalars, flags = ([c for c in names if c in submissions.columns] for names in (SCALARS, FLAGS))
    marks = [SIGNATURES] if SIGNATURES in submissions.columns else []
    read = submissions.filter("processing_status = 'extracted'") if "processing_status" in submissions.columns else submissions
    rows = read.filter("approved and votes is not null").withColumn("own", F.coalesce(F.col("source_type").isin("party_agent", "observer"), F.lit(False)))
    fields = [*scalars, *flags, *marks]
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > gathered)
    large = F.broadcast(sizes.select(*(F.col(k).alias(f"{k}_") for k in KEY)))
    same = F.col(KEY[0]).eqNullSafe(F.col(f"{KEY[0]}_")) & F.col(KEY[1]).eqNullSafe(F.col(f"{KEY[1]}_"))
    units = _gathered(rows.join(large, same, "left_anti"), fields).unionByName(_merged(rows.join(large, same, "left_semi"), fields))
    at = lambda m, f: F.col(m)[f]
    official_votes = F.col("official.votes")
    named = lambda parties: F.transform(parties, lambda v: F.concat(F.lit(_VOTES), v["name"]))
    differ = F.concat(
        F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(at("gap", f) > tolerance, f) for f in scalars))),
        named(F.filter("voted", lambda v: v["gap"] > tolerance)),
        F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(at("gap", f) > 0, f) for f in flags))),
    )
    off = lambda v: F.abs(v["median"] - F.coalesce(F.try_element_at(official_votes, v["name"]), F.lit(0))) > tolerance
    conflict = F.concat(
        F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.abs(at("median", f) - F.col(f"official.{f}")) > tolerance, f) for f in scalars))),
        named(F.filter("voted", off)),
        F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(f"first.{f}") != F.col(f"official.{f}"), f) for f in flags))),
    )
    official = F.col("officials") > 0
    status = (
        F.when(F.col("independent") == 0, "inec_published").when((F.col("independent") < min_sources) & ~official, "single_source").when(F.size("differ") > 0, "discrepancy")
        .when(official & (F.size("conflict") > 0), "inec_conflict").when(official, "inec_confirmed").otherwise("consensus")
    )
    s = F.col("status")
    pick = lambda agreed, f: F.when(s == "inec_published", F.col(f"official.{f}")).when(s == "single_source", F.col(f"first.{f}")).when(s != "discrepancy", agreed)
    seen_votes = F.map_from_entries(F.transform(F.filter("voted", lambda v: v["held"]), lambda v: F.struct(v["name"].alias("name"), v["median"].alias("n"))))
    found = units.withColumn("differ", differ).withColumn("conflict", conflict).withColumn("status", status).select(
        *KEY, "status", F.col("forms").alias("submission_count"), (F.col("independent") + official.cast("int")).cast("long").alias("source_count"),
        *(pick(at("median", f), f).alias(f) for f in scalars), *(pick(F.col(f"first.{f}"), f).alias(f) for f in flags), *(pick(F.col("mode"), f).alias(f) for f in marks), pick(seen_votes, "votes").alias("votes"),
        F.when(s == "discrepancy", F.col("differ")).when(s == "inec_conflict", F.col("conflict")).otherwise(F.array().cast("array<string>")).alias("fields"),
    )
    # a generator of one row a unit: a filter on what was found stops here, and does not repeat the above in its condition
    rest = [c for c in found.columns if c not in KEY]
    return found.select(*KEY, F.inline(F.array(F.struct(*rest))))
