"""What collation forms state against what the units' results add up to, and the dashboard's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.current import written

PATH = ("state", "lga", "ward", "pu")
LEVELS = ("nation", *PATH)
COUNTED = ("consensus", "single_source", "inec_confirmed")

#: The type of a stated total that the units cannot give, by level.
FABRICATED = {"ward": "WARD_TOTAL_FABRICATED", "lga": "LGA_TOTAL_FABRICATED", "state": "STATE_TOTAL_FABRICATED", "nation": "DECLARATION_CONFLICT"}


def tier(coverage_pct: Column) -> Column:
    """How a divergence is treated at a share of units that report."""
    return F.when(coverage_pct < 30, "insufficient").when(coverage_pct < 50, "early").when(coverage_pct < 75, "significant").when(coverage_pct < 90, "strong").otherwise("verified")


def divergences(declared: DataFrame, computed: DataFrame, coverage: DataFrame) -> DataFrame:
    """code, party, declared, computed, difference, tier where totals (code, party, n) differ; a missing total is 0."""
    both = declared.select("code", "party", F.col("n").alias("declared")).join(computed.select("code", "party", F.col("n").alias("computed")), ["code", "party"], "full").fillna(0, ["declared", "computed"])
    off = both.withColumn("difference", F.col("declared") - F.col("computed")).filter("difference <> 0")
    return off.join(coverage.select("code", "coverage_pct"), "code", "left").withColumn("tier", tier(F.coalesce("coverage_pct", F.lit(0.0)))).drop("coverage_pct")


def _level() -> Column:
    """The level of a row by the deepest of PATH that it names."""
    out = F.when(F.col("pu").isNotNull(), "pu")
    for level in ("ward", "lga", "state"):
        out = out.when(F.col(level).isNotNull(), level)
    return out.otherwise("nation")


def compared(forms: DataFrame, live: DataFrame, statuses=COUNTED) -> DataFrame:
    """level, PATH, party, stated, rows, computed, units, verified, room: what forms state beside what units give, in one grouping.

    forms: PATH, party, n, own: with own null, the total that a place's form states (null in PATH below the place); with
    own true, one of the rows that this form lists and should add up to that total. A form's rows of units are
    the totals of units (pu not null). live: units with status and votes. computed: votes of units whose status counts, summed
    upwards; units and verified: how many there are and count; room: the registered voters of those that do not.
    Everything is summed by place and party first, where rows are, and then by place: a place's parties are one row.
    Written once, as detect and localise both read it.
    """
    kinds = {c: live.schema[c].dataType for c in PATH}
    counts = F.col("status").isin(*statuses) & F.col("votes").isNotNull()
    unit = F.struct(F.lit(None).cast("string").alias("party"), F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("units"), counts.cast("long").alias("verified"), F.when(counts, 0).otherwise(F.coalesce("registered", F.lit(0))).cast("long").alias("room"))
    zero = F.lit(0).cast("long")
    voted = F.transform(F.map_entries(F.when(counts, F.col("votes"))), lambda e: F.struct(e["key"].alias("party"), e["value"].cast("long").alias("n"), zero.alias("units"), zero.alias("verified"), zero.alias("room")))
    units = live.select(*PATH, F.inline(F.concat(F.array(unit), F.coalesce(voted, F.array()))))
    sets = [["party", *PATH[:depth]] for depth in range(len(PATH), -1, -1)]
    given = units.groupingSets(sets, "party", *PATH).agg(F.sum("n").alias("computed"), *(F.sum(c).alias(c) for c in ("units", "verified", "room")))
    none = F.lit(None).cast("long")
    said = forms.select(*(F.col(c).cast(kinds[c]).alias(c) for c in PATH), "party", F.when(F.col("own").isNull(), F.col("n")).alias("stated"), F.when(F.col("own"), F.col("n")).alias("rows"), none.alias("computed"), zero.alias("units"), zero.alias("verified"), zero.alias("room"))
    both = given.select(*PATH, "party", none.alias("stated"), none.alias("rows"), "computed", "units", "verified", "room").unionByName(said)
    by_party = both.groupBy(*PATH, "party").agg(*(F.sum(c).alias(c) for c in ("stated", "rows", "computed", "units", "verified", "room")))
    place = by_party.groupBy(*PATH).agg(F.collect_list(F.when(F.col("party").isNotNull(), F.struct("party", "stated", "rows", "computed"))).alias("each"), *(F.sum(c).alias(c) for c in ("units", "verified", "room")))
    return written(place.select(_level().alias("level"), *PATH, "units", "verified", "room", F.inline("each")), "compared")


def detect(base: DataFrame) -> DataFrame:
    """type, level, PATH, party, declared, computed, difference, coverage_pct, tier of the divergences in base (see compared).

    PU_ROW_ALTERED: a unit that counts has other figures on the ward's form, whatever the coverage; rows of units that do not
    count say nothing. A place's total is FABRICATED, and the country's in DECLARATION_CONFLICT, if no votes of the units
    that do not count can make it up: it is under what the others have, or over that and all their registered voters.
    INTERNAL_ARITHMETIC_ERROR: a form's rows do not add up to its total; its declared is the total, its computed the rows' sum.
    """
    c = F.col
    stated, computed = c("stated"), F.coalesce("computed", F.lit(0))
    coverage = F.when(c("units") > 0, F.round(100 * c("verified") / c("units"), 2)).otherwise(0.0)
    altered = (c("level") == "pu") & (c("verified") > 0) & (stated != computed)
    impossible = (c("level") != "pu") & ((stated < computed) | (stated > computed + c("room")))
    kind = F.coalesce(*(F.when(c("level") == level, name) for level, name in FABRICATED.items()))
    found = lambda type_, than, when: F.when(when, F.struct(type_.alias("type"), than.alias("against")))
    each = F.array_compact(F.array(found(F.lit("PU_ROW_ALTERED"), computed, altered), found(kind, computed, impossible), found(F.lit("INTERNAL_ARITHMETIC_ERROR"), c("rows"), (c("level") != "pu") & (c("rows") != stated))))
    rows = base.withColumn("coverage_pct", coverage).select("level", *PATH, "party", stated.alias("declared"), "coverage_pct", F.inline(each))
    return rows.select("type", "level", *PATH, "party", "declared", F.col("against").alias("computed"), (c("declared") - c("against")).alias("difference"), "coverage_pct", tier(c("coverage_pct")).alias("tier"))


def localise(base: DataFrame) -> DataFrame:
    """level, PATH, party, difference (stated less computed) of the places below the country where they differ, each only within places that differ for the same party.

    Of units, only those that count are named. A row asks for each place above it, so all levels are one join.
    """
    differ = F.coalesce("stated", F.lit(0)) - F.coalesce("computed", F.lit(0))
    off = base.filter("level <> 'nation' and party is not null and (level <> 'pu' or verified > 0)").withColumn("difference", differ).filter("difference <> 0")
    own = F.struct(*PATH, "party")
    depth = F.array_position(F.array(*map(F.lit, PATH)), F.col("level")).cast("int")
    above = F.array(*(F.when(F.lit(d) < depth, F.struct(*(F.col(c) if i < d else F.lit(None).cast(base.schema[c].dataType).alias(c) for i, c in enumerate(PATH)), "party")) for d in range(1, len(PATH))))
    asked = off.select("level", *PATH, "party", "difference", depth.alias("depth"), F.explode(F.concat(F.array(own), F.array_compact(above))).alias("place"))
    there = off.select(own.alias("there"))
    met = asked.join(there, F.col("place") == F.col("there"), "left_semi")
    return met.groupBy("level", *PATH, "party", "difference", "depth").agg(F.count("*").alias("n")).filter("n = depth").drop("n", "depth")


def dashboard(totals: DataFrame, seats: int) -> DataFrame:
    """party, votes, support_pct, seats of totals (party, n); no votes give no support. The window holds one row a party."""
    votes = totals.groupBy("party").agg(F.sum("n").alias("votes"))
    support = F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(0.0)
    return votes.withColumn("total", F.sum("votes").over(Window.partitionBy())).select("party", "votes", (support * 100).alias("support_pct"), F.floor(support * seats + 0.5).alias("seats"))
