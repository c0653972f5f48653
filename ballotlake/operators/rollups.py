"""Status counts and votes by ward, local government, state and country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.current import written
from .consensus import VERIFIED

STATUSES = ("no_data", "single_source", "inec_published", "consensus", "discrepancy", "inec_confirmed", "inec_conflict")


def live_status(units: DataFrame, results: DataFrame, election: str) -> DataFrame:
    """Every unit with its status in one election; the election is chosen before the left join, so none is lost."""
    chosen = results.filter(F.col("election") == election).drop("election")
    return units.join(chosen, "pu", "left").withColumn("status", F.coalesce("status", F.lit("no_data")))


def status_code() -> F.Column:
    """The status as its place in STATUSES."""
    out = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(STATUSES):
        out = out.when(F.col("status") == s, F.lit(i))
    return out.cast("long")


def buckets(live: DataFrame, level: str) -> DataFrame:
    """total_pus and a count of each status but no_data, by region."""
    return live.groupBy(F.col(level).cast("string").alias("code")).agg(F.count("*").alias("total_pus"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]))


def party_totals(live: DataFrame, level: str, statuses=VERIFIED) -> DataFrame:
    """code, party, n: votes of verified units."""
    rows = live.filter(F.col("status").isin(*statuses)).select(F.col(level).cast("string").alias("code"), F.explode("votes").alias("party", "n"))
    return rows.groupBy("code", "party").agg(F.sum("n").alias("n"))


def region_aggregates(live: DataFrame, level: str) -> DataFrame:
    """Status counts, total votes, leader (votes, then name) and its share (4 places, null without votes), zero-filled."""
    totals = party_totals(live, level)
    sums = totals.groupBy("code").agg(F.sum("n").alias("total_votes"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "party"))
    lead = totals.withColumn("at", place).filter("at = 1").select("code", F.col("party").alias("leader"), F.col("n").alias("leader_votes"))
    rows = buckets(live, level).join(sums, "code", "left").join(lead, "code", "left")
    share = F.when(F.col("total_votes") > 0, F.round(F.col("leader_votes") / F.col("total_votes"), 4))
    return rows.withColumn("leader_share", share).fillna(0, ["total_votes", "leader_votes"]).withColumn("level", F.lit(level))


def region_rows(dimension: DataFrame, live: DataFrame, level: str, statuses=VERIFIED) -> DataFrame:
    """A row for every place of dimension (code, name, parent_code, state_code), whether it has units or not.

    level, code, name, parent_code, state_code, pu_count, units_reporting, a count of each status, centroid_lng and
    centroid_lat of its units (live has lng, lat), leader_party (most votes of verified units, then name), leader_share (4
    places), party_totals_json. Counts are 0 and all else null without units.
    """
    code = F.col(level).cast("string").alias("code")
    counts = live.groupBy(code).agg(
        F.count("*").alias("pu_count"), F.count_if(F.col("status") != "no_data").alias("units_reporting"), *(F.count_if(F.col("status") == s).alias(f"units_{s}") for s in STATUSES[1:]),
        F.avg("lng").alias("centroid_lng"), F.avg("lat").alias("centroid_lat"),
    )
    each = party_totals(live, level, statuses).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("party", "n"))).alias("each"), F.min_by("party", F.struct(-F.col("n"), "party")).alias("leader_party"), F.max("n").alias("most"), F.sum("n").alias("whole"))
    share = F.when(F.col("whole") > 0, F.round(F.col("most") / F.col("whole"), 4)).alias("leader_share")
    lead = each.select("code", "leader_party", share, F.to_json(F.map_from_entries("each")).alias("party_totals_json"))
    zero = ["pu_count", "units_reporting", *(f"units_{s}" for s in STATUSES[1:])]
    rows = dimension.join(counts, "code", "left").join(lead, "code", "left").fillna(0, zero).fillna("{}", ["party_totals_json"])
    return rows.select(F.lit(level).alias("level"), "code", "name", "parent_code", "state_code", *zero, "centroid_lng", "centroid_lat", "leader_party", "leader_share", "party_totals_json")


#: Statuses that the roll-ups of states and of the country count.
COUNTS = ("consensus", "discrepancy", "inec_confirmed", "inec_conflict")


def state_rollup(units: DataFrame, results: DataFrame, names: DataFrame) -> DataFrame:
    """election, state, name, units_reporting, units_total, a count of each of COUNTS and party_totals (JSON) by election and state.

    Units without a result count under a null election; states without units, or without a name (state, name), have no row.
    Party totals are those of units in consensus or confirmed, null where there are none.
    """
    rows = units.select("pu", "state").join(results.select("election", "pu", "status", "votes"), "pu", "left")
    key = ["election", "state"]
    # a unit is a row without a party, and one for each party of its votes: one pass gives counts and totals
    unit = F.array(F.struct(F.lit(None).cast("string").alias("party"), F.lit(None).cast("long").alias("n")))
    votes = F.transform(F.map_entries("votes"), lambda e: F.struct(e["key"].alias("party"), e["value"].cast("long").alias("n")))
    each = rows.select(*key, "status", F.inline(F.concat(unit, F.coalesce(F.when(F.col("status").isin("consensus", "inec_confirmed"), votes), F.array()))))
    names_ = ["units_reporting", "units_total", *(f"units_{s}" for s in COUNTS)]
    sums = each.groupBy(*key, "party").agg(F.count_if(F.col("status") != "no_data").alias("units_reporting"), F.count("*").alias("units_total"), *(F.count_if(F.col("status") == s).alias(f"units_{s}") for s in COUNTS), F.sum("n").alias("n"))
    named = F.array_sort(F.collect_list(F.when(F.col("party").isNotNull(), F.struct("party", "n"))))
    both = sums.groupBy(*key).agg(*(F.max(F.when(F.col("party").isNull(), F.col(c))).alias(c) for c in names_), named.alias("named"))
    both = both.withColumn("party_totals", F.when(F.size("named") > 0, F.to_json(F.map_from_entries("named"))))
    return both.join(names.select("state", "name"), "state").select("election", "state", "name", "units_reporting", "units_total", *(f"units_{s}" for s in COUNTS), "party_totals")


def national_rollup(states: DataFrame) -> DataFrame:
    """The counts of state_rollup, summed by election."""
    return states.groupBy("election").agg(*(F.sum(c).alias(c) for c in ("units_reporting", "units_total", *(f"units_{s}" for s in COUNTS))))


def bottom_up(live: DataFrame, statuses=("consensus", "single_source", "inec_confirmed")) -> DataFrame:
    """Votes by ward, local government, state and country in one pass; null marks the levels summed over."""
    rows = live.filter(F.col("status").isin(*statuses)).select("state", "lga", "ward", F.explode("votes").alias("party", "n"))
    sets = rows.groupingSets([["party", "state", "lga", "ward"], ["party", "state", "lga"], ["party", "state"], ["party"]], "party", "state", "lga", "ward")
    return sets.agg(F.sum("n").alias("n"))


def turnout(live: DataFrame) -> DataFrame:
    """Units with a result and registered voters: turnout and the leader's share of valid votes."""
    top = F.array_max(F.map_values("votes"))
    leader = F.array_min(F.transform(F.filter(F.map_entries("votes"), lambda e: e["value"] == top), lambda e: e["key"]))
    return live.filter("registered > 0 and votes is not null").select("pu", "state", "lga", "ward", "status", (F.col("cast") / F.col("registered")).alias("turnout"), leader.alias("leader"), (top / F.when(F.col("valid") > 0, F.col("valid"))).alias("leader_share"))


def distribution(rows: DataFrame, level: str, least: int) -> DataFrame:
    """n, mean and sample deviation of turnout by region with at least so many units."""
    return rows.groupBy(level).agg(F.count("*").alias("n"), F.avg("turnout").alias("mean"), F.stddev_samp("turnout").alias("sd")).filter(F.col("n") >= least)


def coverage(live: DataFrame, level: str) -> DataFrame:
    """Percent of units with a result, of these the percent that is verified (0 without any), their product as confidence, and the display class.

    sce_total and sce_total_single: votes of verified units, and with those of a single source.
    """
    n = lambda *statuses: F.count_if(F.col("status").isin(*statuses))
    whole = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, v: a + v)
    votes = lambda *statuses: F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), whole)), F.lit(0))
    good = ("consensus", "inec_confirmed")
    rows = live.groupBy(F.col(level).cast("string").alias("code")).agg(
        (100 * F.count_if(F.col("status") != "no_data") / F.count("*")).alias("covered"), (100 * n(*good) / F.greatest(F.lit(1), F.count_if(F.col("status") != "no_data"))).alias("verified"),
        votes(*good).alias("sce_total"), votes(*good, "single_source").alias("sce_total_single"),
    )
    pct = lambda c: F.round(c, 2)
    display = F.when(F.col("covered") >= 100, "full").when(F.col("covered") >= 50, "partial").otherwise("low")
    sure = pct(F.col("covered") * F.col("verified") / 100)
    return rows.select("code", pct(F.col("covered")).alias("coverage_pct"), pct(F.col("verified")).alias("verified_pct"), sure.alias("sce_confidence"), display.alias("display"), "sce_total", "sce_total_single")


def spread(live: DataFrame, percent: float = 25.0, least: int = 24) -> DataFrame:
    """In how many states each party has at least a quarter of the votes, whether that is in enough of them, and who wins: most votes, then name, if so.

    Votes of states count; nobody wins where the party with most votes is not spread enough.
    """
    totals = party_totals(live, "state")
    whole = totals.groupBy("code").agg(F.sum("n").alias("whole"))
    hit = (F.col("whole") > 0) & (F.col("n") * 100 >= F.col("whole") * percent)
    rows = totals.join(whole, "code").groupBy("party").agg(F.count_if(hit).alias("states"), F.sum("n").alias("votes"))
    first = F.row_number().over(Window.orderBy(F.desc("votes"), "party")) == 1  # a row a party
    return rows.withColumn("spread", F.col("states") >= least).withColumn("wins", first & F.col("spread"))


def everywhere(units: DataFrame, results: DataFrame) -> DataFrame:
    """Every unit with its status in every election that it has a result of; one without any has no election and no data."""
    return units.join(results, "pu", "left").withColumn("status", F.coalesce("status", F.lit("no_data")))


def reporting_percent(live: DataFrame, level: str) -> DataFrame:
    """level, reporting: percent of its units with a result, one place."""
    return live.groupBy(level).agg(F.round(F.count_if(F.col("status") != "no_data") / F.greatest(F.lit(1), F.count("*")) * 100, 1).alias("reporting"))


def with_sum(regions: DataFrame, counts: Sequence[str], code: str = "code", total: str = "_sum") -> DataFrame:
    """code and counts of region rows, and a row of their sums under this code; sums of no regions are 0."""
    sums = regions.agg(F.lit(total).alias(code), *(F.coalesce(F.sum(c), F.lit(0)).cast(regions.schema[c].dataType).alias(c) for c in counts))
    return regions.select(code, *counts).unionByName(sums)


def upload_percent(units: DataFrame, documents: DataFrame, level: str) -> DataFrame:
    """level, pus, documents, percent of its units with a document (a row or more of documents by pu), two places."""
    sent = documents.select("pu").distinct().withColumn("sent", F.lit(True))
    counts = units.join(sent, "pu", "left").groupBy(level).agg(F.count("*").alias("pus"), F.count("sent").alias("documents"))
    return counts.withColumn("percent", F.round(F.col("documents") * 100.0 / F.col("pus"), 2))


def export_rows(live: DataFrame, after=None, **wanted) -> DataFrame:
    """The 19 columns of the results' export, a row a unit and party: live has name, election, computed_at besides.

    wanted restricts columns to values (state=...), after to units beyond this one. Units without votes have no row; a share
    has four places, and is null without valid votes. The image hash is empty: results have no single image.
    """
    rows = live if after is None else live.filter(F.col("pu") > after)
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    valid = F.coalesce("valid", F.lit(0))
    return rows.filter("votes is not null").select("*", F.explode("votes").alias("party", "n")).select(
        F.col("state").alias("state_code"), F.col("lga").alias("lga_code"), F.col("ward").alias("ward_code"), F.col("pu").alias("pu_code"), F.col("name").alias("pu_name"), F.col("election").alias("election_id"),
        F.col("status").alias("verification_status"), "submission_count", "source_count", "party", F.col("n").alias("votes"), F.when(valid > 0, F.round(F.col("n") / valid, 4)).alias("leader_share"),
        "registered_voters", F.col("accredited").alias("accredited_voters"), valid.alias("total_valid_votes"), F.col("rejected").alias("rejected_ballots"), F.col("cast").alias("total_votes_cast"), F.lit("").alias("image_sha256"), "computed_at",
    )


def symbols(regions: DataFrame) -> DataFrame:
    """code, radius, fill and edge of the symbols of region rows (rollups.region_rows).

    The radius grows with the root of a region's units, from 5 to 28 for the largest, or to 18 where all are wards. The
    fill is by the share of units in consensus or confirmed, then by those that report; the edge by conflicts.
    """
    most = regions.agg(F.max(F.greatest("pu_count", F.lit(0))).alias("most_"), F.coalesce(F.bool_and(F.col("level") == "ward"), F.lit(False)).alias("wards_"))
    rows = regions.join(F.broadcast(most), F.lit(True))  # one row
    n = F.greatest("pu_count", F.lit(0))
    radius = F.when(F.col("most_") > 0, 5 + F.sqrt(n) / F.sqrt("most_") * F.when(F.col("wards_"), 13).otherwise(23)).otherwise(5.0)
    verified = (F.col("units_consensus") + F.col("units_inec_confirmed")) / F.nullif(F.col("pu_count"), F.lit(0))
    reports = F.col("units_reporting") / F.nullif(F.col("pu_count"), F.lit(0))
    fill = F.when(F.col("pu_count") == 0, "none").when(verified >= 0.85, "most_verified").when(verified >= 0.5, "half_verified").when(verified >= 0.2, "some_verified")
    fill = fill.when(reports >= 0.5, "half_reporting").when(F.col("units_reporting") > 0, "some_reporting").otherwise("none")
    edge = F.when(F.col("units_inec_conflict") > 0, "conflict").when(F.col("units_discrepancy") > 0, "discrepancy").otherwise("plain")
    return rows.select("code", radius.alias("radius"), fill.alias("fill"), edge.alias("edge"))


def floor_percentiles(rows: DataFrame, group: str, value: str, percents) -> DataFrame:
    """group, percent, value: of each group's n values in order the one at place floor(n percent / 100), the last at most. Nulls do not count.

    Values are sorted by ranges of (group, value) and written; each part counts alone and is moved by what earlier
    parts hold of its group, so no task holds a group. Windows span a row for each part and group only.
    """
    parts = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")).repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    placed = written(parts.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "percentiles")
    held = placed.groupBy("g", "part").agg(F.count("*").alias("held"), F.min("row").alias("first"))
    whole = Window.partitionBy("g")
    ahead = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"ahead": ahead, "n": F.sum("held").over(whole)})
    places = held.select("g", "part", "held", "first", "ahead", "n", F.explode(F.array(*(F.lit(p).cast("long") for p in percents))).alias("percent"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("percent") / 100))
    wanted = places.withColumn("at", at - F.col("ahead")).filter((F.col("at") >= 0) & (F.col("at") < F.col("held"))).select("g", "part", "percent", (F.col("first") + F.col("at")).alias("row"))
    return placed.join(wanted, ["g", "part", "row"]).select(F.col("g").alias(group), "percent", F.col("v").alias("value"))
