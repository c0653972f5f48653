"""What a results dashboard shows: parties with support and seats, winners, turnout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .consensus import VERIFIED

ALL = "_all"  # the scope of the whole country


def _sums(live: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """scope (a state, or ALL), party, n, from one pass over the verified units."""
    votes = live.filter(F.col("status").isin(*statuses)).select(F.col("state").cast("string").alias("state"), F.explode("votes").alias("party", "n"))
    sums = votes.groupingSets([["state", "party"], ["party"]], "state", "party").agg(F.sum("n").alias("n"), F.grouping("state").alias("over"))
    return sums.select(F.when(F.col("over") == 1, ALL).otherwise(F.col("state")).alias("scope"), "party", "n")


def support(votes: Column, whole: Column) -> Column:
    """The share of all votes; 0 where there are none."""
    return F.when(whole > 0, votes / whole).otherwise(F.lit(0.0))


def seats_of(share: Column, seats: Column) -> Column:
    """A share of the seats, rounded half up; null where the election gives none."""
    return F.floor(share * seats + F.lit(0.5)).cast("long")


def standings(live: DataFrame, seats: DataFrame, parties: Sequence[tuple[str, str]], statuses: Sequence[str] = VERIFIED) -> DataFrame:
    """scope, place, party, name, votes, support_pct, seats: each of parties (code, name) in every state and in the country.

    live: state, status, votes. seats: scope, seats (null where there are none to share out). Scopes come from both sides; a
    party without votes has 0, and one that is not in parties has no row but counts in the whole. Ties keep the order of parties.
    """
    held = _sums(live, statuses).groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("party", "n"))).alias("votes"), F.sum("n").alias("whole"))
    listed = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(code).alias("party"), F.lit(name).alias("name")) for i, (code, name) in enumerate(parties)))
    rows = seats.select(F.col("scope").cast("string").alias("scope"), "seats").join(held, "scope", "full").select("scope", "seats", "whole", "votes", F.inline(listed))
    rows = rows.withColumn("votes", F.coalesce(F.try_element_at("votes", "party"), F.lit(0)).cast("long"))
    share = support(F.col("votes"), F.col("whole"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("votes"), "at"))  # a row a party
    return rows.select("scope", place.alias("place"), "party", "name", "votes", (share * 100).alias("support_pct"), seats_of(share, F.col("seats")).alias("seats"))


def winners(live: DataFrame, statuses: Sequence[str] = VERIFIED) -> DataFrame:
    """scope, winner: the party with most votes, then the first by name, in each state with votes and in the country."""
    return _sums(live, statuses).groupBy("scope").agg(F.min_by("party", F.struct(-F.col("n"), "party")).alias("winner"))


def headline(live: DataFrame, statuses: Sequence[str] = VERIFIED) -> DataFrame:
    """One row: units_total, units_completed, total_valid_votes, total_rejected_ballots, total_registered_voters, total_accredited_voters, turnout_pct.

    live: status, votes, rejected, registered, accredited. Votes, ballots and accredited voters are those of verified units,
    registered voters those of all. Turnout is accredited by registered voters, 0 without any.
    """
    verified = F.col("status").isin(*statuses)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    of = lambda c: F.when(verified, c)
    cast = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, n: a + n)
    row = live.agg(
        F.count("*").alias("units_total"), F.count_if(F.col("status") != "no_data").alias("units_completed"), total(of(cast), "total_valid_votes"), total(of(F.col("rejected")), "total_rejected_ballots"),
        total(F.col("registered"), "total_registered_voters"), total(of(F.col("accredited")), "total_accredited_voters"),
    )
    return row.withColumn("turnout_pct", support(F.col("total_accredited_voters"), F.col("total_registered_voters")) * 100)
