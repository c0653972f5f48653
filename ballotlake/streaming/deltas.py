"""Totals that follow a stream of unit results by what changed, never from the whole history.

Of each unit the votes that it last counted with are kept. A new result takes these out and puts its own in; the differences
are summed by ward, local government, state and country, and added to the current totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.consensus import KEY
from ..sources.current import Current

COUNTED = ("consensus", "single_source", "inec_confirmed")
LEVELS = ("state", "lga", "ward")
TOTAL_KEY = ["election", *LEVELS, "party"]


def newer(results: DataFrame, before: DataFrame | None, statuses=COUNTED) -> DataFrame:
    """election, pu, seq, state, lga, ward, votes, was of the units that results change: votes that count from now on, was (a struct) what counted until now.

    results: election, pu, seq, status, votes, state, lga, ward; before: what was found of each unit until now. A result whose seq is
    not above the last one of its unit changes nothing (a replay, or one that was overtaken); the votes of one whose status does not count are null.
    """
    counts = F.when(F.col("status").isin(*statuses), F.col("votes"))
    last = results.groupBy(*KEY).agg(F.max_by(F.struct("seq", *LEVELS, counts.alias("votes")), "seq").alias("now")).filter("now.seq is not null").select(*KEY, "now.*")
    kept = ["seq", *LEVELS, "votes"]
    was = before if before is not None else last.limit(0)
    was = was.select(*(F.col(k).alias(f"{k}_") for k in KEY), F.struct(*kept).alias("was"))
    same = F.lit(True)
    for k in KEY:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return last.join(was, same, "left").filter("was is null or seq > was.seq").select(*KEY, *kept, "was")


def changes(units: DataFrame) -> DataFrame:
    """election, state, lga, ward, party, n, units: what each unit (see newer) changes, votes and units that give some.

    A unit that moves to another ward is taken out of the old one.
    """
    entries = lambda place, votes, sign: F.transform(F.map_entries(votes), lambda e: F.struct(*(place(c).alias(c) for c in LEVELS), e["key"].alias("party"), (sign * e["value"]).cast("long").alias("n"), F.lit(sign).cast("long").alias("units")))
    gone, came = entries(lambda c: F.col(f"was.{c}"), F.col("was.votes"), -1), entries(F.col, F.col("votes"), 1)
    return units.select("election", F.inline(F.concat(*(F.coalesce(x, F.array()) for x in (gone, came)))))


def start(results: DataFrame, totals: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep TOTAL_KEY, n and units at totals (see Current), null for the levels that a row sums over; units is 0 where none gives votes any more.

    What counts of each unit is a table too, beside the checkpoint's own files. It takes a batch after the totals have: a batch that
    runs again finds the units as they were before it, gives the same changes, and is left out of what has its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = Current(spark, f"{checkpoint}/units", KEY)
        if kept.applied("units") >= number:
            return
        found = newer(batch, kept.read()).persist()
        sets = [["election", "party", *LEVELS[:depth]] for depth in range(len(LEVELS), -1, -1)]
        summed = changes(found).groupingSets(sets, "election", "party", *LEVELS).agg(F.sum("n").alias("n"), F.sum("units").alias("units")).select(*TOTAL_KEY, "n", "units").persist()
        Current(spark, totals, TOTAL_KEY).upsert(summed, add=("n", "units"), tag=("totals", number))
        kept.upsert(found.drop("was"), tag=("units", number))
        summed.unpersist()
        found.unpersist()

    return results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
