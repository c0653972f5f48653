"""Forms that come late: none is refused, the time of capture orders them, and a flag that was raised stays.

There is no watermark, as a form may come days after its result was read out. What a batch leaves behind is a
function of the set of forms that have come, whatever their order: the unit's status and figures from all of them
by time of capture, and flags from each form on its own, which later ones can only deepen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.consensus import KEY, consensus
from ..sources.current import Current, written
from .recompute import touched_history

STICKY = ("flagged", "deepest")


def compare(forms: DataFrame, declared: DataFrame) -> DataFrame:
    """election, pu, status, votes, comparison, flagged, deepest, last_captured, last_uploaded of the units of forms.

    forms: as consensus takes them, with captured_at and uploaded_at; submitted_at is not used. declared: election,
    pu, votes, the figures that the collation form states. comparison: clean, divergent, or insufficient where no votes are
    agreed on or none declared. flagged: some approved form differs from what was declared; deepest: by how many votes at most.
    """
    timed = forms.withColumn("submitted_at", F.coalesce("captured_at", "uploaded_at"))
    stated = declared.select(*KEY, F.col("votes").alias("stated"))
    names = lambda v: F.map_keys(F.coalesce(v, F.create_map().cast("map<string,bigint>")))

    def gap(v):
        """The largest difference of one party's votes."""
        at = lambda m, p: F.coalesce(F.try_element_at(m, p), F.lit(0))
        gaps = F.transform(F.array_union(names(v), names(F.col("stated"))), lambda p: F.abs(at(v, p) - at(F.col("stated"), p)))
        return F.when(F.col("stated").isNotNull() & v.isNotNull(), F.coalesce(F.array_max(gaps), F.lit(0)))

    own = F.when(F.col("approved") & F.col("source_type").isin("party_agent", "observer"), gap(F.col("votes")))
    evidence = timed.join(stated, KEY, "left").groupBy(*KEY).agg(
        F.coalesce(F.max(own), F.lit(0)).cast("long").alias("deepest"), F.max("submitted_at").alias("last_captured"), F.max("uploaded_at").alias("last_uploaded")
    )
    found = consensus(timed).select(*KEY, "status", "votes")
    rows = evidence.join(found, KEY, "left").join(stated, KEY, "left")
    off = gap(F.col("votes"))
    comparison = F.when(off.isNull(), "insufficient").when(off > 0, "divergent").otherwise("clean")
    return rows.select(*KEY, F.coalesce("status", F.lit("no_data")).alias("status"), "votes", comparison.alias("comparison"), (F.col("deepest") > 0).alias("flagged"), "deepest", "last_captured", "last_uploaded")


def declared_of(units: DataFrame) -> DataFrame:
    """election, pu, votes: figures that follow from a unit's number, as the derived election has them without its deviations."""
    pu = F.col("pu")
    votes = F.create_map(F.lit("A"), F.when(F.col("election") == "cur", 1).otherwise(3) * (pu % 50) + 10, F.lit("B"), pu * 7 % 120 + 5, F.lit("C"), F.when(pu % 97 == 0, 4000).otherwise(pu * 13 % 90))
    return units.select(F.explode(F.array(F.lit("cur"), F.lit("base"))).alias("election"), "pu").select(*KEY, votes.alias("votes"))


def updates(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """election, pu, was, now, note of units whose comparison changed; a unit that had none changes from null."""
    was = before.select(*KEY, F.col("comparison").alias("was")) if before is not None else after.select(*KEY, F.lit(None).cast("string").alias("was")).limit(0)
    rows = after.join(was, KEY, "left").filter(~F.col("was").eqNullSafe(F.col("comparison")))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    note = F.concat(F.lit("Comparison updated: new form received for unit "), F.col("pu").cast("string"), F.lit(" (captured "), at("last_captured"), F.lit(", uploaded "), at("last_uploaded"), F.lit(")"))
    return rows.select(*KEY, "was", F.col("comparison").alias("now"), note.alias("note"))


def start(stream: DataFrame, declared: DataFrame, history: str, table: str, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep what compare gives at table (see Current), and append each batch's updates to log, a folder a batch."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = Current(spark, table, KEY)
        if out.applied("late") >= number:
            return
        before = out.read()
        found = written(compare(touched_history(batch, Current(spark, history, [*KEY, "id"]), number, "late"), declared), "found")
        updates(before, found).write.mode("overwrite").parquet(f"{log}/batch={number}")
        out.upsert(found, sticky=STICKY, tag=("late", number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
