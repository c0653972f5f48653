"""Events of all elections, sent on to those who follow one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names under which kinds of event go out, and their fields in order.
KINDS = {
    "verified_result": ("verified_result", ("pu_code", "status")),
    "submission.extracted": ("submission_extracted", ("submission_id", "pu_code", "confidence", "anomaly_count")),
    "submission.failed": ("submission_failed", ("submission_id", "pu_code", "error")),
}
SENT = "election_id string, event string, data string"


def _by_kind(value) -> Column:
    out = F.lit(None).cast("string")
    for kind, (name, fields) in KINDS.items():
        out = F.when(F.col("type") == kind, value(name, fields)).otherwise(out)
    return out


def messages(events: DataFrame) -> DataFrame:
    """election_id, event, data (JSON, without fields that are null) of the kinds that go out; others are dropped. Works on streams.

    An event without an election, or with an empty one, is for all: its election_id is null.
    """
    election = F.when(F.col("election_id") != "", F.col("election_id")).alias("election_id")
    event, data = _by_kind(lambda name, _: F.lit(name)), _by_kind(lambda _, fields: F.to_json(F.struct(*fields)))
    return events.filter(F.col("type").isin(*KINDS)).select(election, event.alias("event"), data.alias("data"))


def start(events: DataFrame, path: str, checkpoint: str, **trigger):
    """A query that writes messages of the stream events to path, a folder an election; each event once, also after a restart."""
    return messages(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("election_id").trigger(**trigger).start()


def follow(spark: SparkSession, path: str, election: str, stream: bool = False) -> DataFrame:
    """event, data, frame (as text for a push channel) of one election and of what is for all; as a stream of what is new, if asked."""
    reader = (spark.readStream if stream else spark.read).schema(SENT)
    rows = reader.parquet(path).filter(F.col("election_id").isNull() | (F.col("election_id") == election))
    return rows.select("event", "data", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("frame"))
