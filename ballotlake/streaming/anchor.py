"""Anchors of the log: every so often what has come since the last one gets a Merkle root, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..sources.current import Current

ANCHORS = "start_seq long, end_seq long, merkle_root string, leaf_count long, status string"


def anchors(spark: SparkSession, path: str) -> Current:
    return Current(spark, path, ["start_seq"], 1)


def pick_up(log: DataFrame, table: Current, least: int = 1, number: int | None = None) -> bool:
    """Anchor the rows of log (seq, log_hash) after the last anchor as one pending row; False if too few wait.

    What is picked ends at the log's last row as it is now, so rows that come meanwhile wait for the next anchor. A
    second run finds the first one's row and picks what comes after it; a run of a batch number that is in does nothing.
    """
    if number is not None and table.applied("anchors") >= number:
        return False
    done = table.read()
    done = done if done is not None else log.sparkSession.createDataFrame([], ANCHORS)
    last, end = done.agg(F.max("end_seq")).first()[0] or 0, log.agg(F.max("seq")).first()[0] or 0
    rows = log.filter(F.col("seq").between(last + 1, end))
    if rows.count() < max(1, least):
        return False
    return table.upsert(audit.anchor(rows).withColumn("status", F.lit("pending")), tag=None if number is None else ("anchors", number))


def confirm(table: Current, receipts: DataFrame) -> None:
    """Pending anchors that a receipt (start_seq) names become confirmed; others, and unknown receipts, stay as they are."""
    done = table.read()
    if done is not None:
        table.upsert(done.filter("status = 'pending'").join(receipts.select("start_seq"), "start_seq", "left_semi").withColumn("status", F.lit("confirmed")).select(*done.columns))


def start(log: DataFrame, path: str, table: str, checkpoint: str, least: int = 1, **trigger) -> StreamingQuery:
    """Pick up what waits in the log at path whenever the stream log, which reads the same folder, has new rows: every 30 minutes by default."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pick_up(spark.read.schema(batch.schema).parquet(path), anchors(spark, table), least, number)

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 minutes"})).start()
