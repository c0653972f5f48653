"""Consensus as a stream: every batch recomputes the units that it touches, and the current table takes their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.consensus import KEY, consensus
from ..sources.current import Current, written


def touched_history(batch: DataFrame, history: Current, number: int, stream: str = "consensus") -> DataFrame:
    """All forms of the units that batch touches, once its own are in history (keyed by election, pu and id); written, as they are read more than once."""
    history.upsert(batch, tag=(stream, number))
    units = batch.select(*KEY).distinct()
    return written(history.read().join(units, KEY, "left_semi"), "touched")


def start(stream: DataFrame, history: str, results: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the current results of all units at results (see Current), one row an election and unit.

    Forms are kept by (election, pu, id), so a form that comes again replaces itself. A batch that runs again finds its
    number in both tables, and changes nothing. trigger: as writeStream takes it, all that is there by default.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        forms = Current(spark, history, [*KEY, "id"])
        out = Current(spark, results, KEY)
        if out.applied("consensus") >= number:
            return
        found = consensus(touched_history(batch, forms, number))
        out.upsert(found.withColumn("batch", F.lit(number).cast("long")), tag=("consensus", number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
