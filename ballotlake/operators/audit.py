"""A hash-chained log, canonical JSON, Merkle roots and anchors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.current import written

ZEROS = "0" * 64
GENESIS = "chain.genesis"
SAID = ("event_type", "entity_type", "entity_id", "actor_id", "event_at", "event_data")
BLOCK = 1024  # leaves of a Merkle tree that one row holds: a power of two
STAGES = 4  # BLOCK ** STAGES leaves a tree


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, no white space and all letters as they are; null where it is no JSON.

    Of equal keys the last one counts. Keys are ordered by code points, numbers are written as Python writes them.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical)

    return canonical(text)


def link_hash(prev: Column) -> Column:
    """sha256 of the previous hash and the row's fields; event_data is canonical text."""
    return F.sha2(F.concat(prev, *(F.coalesce(c, F.lit("")) if c == "actor_id" else F.col(c) for c in SAID)), 256)


def broken(log: DataFrame, span: int = 1_000_000) -> DataFrame:
    """seq of every row whose link or own hash does not hold. Ranges of seq are checked apart; each takes its
    predecessor's hash from the last row of the nearest range below, so gaps in seq do no harm. event_data may be
    written in any way, as its canonical form is hashed; what is no JSON is broken."""
    ranged = log.withColumns({"part": F.floor(F.col("seq") / span), "event_data": canonical_json(F.col("event_data"))})
    last = ranged.groupBy("part").agg(F.max_by("log_hash", "seq").alias("tail"))
    ends = last.withColumn("before", F.lag("tail", 1, ZEROS).over(Window.orderBy("part"))).select("part", "before")
    prev = F.coalesce(F.lag("log_hash").over(Window.partitionBy("part").orderBy("seq")), F.col("before"))
    rows = ranged.join(ends, "part").withColumn("expected", prev)
    good = (F.col("prev_hash") == F.col("expected")) & (link_hash(F.col("prev_hash")) == F.col("log_hash"))
    return rows.filter((F.col("event_type") != GENESIS) & ~F.coalesce(good, F.lit(False))).select("seq")


def append(events: DataFrame, prev: str = ZEROS, chain: Sequence[str] = ()) -> DataFrame:
    """All events, in the order of seq, with prev_hash and log_hash; each chain (by these columns, or one for all) starts from prev.

    A link needs the one before it, so a chain is one task's work; its rows stream through in order and none are held.
    Chains apart from each other run side by side. event_data is stored in its canonical form. prev is the
    last stored hash, so what is appended later goes on from there.
    """
    rows = events.withColumn("event_data", canonical_json(F.col("event_data")))
    by = list(chain)
    dealt = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "seq")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, prev
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*by, *SAID)]
            before, after = [], []
            for row in zip(*columns):
                if row[: len(by)] != own:
                    own, last = row[: len(by)], prev
                said = "".join(x if x is not None else "" for x in row[len(by) :])
                before.append(last)
                last = hashlib.sha256((last + said).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names, "prev_hash", "log_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(link, f"{schema}, prev_hash string, log_hash string")


def genesis(name: Column) -> Column:
    """The hash of a log's first row."""
    return F.sha2(F.concat(F.lit(ZEROS), F.lit(GENESIS), F.lit("system"), name), 256)


def numbered(rows: DataFrame, span: int = 1_000_000, by: Sequence[str] = ()) -> DataFrame:
    """rows with at, their place from 0 in the order of seq, in each group of by. Ranges of seq are numbered apart and moved by what lies below."""
    ranged = rows.withColumn("part", F.floor(F.col("seq") / span))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = ranged.groupBy(*by, "part").agg(F.count("*").alias("n")).select(*by, "part", below.alias("ahead"))  # a row a range
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy("seq")) - 1
    return ranged.withColumn("place", place).join(ahead, [*by, "part"]).withColumn("at", F.col("place") + F.col("ahead")).drop("part", "place", "ahead")


def _twice(value: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(F.sha2(value, 256)), 256))


def _paired(layer: Column) -> Column:
    """The layer above: each pair hashed, an odd last one with itself."""
    left = lambda i: F.get(layer, 2 * i)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(layer) + 1) / 2).cast("int") - 1), lambda i: _twice(F.concat(left(i), F.coalesce(F.get(layer, 2 * i + 1), left(i)))))


def merkle_roots(leaves: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, merkle_root, leaf_count of leaves (batch, at from 0 in each, hash as hex): double SHA-256 of pairs.

    Leaves meet in aligned blocks of BLOCK, each hashed up in one row as far as a tree of its own size goes; the blocks'
    roots are the leaves of the next of STAGES stages. A block that is not full is hashed up as high as the full
    ones if there are others, which is where its duplicates would stand in the whole tree. A lone leaf is its own root.
    The blocks of leaves are written, so that leaves are computed once.
    """
    height = BLOCK.bit_length() - 1

    def blocks(layer: DataFrame) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct("at", "hash")))
        return layer.groupBy(batch, F.floor(F.col("at") / BLOCK).alias("at")).agg(F.count("*").alias("held"), F.transform(held, lambda x: x["hash"]).alias("layer"))

    first = written(blocks(leaves.select(batch, "at", F.unhex("hash").alias("hash"))), "merkle")
    total = first.groupBy(batch).agg(F.sum("held").alias("total"))
    layer = None
    for stage in range(STAGES):
        nodes = F.ceil(F.col("total") / BLOCK**stage)
        up = F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.col("layer"), lambda acc, _: F.when((F.size(acc) > 1) | (nodes > BLOCK), _paired(acc)).otherwise(acc))  # noqa: B023
        layer = (first if layer is None else blocks(layer)).join(total, batch).select(batch, "at", F.get(up, F.lit(0)).alias("hash"))
    return layer.join(total, batch).select(batch, F.lower(F.hex("hash")).alias("merkle_root"), F.col("total").alias("leaf_count"))


def merkle_root(leaves: DataFrame, span: int = 1_000_000) -> str:
    """The root over leaves (seq, hash) in the order of seq; zeros for none."""
    row = merkle_roots(numbered(leaves, span).withColumn("batch", F.lit(0))).first()
    return row["merkle_root"] if row else ZEROS


def waiting(log: DataFrame, anchored: DataFrame, least: int = 1) -> DataFrame:
    """All rows of log (seq, ...) after the last anchored one (end_seq; 0 for none); none if fewer than least wait."""
    last = anchored.agg(F.coalesce(F.max("end_seq"), F.lit(0)).alias("last"))
    rows = log.join(F.broadcast(last), F.col("seq") > F.col("last")).drop("last")  # last is one row
    enough = rows.agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return rows.join(F.broadcast(enough), F.lit(True)).drop("n")  # at most one row


def anchor(rows: DataFrame, span: int = 1_000_000) -> DataFrame:
    """start_seq, end_seq, merkle_root, leaf_count of rows (seq, log_hash), one row; none without rows."""
    leaves = numbered(rows.select("seq", F.col("log_hash").alias("hash")), span).withColumn("batch", F.lit(0))
    ends = rows.agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq")).withColumn("batch", F.lit(0))
    return merkle_roots(leaves).join(ends, "batch").select("start_seq", "end_seq", "merkle_root", "leaf_count")
