"""Mixing sources to target weights by subset-sum budget fitting.

A source's documents are counted by exact length, each as often as it may be taken. A proportional share of
each length is taken, larger lengths then fill what is left, and a bounded knapsack over length counts
reaches the rest as nearly as it can. The documents of a length share its takes evenly; which of them have
one more than others follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
RANKED = 4096  # documents of one source and length that are ranked in one task, about
_REACH = 1 << 17  # words left over that the dynamic program covers; larger takes fill all above it first
_STEPS = 4000  # binary parts of length counts that the program adds, at most; each keeps one bit set of _REACH


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: of one row per source (source, source_size).

    Sources go by code point, null last; weights repeat. A source is capped at epochs times its size if the
    share of the rest, once all with a lower cap per weight have theirs, would be above its cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    rows = rows.withColumn("cap", epochs * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    capped = (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) * F.col("w") >= F.col("cap") * (F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    rows = rows.withColumn("capped", capped)
    rest = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    rest_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - rest) * F.col("w") / rest_w).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their sum comes as near to budget as is found.

    A proportional share is taken first; where the rest cannot be reached exactly, documents of every size
    are given back, more each time, and the program runs again over what is then free.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    share = (counts * (budget / total)).astype(np.int64)
    best, miss, back = share, budget - int((share * sizes).sum()), 0
    while True:
        take = _fill(sizes, counts, np.maximum(share - back, 0), budget)
        off = abs(budget - int((take * sizes).sum()))
        if off < miss or not back:
            best, miss = take, off
        if not miss or back >= share.max() or int((np.minimum(share, back) * sizes).sum()) > _REACH:
            return best
        back = 4 * back + 1


def _fill(sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int) -> np.ndarray:
    """take, and what a bounded knapsack over the free documents adds."""
    take = take.copy()
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes)
    for i in order[sizes[order] > 0]:  # larger ones fill the rest down to what the program covers
        if left <= _REACH // 2:
            break
        more = min(int(counts[i] - take[i]), (left - _REACH // 4) // int(sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    reach = left + int(sizes[sizes > 0].min())
    mask = (1 << (reach + 1)) - 1
    reached, steps = 1, []
    for i in order[::-1]:
        size, free = int(sizes[i]), int(counts[i] - take[i])
        if size <= 0 or size > reach:
            continue
        free = min(free, reach // size)
        part = 1
        while free > 0:  # 1, 2, 4 ... copies and a rest make every number of copies
            n = min(part, free)
            steps.append((i, n, reached))
            reached |= (reached << (size * n)) & mask
            free, part = free - n, part * 2
        if reached >> left & 1 or len(steps) > _STEPS:
            break
    low = (reached & ((1 << (left + 1)) - 1)).bit_length() - 1
    high = reached >> (left + 1)
    goal = low
    if high and (near := (high & -high).bit_length()) < left - low:
        goal = left + near
    for i, n, without in reversed(steps):
        if not without >> goal & 1:
            take[i] += n
            goal -= n * int(sizes[i])
    return take


def sized(docs: DataFrame) -> DataFrame:
    """Every column of docs, and size: the words of the text, 0 for null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "source", F.coalesce("text", F.lit("")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, size, draw, source_size, target, passes, taken of every row of docs (doc_id, source, text, any others).

    passes: how often the mix holds the row; taken: passes times its size. Null texts have size 0 and a null
    source is a source. An empty table gives no row. Who has one pass more follows draw, a hash of seed, doc_id,
    source and text, so the layout of docs has no say; rows that share all three are alike, and any of them may have it.
    """
    rows = materialize(sized(docs).select(F.col("doc_id").cast("long"), "source", "size", _draw(seed).alias("draw"), F.monotonically_increasing_id().alias("row")), "mix")
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    target = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, epochs)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        whole, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        take = fit(size, n * epochs, round(goal))
        return pd.DataFrame({"source": pdf["source"], "size": size, "n": n, "source_size": whole, "target": goal, "full": take // n, "more": take % n})

    both = counted.join(target.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chosen = materialize(both.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, full int, more long"), "mix-plan")
    p = chosen.withColumnRenamed("source", "s").withColumnRenamed("size", "z").withColumn("groups", F.ceil(F.col("n") / RANKED).cast("long"))
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z").withColumn("part", F.pmod(F.xxhash64("draw"), F.col("groups")))
    # a group of one length is dealt into parts; only the part in which the last document falls is ranked
    parts = chosen.filter("more > 0 and more < n").select("source", "size", "more", F.ceil(F.col("n") / RANKED).cast("long").alias("groups"))
    split = rows.join(parts.select(F.col("source").alias("s"), F.col("size").alias("z"), "more", "groups"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z").withColumn("part", F.pmod(F.xxhash64("draw"), F.col("groups")))
    w = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = split.groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.first("more").alias("more")).withColumn("ahead", F.coalesce(F.sum("m").over(w), F.lit(0)))
    quota = ahead.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("q"), F.greatest(F.lit(0), F.least("m", F.col("more") - F.col("ahead"))).alias("quota"), "m")
    ranked = joined.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("q")), "left").drop("s", "z", "q")
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "row"))
    passes = F.col("full") + F.when(F.col("more") >= F.col("n"), 1).when(place <= F.coalesce("quota", F.lit(0)), 1).otherwise(0)
    return ranked.withColumn("passes", passes.cast("long")).select("doc_id", "size", "draw", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """The rows of docs, all their columns, each as often as the mix holds it.

    Rows are told apart by id, source and text, so rows with one id or none keep their own passes; rows alike in
    all three come as often as their passes together. Texts meet their number by one shuffle at every size.
    """
    own, draw, times, copy = (fresh(docs, x) for x in ("own", "draw", "times", "copy"))
    plan = mix(docs, weights, epochs, seed).groupBy("doc_id", "draw").agg(F.count("*").alias("alike"), F.sum("passes").cast("int").alias("passes"))
    plan = materialize(plan.filter("passes > 0"), "mix-passes")
    plan = plan.select(F.col("doc_id").alias(own), F.col("draw").alias(f"{draw}_"), F.col("passes").alias(times), "alike")
    keyed = docs.withColumn(draw, _draw(seed))

    def expand(rows: DataFrame, part: DataFrame) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(draw) == F.col(f"{draw}_"))
        return rows.join(part.drop("alike").hint("merge"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)

    taken, repeated = expand(keyed, plan.filter("alike = 1")), plan.filter("alike > 1")
    return taken if repeated.isEmpty() else taken.unionByName(expand(keyed.dropDuplicates(["doc_id", draw]), repeated))
