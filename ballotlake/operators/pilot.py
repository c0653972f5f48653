"""Whether a trial run of the scraper was good enough for a full one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("success", "not_uploaded", "image_blocked", "unparseable", "error")
SHIP, LOW = 0.9, 0.5


def _issues(attempted: Column, succeeded: Column, blocked: Column, odd: Column, broken_seq: Column) -> Column:
    """What speaks against a full scrape, with its figure after a colon where it has one; of failures the worst kind only."""
    rate = F.when(attempted > 0, succeeded / attempted).otherwise(0.0)
    none = (succeeded == 0) & (attempted > 0)
    with_figure = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    found = [
        F.when(attempted == 0, F.lit("nothing attempted")),
        F.when(none & (blocked == attempted), F.lit("all blocked")).when(none, F.lit("none succeeded")).when(blocked > 0, with_figure("blocked", blocked)),
        F.when(broken_seq.isNotNull(), with_figure("log broken at", broken_seq)),
        F.when((rate > 0) & (rate < LOW), with_figure("low success percent", F.round(rate * 100, 1))),
        F.when(odd > 0, with_figure("unknown shapes", odd)),
    ]
    return F.array_compact(F.array(*found))


def verdicts(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """run, a count of each outcome, attempted, success_pct, coverage_pct, issues, ship of every run.

    attempts: run, outcome (OUTCOMES; any other counts as an error). runs: run, registry (units that there are), broken_seq
    (the first row of the log that does not hold, null if all do). A run without attempts has an issue of its own. Ready
    for a full scrape is a run without issues of which nine in ten attempts succeeded.
    """
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("error")
    counts = attempts.groupBy("run").agg(F.count("*").alias("attempted"), *(F.count_if(known == o).alias(o) for o in OUTCOMES))
    rows = runs.join(counts, "run", "left").fillna(0, ["attempted", *OUTCOMES])
    percent = lambda of: F.when(of > 0, F.round(100 * F.col("success") / of, 2)).otherwise(0.0)
    c = F.col
    rows = rows.withColumns({"success_pct": percent(c("attempted")), "coverage_pct": percent(c("registry"))})
    rows = rows.withColumn("issues", _issues(c("attempted"), c("success"), c("image_blocked"), c("unparseable"), c("broken_seq")))
    ready = (F.size("issues") == 0) & (c("attempted") > 0) & (c("success") >= SHIP * c("attempted"))
    return rows.select("run", *OUTCOMES, "attempted", "success_pct", "coverage_pct", "issues", ready.alias("ship"))
