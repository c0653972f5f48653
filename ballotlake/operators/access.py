"""Who sees which rows and columns, what is unfinished, and what a map shows at a zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a submission that tell who sent it from where.
IDENTITY = ("submitted_by", "device_fingerprint", "phone", "actor", "reviewer", "gps_lat", "gps_lng")
ADMINS = ("consortium_reviewer", "party_admin")
PENDING, RUNNING = "pending_review", ("queued", "processing")


def public_submissions(submissions: DataFrame) -> DataFrame:
    """Approved submissions without the columns that identify people."""
    return submissions.filter("approved").drop(*IDENTITY)


def visible_agents(agents: DataFrame, viewer: str) -> DataFrame:
    """The rows of agents (id, role, party, any others) that a viewer of this id may see.

    Everyone sees themselves; reviewers and party administrators see all. The viewer's own row is looked up once, and joined as
    one row at most an id.
    """
    own = agents.filter(F.col("id") == viewer).select(F.col("role").alias("role_")).distinct()
    all_ = own.filter(F.col("role_").isin(*ADMINS)).limit(1).select(F.lit(True).alias("all_"))
    return agents.join(F.broadcast(all_), F.lit(True), "left").filter(F.col("all_") | (F.col("id") == viewer)).drop("all_")


#: Parts that a party's agents are dealt over.
BLOCKS = 64


def party_agents(agents: DataFrame) -> DataFrame:
    """admin, id: for each party administrator the agents of the same party, by the party; none for one without a party.

    Administrators times agents are the result's rows. A party's agents are dealt over blocks, and its administrators go to each, so that no
    task makes the rows of a whole party.
    """
    admins = agents.filter((F.col("role") == "party_admin") & F.col("party").isNotNull()).select(F.col("id").alias("admin"), "party")
    admins = admins.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = agents.select("id", "party", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("block")).repartition("party", "block")
    return admins.join(dealt, ["party", "block"]).select("admin", "id")


def unfinished(submissions: DataFrame) -> DataFrame:
    """Submissions that wait for review, or for their extraction: columns review_status, processing_status."""
    return submissions.filter((F.col("review_status") == PENDING) | F.col("processing_status").isin(*RUNNING))


def layer(zoom: Column) -> Column:
    """The level that a map shows at a zoom of 0 to 18: states to 5, local governments to 8, wards to 10, then units; null beyond."""
    return F.when(zoom.between(0, 18), F.when(zoom <= 5, "state").when(zoom <= 8, "lga").when(zoom <= 10, "ward").otherwise("pu"))


def missing(rows: DataFrame, *required: str) -> list[str]:
    """Required columns that rows lack, in any case, in the order asked for."""
    there = {c.strip().lower() for c in rows.columns}
    return [c for c in required if c.lower() not in there]


def submissions_of(submissions: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """asked with the submissions whose image has the hash in this column, in any case of letters; none for unknown hashes."""
    return asked.withColumn("hash_", F.lower(column)).join(submissions.withColumn("hash_", F.col("image_sha256")), "hash_").drop("hash_")


#: The levels of a map, from the country down.
LEVELS = ("country", "state", "lga", "ward")


def focus(regions: DataFrame) -> DataFrame:
    """level, code, shows, n_shown, up_level, up_code of the country and of every region (level, code, parent_code; states have no parent).

    shows is the level that a map on this place aggregates by, null in a ward, and n_shown the number of places there; up is
    where one climbs to: a country to itself, and from a state to the country, which has no code.
    """
    country = regions.sparkSession.range(1).select(F.lit("country").alias("level"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("parent_code"))
    below = F.create_map(*(F.lit(x) for pair in zip(LEVELS, LEVELS[1:]) for x in pair))
    above = F.create_map(*(F.lit(x) for pair in zip(LEVELS[1:], LEVELS) for x in pair), F.lit("country"), F.lit("country"))
    at = regions.select("level", "code", "parent_code").unionByName(country).withColumns({"shows": F.try_element_at(below, F.col("level")), "up_level": F.try_element_at(above, F.col("level"))})
    held = regions.groupBy(F.col("level").alias("level_"), F.col("parent_code").alias("parent_")).agg(F.count("*").alias("n_"))
    rows = at.join(held, (F.col("shows") == F.col("level_")) & F.col("code").eqNullSafe(F.col("parent_")), "left")
    return rows.select("level", "code", "shows", F.coalesce("n_", F.lit(0)).alias("n_shown"), "up_level", F.col("parent_code").alias("up_code"))
