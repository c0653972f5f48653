"""Boundary wards matched to a register of wards by name.

Overrides come first, then the local government by name, alias or likeness, then the ward within it by any of
its names, then the most alike. All steps are joins on a state key; likeness is computed for pairs of distinct
names within one state or one local government only.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from ..sources.current import Current
from .spatial import multipolygon

#: Words that say nothing, state codes of other registers, and local governments that changed names.
NOISE = ("ward", "district", "area", "council")
STATE_CODES = {"BR": "BO", "KB": "KE"}
LGA_NAMES = {
    "AB/obi nwga": "obingwa",
    "SO/sabon birni": "s birni",
    "OG/yewa north": "egbado north",
    "OG/yewa south": "egbado south",
    "KO/kogi": "kogi k k",
    "KN/dambatta": "danbata",
}
LGA_ALIKE, WARD_ALIKE, WARD_REVIEW, LOADED = 0.82, 0.90, 0.75, 0.80
_FEATURE = ["source_id", "state_code", "state", "lga", "ward", "alt"]


def plain(name: str | None) -> str:
    """Letters and digits without marks, lower-cased, as words joined by one space; words of NOISE go."""
    bare = (x for x in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(x))
    return " ".join(w for w in "".join(x if x.isalnum() else " " for x in "".join(bare).lower()).split() if w not in NOISE)


@pandas_udf(StringType())
def normal(names: pd.Series) -> pd.Series:
    return names.map(plain)


@pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio; it depends on which name comes first."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _within(short: Column, long: Column) -> Column:
    """If a name of five letters or more starts or ends the other, or stands in it as words."""
    return (F.length(short) >= 5) & (F.startswith(long, short) | F.endswith(long, short) | F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" "))))


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _lga_of(asked: DataFrame, lgas: DataFrame) -> DataFrame:
    """key, lga_n, to_lga, lga_conf for the asked (key, lga_n) that have one; ties of likeness go to the first register code."""
    alias = F.try_element_at(_table(LGA_NAMES), F.concat_ws("/", "key", "lga_n"))
    known = lgas.select("key", F.col("lga_n").alias("to_lga"), "first_code")
    asked = asked.withColumn("named", F.array_compact(F.array("lga_n", alias)))
    sure = asked.select("key", "lga_n", F.posexplode("named").alias("rank", "to_lga")).join(known, ["key", "to_lga"]).groupBy("key", "lga_n").agg(F.min_by("to_lga", "rank").alias("to_lga"), F.lit(1.0).alias("lga_conf"))
    pairs = asked.filter("lga_n <> ''").join(sure, ["key", "lga_n"], "left_anti").join(known, "key")
    a, b = F.col("lga_n"), F.col("to_lga")
    first_short = F.length(a) <= F.length(b)
    short, long = F.when(first_short, a).otherwise(b), F.when(first_short, b).otherwise(a)
    ratio = F.when(_within(short, long), F.greatest(F.length(short) / F.length(long), F.lit(0.85))).otherwise(alike(a, b))
    best = pairs.withColumn("lga_conf", ratio).groupBy("key", "lga_n").agg(F.min(F.struct((-F.col("lga_conf")).alias("less"), "first_code", "to_lga")).alias("best"))
    near = best.select("key", "lga_n", F.col("best.to_lga").alias("to_lga"), (-F.col("best.less")).alias("lga_conf")).filter(F.col("lga_conf") >= LGA_ALIKE)
    return sure.unionByName(near)


def reconcile(features: DataFrame, register: DataFrame, overrides: DataFrame) -> DataFrame:
    """source_id, state, lga, ward, ward_code, confidence, reason of each distinct feature.

    features: source_id, state_code, state, lga, ward, alt (further names, by commas); null is empty, a null or
    empty source_id is state|lga|ward. register: state_code, state, lga, ward_code, ward. overrides: source_id,
    ward_code, one row an id. Ties of likeness go to the smallest ward_code.
    """
    c = F.col
    empty = [F.coalesce(c(x), F.lit("")).alias(x) for x in _FEATURE]
    rows = features.select(*empty).withColumn("source_id", F.when(c("source_id") == "", F.concat_ws("|", "state", "lga", "ward")).otherwise(c("source_id"))).distinct()
    wards = register.select("ward_code", normal("lga").alias("lga_n"), normal("ward").alias("ward_n"), F.array_distinct(F.array(F.coalesce(F.upper("state_code"), F.lit("")), normal("state"))).alias("keys"))
    wards = wards.select("ward_code", "lga_n", "ward_n", F.explode("keys").alias("key")).filter("key <> ''").distinct()

    forced = overrides.join(register.select("ward_code").distinct(), "ward_code", "left_semi").select("source_id", "ward_code")
    done = rows.join(forced, "source_id").select(*_FEATURE, "ward_code", F.lit(1.0).alias("confidence"), F.lit("override").alias("reason"))

    code = F.upper(F.trim("state_code"))
    code = F.coalesce(F.try_element_at(_table(STATE_CODES), code), code)
    names = F.concat(F.array("ward"), F.split("alt", ","))
    left = rows.join(forced, "source_id", "left_anti").withColumn("key", F.when(code != "", code).otherwise(normal("state"))).withColumn("lga_n", normal("lga"))
    lgas = wards.groupBy("key", "lga_n").agg(F.min("ward_code").alias("first_code"))
    placed = left.join(_lga_of(left.select("key", "lga_n").distinct(), lgas), ["key", "lga_n"], "left")
    nowhere = placed.filter("to_lga is null").select(*_FEATURE, F.lit(None).cast("string").alias("ward_code"), F.lit(0.0).alias("confidence"), F.lit("no_lga").alias("reason"))

    named = placed.filter("to_lga is not null").withColumn("name", F.explode(names)).withColumn("name", normal("name")).drop("lga_n")
    pairs = named.join(wards.select("key", c("lga_n").alias("to_lga"), "ward_n", "ward_code"), ["key", "to_lga"])
    same = pairs.filter("name <> '' and name = ward_n").groupBy(*_FEATURE, "lga_conf").agg(F.countDistinct("ward_code").alias("n"), F.min("ward_code").alias("code"))
    one = c("n") == 1
    exact = same.select(*_FEATURE, F.when(one, c("code")).alias("ward_code"), F.when(one, F.round("lga_conf", 3)).otherwise(0.0).alias("confidence"), F.when(~one, "ambiguous").when(c("lga_conf") == 1, "exact").otherwise("lga_fuzzy_exact_ward").alias("reason"))

    ratio = F.when(c("name") != "", alike("name", "ward_n"))
    rest = pairs.join(same.select(*_FEATURE), _FEATURE, "left_anti").withColumn("ratio", ratio)
    best = rest.groupBy(*_FEATURE, "lga_conf").agg(F.min(F.when(c("ratio").isNotNull(), F.struct((-c("ratio")).alias("less"), "ward_code"))).alias("best"))
    r = -c("best.less")
    near = best.select(*_FEATURE, F.when(r >= WARD_REVIEW, c("best.ward_code")).alias("ward_code"), F.coalesce(F.round(r * c("lga_conf"), 3), F.lit(0.0)).alias("confidence"), F.when(r >= WARD_ALIKE, "fuzzy").when(r >= WARD_REVIEW, "needs_review").otherwise("no_ward").alias("reason"))
    return done.unionByName(nowhere).unionByName(exact).unionByName(near).drop("state_code", "alt")


def reasons(matches: DataFrame) -> DataFrame:
    """reason, n: how often each reason decided a match."""
    return matches.groupBy("reason").agg(F.count("*").alias("n"))


ACTIONS = ("loaded", "skipped_no_match", "skipped_low_confidence", "skipped_bad_geom")


def load_action(ward_code: Column, confidence: Column, polygon: Column, least: float = LOADED) -> Column:
    """What becomes of a matched boundary; polygon: if its geometry is a polygon or several."""
    return F.when(ward_code.isNull(), "skipped_no_match").when(confidence < least, "skipped_low_confidence").when(~F.coalesce(polygon, F.lit(False)), "skipped_bad_geom").otherwise("loaded")


def load(matches: DataFrame, table: Current, report: str, least: float = LOADED) -> dict[str, int]:
    """Put matched boundaries into table (ward_code, source_id, confidence, polygons), and all rows' actions at report; gives a count of each action.

    matches: at (their order), source_id, ward_code, confidence, reason, and the geometry as kind, polygon and
    polygons. One pass over matches writes a folder an action and counts; a single polygon becomes one of several. Of a
    ward's boundaries the last one stays.
    """
    spark = matches.sparkSession
    polygons = multipolygon(F.col("kind"), F.col("polygon"), F.col("polygons"))
    action = load_action(F.col("ward_code"), F.col("confidence"), polygons.isNotNull(), least)
    rows = matches.withColumn("action", action).select("at", "source_id", "ward_code", "confidence", "reason", F.when(F.col("action") == "loaded", polygons).alias("polygons"), "action")
    seen = Observation("load")
    counted = rows.observe(seen, *(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS))
    counted.write.partitionBy("action").parquet(report)
    loaded = spark.read.schema(rows.schema).parquet(report).filter("action = 'loaded'")
    if seen.get["loaded"]:
        table.upsert(loaded.select("ward_code", "source_id", "confidence", "polygons", "at"), F.col("at"))
    return dict(seen.get)
