"""Rosters, boundaries and exports as files: nested JSON, GeoJSON and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.access import missing

_UNIT = "struct<pu_id string, pu_code string, pu_name string, delim string>"
_WARD = f"struct<ward_id string, ward_name string, polling_units array<{_UNIT}>>"
ROSTER = f"state_id string, state_name string, lgas array<struct<lga_id string, lga_name string, wards array<{_WARD}>>>"
_GEO = "type string, features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>"


#: Files beside the states' own.
SUMMARIES = ("summary.json", "all-polling-units.json")


def roster_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a polling unit of state files (one JSON document each); empty levels give no row.

    Of a folder, files that sum up others (SUMMARIES) and those whose names begin with probe are left out.
    """
    name = F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    files = spark.read.schema(ROSTER).json(path, multiLine=True).filter(~name.isin(*SUMMARIES) & ~name.startswith("probe"))
    state = files.select("state_id", "state_name", F.explode("lgas").alias("l"))
    lga = state.select("state_id", "state_name", "l.lga_id", "l.lga_name", F.explode("l.wards").alias("w"))
    return lga.select("state_id", "state_name", "lga_id", "lga_name", "w.ward_id", "w.ward_name", F.explode("w.polling_units").alias("u")).select("*", "u.*").drop("u")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties (a map of texts), geometry type and coordinates (as JSON) of every feature; a document that is no FeatureCollection fails the job."""
    wrong = F.raise_error(F.concat(F.lit("expected a GeoJSON FeatureCollection: "), F.col("_metadata.file_path")))
    held = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(wrong)
    rows = spark.read.schema(_GEO).json(path, multiLine=True).select(F.explode(held).alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def units_of(roster: DataFrame, state: str | None = None) -> DataFrame:
    """A roster's units, of all states or of the one with this id or name."""
    return roster if state is None else roster.filter((F.col("state_id") == state) | (F.col("state_name") == state))


LOG = "seq long, event_type string, entity_type string, entity_id string, actor_id string, event_at string, event_data string, prev_hash string, log_hash string"


def log_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an exported log, nine columns by place; the header's names do not count. An empty actor is none."""
    return spark.read.schema(LOG).csv(path, header=True, enforceSchema=True, quote='"', escape='"', multiLine=True).withColumn("event_data", F.coalesce("event_data", F.lit("")))


def write_states(units: DataFrame, path: str) -> DataFrame:
    """Rosters as JSON, a folder a state under path/states, and their counts at path/summary, which are given back.

    units: state, lga, ward, pu, name. A line is a ward with its units, so no state is one task's; counts: state, lgas,
    wards, polling_units, and a row of null state for all.
    """
    wards = units.groupBy("state", "lga", "ward").agg(F.array_sort(F.collect_list(F.struct("pu", "name"))).alias("polling_units"))
    wards.repartition("state", F.pmod(F.xxhash64("lga", "ward"), F.lit(16))).write.partitionBy("state").json(f"{path}/states")
    sized = units.groupBy("state", "lga", "ward").agg(F.count("*").alias("pus"))
    lgas = sized.groupBy("state", "lga").agg(F.count("*").alias("wards"), F.sum("pus").alias("pus"))
    counts = lgas.rollup("state").agg(F.count("*").alias("lgas"), F.sum("wards").alias("wards"), F.sum("pus").alias("polling_units"))
    counts.write.json(f"{path}/summary")
    return units.sparkSession.read.schema(counts.schema).json(f"{path}/summary")


_NODE = "type string, role string, geometry array<struct<lat double, lon double>>"
_OSM = f"elements array<struct<type string, id long, tags map<string,string>, members array<struct<{_NODE}>>>>"


def osm(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """at, type, id, tags, members of the elements of map extracts: one JSON document a file, or with lines one a line.

    at orders elements as they stand: by file, then by place in the document (which lines do not tell: order these
    by what they hold). A document without elements gives no row.
    """
    rows = spark.read.schema(_OSM).json(path, multiLine=not lines).select(F.col("_metadata.file_path").alias("file"), F.posexplode("elements").alias("place", "e"))
    return rows.select(F.struct("file", "place").alias("at"), "e.type", "e.id", "e.tags", "e.members")


def first_property(properties: Column, *names: str) -> Column:
    """The first of the named properties that is not empty."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(properties, F.lit(n))), F.lit("")) for n in names))


def first_number(properties: Column) -> Column:
    """The first value of digits only, in the order of the properties: the last resort for an id."""
    return F.get(F.filter(F.map_values(properties), lambda v: v.rlike(r"^[0-9]+$")), F.lit(0))


def first_name(properties: Column) -> Column:
    """The first value of two letters or more that is no number, in the order of the properties: the last resort for a name."""
    return F.get(F.filter(F.map_values(properties), lambda v: (F.char_length(v) > 1) & ~v.rlike(r"^[0-9]+$")), F.lit(0))


def numbered(text: Column, kind: str = "string") -> Column:
    """A JSON object with numbers as keys as an array in their order; keys that are no numbers come last."""
    entries = F.map_entries(F.from_json(text, f"map<string,{kind}>"))
    keyed = F.transform(entries, lambda e: F.struct(F.coalesce(e["key"].try_cast("long"), F.lit((1 << 63) - 1)).alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda e: e["value"])


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header in any case and order: columns in lower case, values trimmed texts, quotes doubled."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.select(*(F.trim(F.col(f"`{x}`")).alias(x.strip().lower()) for x in raw.columns))


ROSTER_COLUMNS = ("name", "phone", "pu_code")


def roster_csv(spark: SparkSession, path: str, required: Sequence[str] = ROSTER_COLUMNS) -> DataFrame:
    """csv_table of a roster; a header that lacks required columns is an error that names them all, as is a file without one."""
    rows = csv_table(spark, path)
    lacking = sorted(missing(rows, *required))
    if lacking:
        raise ValueError(f"missing required column(s): {lacking}" if rows.columns else "CSV is empty")
    return rows


def overrides_csv(spark: SparkSession, path: str, source: str = "source_ward_id", target: str = "inec_ward_code") -> DataFrame:
    """source_id, ward_code of a CSV of overrides: both trimmed, rows that lack one left out, and of rows of one source the last counts.

    Last is by file name, then by place in the file.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(a) for c, a in ((source, "source_id"), (target, "ward_code"))), place.alias("at"))
    return rows.dropna(subset=["source_id", "ward_code"]).groupBy("source_id").agg(F.max_by("ward_code", "at").alias("ward_code"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; commas, quotes and line breaks are quoted, null is empty."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def hash_manifest(submissions: DataFrame) -> DataFrame:
    """id, pu, party (empty for none), sha256, submitted_at of every submission, approved or not."""
    return submissions.select("id", "pu", F.coalesce("party", F.lit("")).alias("party"), "sha256", "submitted_at")
