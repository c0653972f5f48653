"""Map tiles as bytes: features of a tile to the vector tile format, version 2, and back."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tiles import EXTENT, point_features, ring_features

#: Fixed values of the format: kinds of geometry; wire types; commands move one, line to, close.
KINDS = {"point": 1, "polygon": 3}
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
MOVE_ONE, LINE, CLOSE = 9, 2, 15


def _zigzag(v: Column) -> Column:
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v).cast("long")


def _plain(v: Column) -> Column:
    """The number that _zigzag was given."""
    return F.when(v % 2 == 1, -F.shiftright(v + 1, 1)).otherwise(F.shiftright(v, 1))


def point_commands(x: Column, y: Column) -> Column:
    """The commands of a point of the tile's grid."""
    return F.array(F.lit(MOVE_ONE).cast("long"), _zigzag(x), _zigzag(y))


def point_of(commands: Column) -> tuple[Column, Column]:
    """x, y of a point's commands."""
    return _plain(F.get(commands, F.lit(1))), _plain(F.get(commands, F.lit(2)))


def with_ring_commands(features: DataFrame, rings: str = "rings", into: str = "geometry") -> DataFrame:
    """features with the commands of their closed rings (arrays of structs x, y; the outer one first), in place of rings.

    Outer rings run clockwise on the map and holes the other way, however they came. A ring without area goes, and with the
    outer ring the feature.
    """

    def wound(ring: Column, i: Column) -> Column:
        held = F.slice(ring, F.lit(1), F.size(ring) - 1)
        cross = F.zip_with(held, F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        twice = F.aggregate(cross, F.lit(0).cast("long"), lambda a, v: a + v)
        return F.when(twice == 0, F.lit(None)).when((twice > 0) == (i == 0), held).otherwise(F.reverse(held))

    rows = features.withColumn("wound_", F.transform(rings, wound)).filter(F.get("wound_", F.lit(0)).isNotNull())
    rows = rows.withColumn("wound_", F.filter("wound_", lambda r: r.isNotNull()))

    def drawn(ring: Column, i: Column) -> Column:
        before = F.element_at(F.get(F.col("wound_"), i - 1), -1)
        start = [_zigzag(ring[0][a] - F.coalesce(before[a], F.lit(0))) for a in "xy"]
        n = F.size(ring) - 1
        steps = F.zip_with(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), n), lambda q, p: F.array(_zigzag(q["x"] - p["x"]), _zigzag(q["y"] - p["y"])))
        return F.concat(F.array(F.lit(MOVE_ONE).cast("long"), *start, (n * 8 + LINE).cast("long")), F.flatten(steps), F.array(F.lit(CLOSE).cast("long")))

    return rows.withColumn(into, F.flatten(F.transform("wound_", drawn))).drop("wound_", rings)


#: The layers' names, and what a region's feature tells besides its names.
LAYERS = {"state": "states", "lga": "lgas", "ward": "wards", "pu": "polling_units"}
COUNTS = ("pu_count", "units_reporting", "units_consensus", "units_discrepancy", "units_inec_conflict")


def region_layer(regions: DataFrame, shapes: DataFrame, level: str, zoom: int) -> DataFrame:
    """The features of a level's regions (rollups.region_rows) by tile of a zoom: tile_x, tile_y, layer, kind, geometry, attributes.

    shapes (spatial.placed): code, polygons, point. A region is drawn by its polygons, each a feature of its own with the same
    attributes, else by its point; without either it is in no tile. States also tell their party totals.
    """
    told = ["code", "name", "parent_code", "state_code", *COUNTS, *(["party_totals_json"] if level == "state" else [])]
    rows = regions.select("code", F.struct(*told).alias("attributes")).join(shapes.select("code", "polygons", "point"), "code")
    drawn = ring_features(rows.select("attributes", F.explode("polygons").alias("rings")), zoom)
    held = ["tile_x", "tile_y", F.lit(LAYERS[level]).alias("layer")]
    areas = with_ring_commands(drawn).select(F.col("tile_x").cast("long"), F.col("tile_y").cast("long"), held[2], F.lit("polygon").alias("kind"), "geometry", "attributes")
    points = point_features(rows.filter("polygons is null and point is not null").select("attributes", "point.lng", "point.lat"), zoom)
    return areas.unionByName(points.select(*held, F.lit("point").alias("kind"), point_commands(F.col("x"), F.col("y")).alias("geometry"), "attributes"))


def unit_layer(units: DataFrame, zoom: int) -> DataFrame:
    """The features of units (tiles.unit_attributes, with lng and lat) by tile of a zoom, as region_layer gives them."""
    told = [c for c in units.columns if c not in ("lng", "lat")]
    rows = point_features(units.select(F.struct(*told).alias("attributes"), "lng", "lat"), zoom)
    return rows.select("tile_x", "tile_y", F.lit(LAYERS["pu"]).alias("layer"), F.lit("point").alias("kind"), point_commands(F.col("x"), F.col("y")).alias("geometry"), "attributes")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3 | VARINT) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | BYTES) + _varint(len(data)) + data


def _packed(field: int, numbers) -> bytes:
    return _block(field, b"".join(map(_varint, numbers)))


def _value(v) -> bytes:
    """A message of one attribute: bool, whole number, text or double."""
    if isinstance(v, bool):
        return _number(7, int(v))
    if isinstance(v, int):
        return _number(5, v) if v >= 0 else _number(6, -2 * v - 1)
    if isinstance(v, float):
        return _varint(3 << 3 | FIXED64) + struct.pack("<d", v)
    return _block(1, (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)).encode())


def _layer(name: str, rows: pd.DataFrame, extent: int) -> bytes:
    keys, values, features = {}, {}, []
    for kind, commands, text in zip(rows["kind"], rows["geometry"], rows["attributes"]):
        tags = []
        for k, v in ((k, v) for k, v in json.loads(text or "{}").items() if v is not None):
            tags += (keys.setdefault(k, len(keys)), values.setdefault(_value(v), len(values)))
        features.append(_block(2, (_packed(2, tags) if tags else b"") + _number(3, KINDS[kind]) + _packed(4, map(int, commands))))
    named = b"".join(_block(3, k.encode()) for k in keys) + b"".join(_block(4, v) for v in values)
    return _block(3, _number(15, 2) + _block(1, name.encode()) + b"".join(features) + named + _number(5, extent))


def _tile(rows: pd.DataFrame, by: Sequence[str], extent: int) -> pd.DataFrame:
    rows = rows.assign(order=[tuple(g) for g in rows["geometry"]]).sort_values(["layer", "attributes", "order"])
    data = b"".join(_layer(name, part, extent) for name, part in rows.groupby("layer", sort=True))
    return pd.DataFrame([[*rows[list(by)].iloc[0], data]], columns=[*by, "tile"])


def tile_bytes(features: DataFrame, by: Sequence[str] = ("tile_x", "tile_y"), extent: int = EXTENT) -> DataFrame:
    """by, tile: the bytes of every tile that has features: rows of by, layer, kind (point, polygon), geometry (commands), attributes (a struct, or JSON).

    Attributes that are null are left out, as are features without layer or geometry; a tile without features has no row.
    Features stand in the order of their attributes, so equal features give equal bytes. A tile is one value, so its
    features meet in one task: choose what a layer shows at a zoom so that a tile stays small (access.layer).
    """
    told = F.col("attributes") if isinstance(features.schema["attributes"].dataType, T.StringType) else F.to_json("attributes")
    rows = features.filter("layer is not null and geometry is not null").select(*by, "layer", "kind", "geometry", told.alias("attributes"))
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("tile", T.BinaryType())])
    by = tuple(by)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        return _tile(part, by, extent)

    return rows.groupBy(*by).applyInPandas(of, schema)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """field, value of a message: whole numbers, or bytes of other kinds."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        if key & 7 == VARINT:
            n, at = _read_varint(data, at)
            yield key >> 3, n
            continue
        size = {FIXED64: 8, FIXED32: 4}.get(key & 7)
        if size is None:
            size, at = _read_varint(data, at)
        yield key >> 3, data[at : at + size]
        at += size


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _read_varint(data, at)
        out.append(n)
    return out


def _read_value(data: bytes):
    field, v = next(_fields(data))
    if field == 1:
        return v.decode()
    if field in (2, 3):
        return struct.unpack("<f" if field == 2 else "<d", v)[0]
    return bool(v) if field == 7 else -(v + 1 >> 1) if field == 6 and v & 1 else v >> 1 if field == 6 else v


def _read_layer(data: bytes) -> Iterator[tuple]:
    parts = list(_fields(data))
    name = next(v.decode() for f, v in parts if f == 1)
    keys, values = [v.decode() for f, v in parts if f == 3], [_read_value(v) for f, v in parts if f == 4]
    kinds = {n: k for k, n in KINDS.items()}
    for feature in (dict(_fields(v)) for f, v in parts if f == 2):
        tags = _numbers(feature.get(2, b""))
        attributes = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
        yield name, kinds.get(feature.get(3)), _numbers(feature.get(4, b"")), json.dumps(attributes, ensure_ascii=False)


def read_tiles(tiles: DataFrame, by: Sequence[str] = ("tile_x", "tile_y")) -> DataFrame:
    """by, layer, kind, geometry, attributes (JSON) of every feature of tiles (by, tile); an empty or null tile has none. Lines have no kind."""

    def read(batches):
        for batch in batches:
            rows = [(*key, *feature) for *key, tile in batch[[*by, "tile"]].itertuples(index=False) if tile for f, v in _fields(bytes(tile)) if f == 3 for feature in _read_layer(v)]
            yield pd.DataFrame(rows, columns=[*by, "layer", "kind", "geometry", "attributes"])

    fields = [*(tiles.schema[c] for c in by), *(T.StructField(c, T.StringType()) for c in ("layer", "kind")), T.StructField("geometry", T.ArrayType(T.LongType())), T.StructField("attributes", T.StringType())]
    return tiles.select(*by, "tile").mapInPandas(read, T.StructType(fields))
