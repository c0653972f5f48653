"""Distances and geofences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of 6,371,000 m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(a))


def geofence(metres: Column, soft: float = 100, hard: float = 2000) -> Column:
    return F.when(metres <= soft, "ok").when(metres <= hard, "warning").otherwise("violation")


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """The column and row of the web map tile that holds a point."""
    n = float(2**zoom)
    phi = F.radians(lat)
    x = F.floor((lng + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.pi()) / 2 * n)
    return x, y


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Metres of a point in the spherical web projection."""
    return F.radians(lng) * 6378137.0, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * 6378137.0


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Whether a closed ring (array of structs lng, lat) holds a point, by the parity of the edges a ray crosses."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(e: Column) -> Column:
        (xa, ya), (xb, yb) = ((e[k]["lng"], e[k]["lat"]) for k in "ab")
        return ((ya > lat) != (yb > lat)) & (lng < (xb - xa) * (lat - ya) / F.when(yb == ya, 1e-12).otherwise(yb - ya) + xa)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def in_polygon(lat: Column, lng: Column, rings: Column) -> Column:
    """Whether a polygon (array of closed rings: the outer one, then holes) holds a point."""
    return in_ring(lat, lng, rings[0]) & ~F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: in_ring(lat, lng, hole))
