"""Distances, rings and grids as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILES = 3958.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MILES) -> Column:
    """Great-circle miles; infinity where a coordinate is missing (GE1)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # `least` skips nulls, so a missing coordinate must be asked for
    return F.when(a.isNull(), F.lit(float("inf"))).otherwise(2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def parse_coordinates(text: Column) -> Column:
    """``lat, lon`` text to a struct, NULL if it isn't that or is out of range (GE15)."""
    number = r"[-+]?[0-9]+(?:\.[0-9]+)?"
    pattern = rf"^\s*({number})\s*,\s*({number})\s*$"
    lat = F.regexp_extract(text, pattern, 1).try_cast("double")
    lon = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def postal_code(text: Column) -> Column:
    """The five digits of a postal code with or without its four more (GE16), else blank."""
    return F.regexp_extract(text, r"^\s*([0-9]{5})(?:-[0-9]{4})?\s*$", 1)


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the ray from (x, y) to the right crosses the edge, half-open in y (GE2)."""
    spans = (y1 > y) != (y2 > y)
    at = (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1
    return F.when(spans & (x < at), 1).otherwise(0)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from a point to an edge, with longitudes scaled by the cosine of the latitude (GE3)."""
    k = F.cos(F.radians(y))
    dx, dy, px, py = (x2 - x1) * k, y2 - y1, (x - x1) * k, y - y1
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length)))
    return F.hypot(px - t * dx, py - t * dy)


def grid_cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("int")


def label_size(zoom: Column, base: float = 13.0, full: int = 6) -> Column:
    """Font size of a label (GE9): halves with each zoom level below ``full``, where it is hidden."""
    return F.lit(base) * F.pow(F.lit(2.0), F.least(F.lit(0.0), zoom - full))
