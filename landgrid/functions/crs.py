"""Spherical Mercator (EPSG:3857) and longitude/latitude (EPSG:4326) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
SRIDS = {3857, 4326}


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.pi() / 2)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * RADIUS


def transform_points(points: Column, source: int | None, target: int) -> Column:
    """An array of points; a missing CRS is an error, equal ones leave the points alone."""
    if source is None:
        raise ValueError("the layer has no CRS")
    if not {source, target} <= SRIDS:
        raise ValueError(f"no transformation from {source} to {target}")
    if source == target:
        return points
    f = to_lonlat if target == 4326 else to_mercator
    return F.transform(points, lambda p: (lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y")))(f(p["x"], p["y"])))


def check_metres(srid: int | None) -> None:
    """Areas and lengths need a projected CRS."""
    if srid is None:
        raise ValueError("the layer has no CRS")
    if srid == 4326:
        import warnings

        warnings.warn("area filters on a geographic CRS compare degrees", stacklevel=2)
