"""Distances and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsquall.config import CONFIG

R = CONFIG.geometry.earth_radius_m


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * R * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def metres_to_degrees(east: Column, north: Column, lat: Column) -> tuple[Column, Column]:
    """Offsets in metres as (degrees of longitude, degrees of latitude)."""
    m = CONFIG.geometry.metres_per_degree
    return east / (m * F.cos(F.radians(lat))), north / F.lit(m)


def planar(lat: Column, lon: Column, lat0: Column, lon0: Column, compat_radians: bool = False) -> tuple[Column, Column]:
    """East and north metres from a centre; ``compat_radians`` takes radians for degrees."""
    f = F.radians if compat_radians else (lambda c: c)
    return f(lon - lon0) * 111_320.0 * F.cos(F.radians(lat0)), f(lat - lat0) * 110_540.0


def alignment(wind_from: Column, towards: Column) -> Column:
    """Cosine between where the wind goes and a bearing."""
    return F.cos(F.radians(F.pmod(wind_from + 180.0, F.lit(360.0)) - towards))


def from_components(u: Column, v: Column) -> tuple[Column, Column]:
    """Wind speed, and the direction the wind comes from."""
    return F.sqrt(u * u + v * v), F.pmod(180.0 + F.degrees(F.atan2(u, v)), F.lit(360.0))
