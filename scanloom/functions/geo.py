"""Local east-north-up metres and WGS84 degrees, by a truncated series good to a kilometre or so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meters_per_deg(lat: Column) -> tuple[Column, Column]:
    """Metres of one degree of latitude and of longitude."""
    p = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p), 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p)


def enu_to_wgs84(x: Column, y: Column, z: Column, lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    m_lat, m_lon = meters_per_deg(lat)
    return lat + y / m_lat, lon + x / m_lon, alt + z


def wgs84_to_enu(lat: Column, lon: Column, alt: Column, ref_lat: Column, ref_lon: Column, ref_alt: Column) -> tuple[Column, Column, Column]:
    m_lat, m_lon = meters_per_deg(ref_lat)
    return (lon - ref_lon) * m_lon, (lat - ref_lat) * m_lat, alt - ref_alt


def wgs84_to_enu_spherical(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """The same on a sphere of radius 6378137 m."""
    r = 6378137.0
    return F.radians(lon - ref_lon) * r * F.cos(F.radians(ref_lat)), F.radians(lat - ref_lat) * r


def polygon_to_enu(ring: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """Ring of (lon, lat) structs as (x, y) structs."""
    m_lat, m_lon = meters_per_deg(ref_lat)
    return F.transform(ring, lambda p: F.struct(((p["lon"] - ref_lon) * m_lon).alias("x"), ((p["lat"] - ref_lat) * m_lat).alias("y")))


def voxel_key(x: Column, y: Column, z: Column, size: float) -> tuple[Column, Column, Column]:
    """Cell indexes by floor."""
    return tuple(F.floor(c / F.lit(size)).cast("long") for c in (x, y, z))


def packed_voxel(ix: Column, iy: Column, iz: Column) -> Column:
    """Three 21-bit cell indexes in one long (cells within a million of the origin)."""
    part = lambda c: (c.cast("long") + F.lit(1 << 20)).bitwiseAND(F.lit((1 << 21) - 1).cast("long"))
    return F.shiftleft(part(ix), 42).bitwiseOR(F.shiftleft(part(iy), 21)).bitwiseOR(part(iz))


def overlap_fraction(raw: Column) -> Column:
    """A share given as text: blank is null, percent becomes a fraction, within 0..0.99."""
    v = F.nullif(F.trim(raw), F.lit("")).try_cast("double")
    v = F.when(v > 1, v / 100).otherwise(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.99), v)))


def html_escape(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")


def pose_fraction(f: Column, transit: Column) -> Column:
    """Progress along a segment: eased on transit, linear on inspection."""
    return F.when(transit, f * f * (3 - 2 * f)).otherwise(f)
