"""Angles in degrees: compass headings run clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tilt limits of the gimbal.
PITCH_MIN, PITCH_MAX = -90.0, 35.0


def wrap360(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def to_pm180(a: Column) -> Column:
    """[-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def heading_fold(a: Column) -> Column:
    """(-180, 180]."""
    w = wrap360(a)
    return F.when(w > 180, w - 360).otherwise(w)


def angle_delta(a: Column, b: Column) -> Column:
    """Smallest turn between two headings, 0..180."""
    d = wrap360(F.abs(a - b))
    return F.when(d > 180, 360 - d).otherwise(d)


def azimuth(x: Column, y: Column) -> Column:
    """Heading of a direction."""
    return wrap360(F.degrees(F.atan2(x, y)))


def tilt_from_vertical(nz: Column) -> Column:
    return F.degrees(F.asin(F.least(F.abs(nz), F.lit(1.0))))


def facade_direction(nx: Column, ny: Column, nz: Column) -> Column:
    """roof, or the side of the compass that a wall looks to; headings count to nine decimals, so that borders are exact."""
    a = F.round(azimuth(nx, ny), 9)
    return F.when(F.abs(nz) > 0.3, "roof").when((a >= 315) | (a < 45), "north").when(a < 135, "east").when(a < 225, "south").otherwise("west")


def absolute_gimbal_yaw(base: Column, heading: Column, raw: Column) -> Column:
    """A raw yaw counted from north, or from the aircraft's nose, in [-180, 180)."""
    return to_pm180(F.when(base == "north", raw).otherwise(heading + raw))


def camera_forward(heading: Column, gimbal_yaw: Column, pitch: Column) -> Column:
    """Viewing direction; a set gimbal yaw overrides the heading."""
    h, p = F.radians(F.coalesce(gimbal_yaw, heading)), F.radians(pitch)
    return F.struct((F.sin(h) * F.cos(p)).alias("x"), (F.cos(h) * F.cos(p)).alias("y"), F.sin(p).alias("z"))


def look_at(dx: Column, dy: Column, dz: Column, margin: float = 0.0) -> tuple[Column, Column]:
    """(heading, pitch) towards an offset; straight down where it has no horizontal part; pitch within the limits less margin."""
    flat = F.sqrt(dx * dx + dy * dy)
    pitch = F.when(flat > 1e-6, F.degrees(F.atan2(dz, flat))).otherwise(F.lit(-90.0))
    return azimuth(dx, dy), F.greatest(F.lit(PITCH_MIN + margin), F.least(F.lit(PITCH_MAX - margin), pitch))


def clamp_pitch(p: Column) -> Column:
    return F.greatest(F.lit(PITCH_MIN), F.least(F.lit(PITCH_MAX), p))


def rotate_z(x: Column, y: Column, deg: Column) -> tuple[Column, Column]:
    """Counter-clockwise turn about the vertical."""
    c, s = F.cos(F.radians(deg)), F.sin(F.radians(deg))
    return x * c - y * s, x * s + y * c
