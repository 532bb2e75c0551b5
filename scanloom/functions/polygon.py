"""Polygons as arrays of (x, y[, z]) structs, without closing point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """(a, b) of every side, the last back to the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def mean_of(ring: Column, axis: str) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def ensure_ccw(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def expand(ring: Column, margin: Column) -> Column:
    """Every corner ``margin`` further from the mean of the corners; fewer than three corners or no margin: unchanged."""
    cx, cy = mean_of(ring, "x"), mean_of(ring, "y")

    def out(p: Column) -> Column:
        dx, dy = p["x"] - cx, p["y"] - cy
        r = F.sqrt(dx * dx + dy * dy)
        k = F.when(r < 1e-6, F.lit(1.0)).otherwise((r + margin) / r)
        return F.struct((cx + dx * k).alias("x"), (cy + dy * k).alias("y"))

    return F.when((F.size(ring) < 3) | (margin <= 0), F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(F.transform(ring, out))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test: how many sides a ray to the right crosses; level sides never count."""
    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(_edges(ring), crossed)) % 2 == 1


def zone_contains(x: Column, y: Column, z: Column, center: tuple[Column, Column, Column], size: tuple[Column, Column, Column], ring: Column | None = None) -> Column:
    """Inclusive height slab, then the polygon if there is one, else the inclusive box."""
    slab = F.abs(z - center[2]) <= size[2] / 2
    box = (F.abs(x - center[0]) <= size[0] / 2) & (F.abs(y - center[1]) <= size[1] / 2)
    return slab & (box if ring is None else F.when(F.coalesce(F.size(ring), F.lit(0)) >= 3, contains(ring, x, y)).otherwise(box))


def facade_size(vertices: Column, nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """(width, height) of a planar face: width along the level tangent, height up the face."""
    def extent(value) -> Column:
        v = F.transform(vertices, value)
        return F.array_max(v) - F.array_min(v)

    flat = F.sqrt(nx * nx + ny * ny)
    dx, dy, dz = extent(lambda p: p["x"]), extent(lambda p: p["y"]), extent(lambda p: p["z"])
    width = F.when(flat < 1e-9, F.greatest(dx, dy)).otherwise(extent(lambda p: (p["y"] * nx - p["x"] * ny) / flat))
    height = F.when(F.abs(nz) > 0.99, F.least(dx, dy)).when(F.abs(nz) < 0.01, dz).otherwise(dz / F.sqrt(1 - nz * nz))
    return width, height
