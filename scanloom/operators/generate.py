"""Row generators: faces of buildings and the photo waypoints before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import angles, camera, polygon
from scanloom.operators.joins import shuffled

#: Mission defaults.
GSD_MM, FRONT, SIDE, CLEARANCE_M, MARGIN_DEG, SPEED_MS = 2.0, 0.60, 0.50, 2.0, 5.0, 3.0
MIN_ALTITUDE_M, INSET_M = 2.0, 0.1

#: Walls of a box by outward local normal: label, normal x and y, first and second corner (as signs of half width and half depth).
WALLS = (("back_wall", 0, -1, (-1, -1), (1, -1)), ("right_wall", 1, 0, (1, -1), (1, 1)), ("front_wall", 0, 1, (1, 1), (-1, 1)), ("left_wall", -1, 0, (-1, 1), (-1, -1)))


def _face(index: int, label: str, tag: str, normal: tuple[Column, Column, Column], corners: list[tuple[Column, Column, Column]]) -> Column:
    d = lambda c: c.cast("double")
    points = F.array(*[F.struct(d(x).alias("x"), d(y).alias("y"), d(z).alias("z")) for x, y, z in corners])
    nx, ny, nz = normal
    return F.struct(F.lit(index).alias("facade_index"), F.lit(label).alias("label"), F.lit(tag).alias("component_tag"), d(nx).alias("nx"), d(ny).alias("ny"), d(nz).alias("nz"), points.alias("vertices"))


def with_measures(facades: DataFrame) -> DataFrame:
    """Add the mean corner ``cx, cy, cz`` and ``width_m, height_m, area_m2``."""
    w, h = polygon.facade_size(F.col("vertices"), F.col("nx"), F.col("ny"), F.col("nz"))
    out = facades.withColumns({f"c{a}": polygon.mean_of(F.col("vertices"), a) for a in "xyz"}).withColumns({"width_m": w, "height_m": h})
    return out.withColumn("area_m2", F.col("width_m") * F.col("height_m"))


def rectangular_facades(buildings: DataFrame) -> DataFrame:
    """Four walls and a flat roof, or two slopes, of every building: a narrow explode.

    Returns ``building_id, facade_index, label, component_tag, nx, ny, nz, vertices``
    with centre and measures. A building without width, depth or height has no
    wall where it would have no area.
    """
    hw, hd, h = F.col("width") / 2, F.col("depth") / 2, F.col("height")
    deg = F.col("heading_deg")
    turn = lambda x, y, z: (*angles.rotate_z(x, y, deg), z)
    zero = F.lit(0.0)
    faces = []
    for i, (label, nx, ny, (ax, ay), (bx, by)) in enumerate(WALLS):
        corners = [turn(hw * ax, hd * ay, zero), turn(hw * bx, hd * by, zero), turn(hw * bx, hd * by, h), turn(hw * ax, hd * ay, h)]
        faces.append(_face(i, label, "21.1", turn(F.lit(float(nx)), F.lit(float(ny)), zero), corners))
    roof = [turn(hw * x, hd * y, h) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    flat = _face(4, "roof_flat", "47.1", (zero, zero, F.lit(1.0)), roof)
    pitch = F.radians(F.col("roof_pitch_deg"))
    ridge = h + hd * F.tan(pitch)
    left, right = turn(-hw, zero, ridge), turn(hw, zero, ridge)
    back = _face(4, "roof_back", "47.1", turn(zero, -F.sin(pitch), F.cos(pitch)), [roof[0], roof[1], right, left])
    front = _face(5, "roof_front", "47.1", turn(zero, F.sin(pitch), F.cos(pitch)), [roof[2], roof[3], left, right])
    pitched = F.col("roof_type") == "pitched"
    found = buildings.select("building_id", F.inline(F.when(pitched, F.array(*faces, back, front)).otherwise(F.array(*faces, flat))))
    return shuffled(with_measures(found).where("width_m > 1e-9 and height_m > 1e-9"))


def l_shaped_facades(buildings: DataFrame, translate_wings: bool = True) -> DataFrame:
    """Two wings: the building, and one of half its size turned by 90 degrees at its right end.

    Walls whose centre lies inside the other wing's footprint are dropped and the
    rest numbered anew. translate_wings=False keeps the second wing at the
    origin.
    """
    one = rectangular_facades(buildings).withColumn("wing", F.lit(1))
    two_in = buildings.withColumns({"heading_deg": F.pmod(F.col("heading_deg") + 90, F.lit(360.0)), "width": F.col("width") / 2, "depth": F.col("depth") / 2, "roof_type": F.lit("flat")})
    two = rectangular_facades(two_in).withColumn("wing", F.lit(2))
    deg = F.col("heading_deg")
    base = buildings.select("building_id", "heading_deg", (F.col("width") / 2).alias("hw"), (F.col("depth") / 2).alias("hd"))
    ox, oy = angles.rotate_z(F.col("hw") if translate_wings else F.lit(0.0), F.lit(0.0), deg)
    both = one.unionByName(two).join(base, "building_id").withColumns({"ox": F.when(F.col("wing") == 2, ox).otherwise(0.0), "oy": F.when(F.col("wing") == 2, oy).otherwise(0.0)})
    moved = both.withColumn("vertices", F.transform("vertices", lambda p: F.struct((p["x"] + F.col("ox")).alias("x"), (p["y"] + F.col("oy")).alias("y"), p["z"].alias("z"))))
    moved = with_measures(moved)
    # Into the other wing's own frame, where its footprint is a box about its centre.
    px = F.when(F.col("wing") == 1, F.col("cx") - ox).otherwise(F.col("cx"))
    py = F.when(F.col("wing") == 1, F.col("cy") - oy).otherwise(F.col("cy"))
    back = F.when(F.col("wing") == 1, deg + 90).otherwise(deg)
    lx, ly = angles.rotate_z(px, py, -back)
    half = F.when(F.col("wing") == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    inside = (F.abs(F.col("nz")) < 0.01) & (F.abs(lx) < F.col("hw") * half - 1e-9) & (F.abs(ly) < F.col("hd") * half - 1e-9)
    kept = moved.where(~inside)
    order = Window.partitionBy("building_id").orderBy("wing", "facade_index")
    return kept.withColumn("facade_index", F.row_number().over(order) - 1).select("building_id", "facade_index", "wing", "label", "component_tag", "nx", "ny", "nz", "vertices", "cx", "cy", "cz", "width_m", "height_m", "area_m2")


def extrude_footprints(footprints: DataFrame) -> DataFrame:
    """``footprint_id, ring, height`` as one wall per side, counter-clockwise, and a flat roof last."""
    ring = polygon.ensure_ccw(F.col("ring"))
    rows = footprints.select("footprint_id", "height", ring.alias("ring")).where(F.size("ring") >= 3)
    side = rows.select("footprint_id", "height", "ring", F.posexplode("ring").alias("i", "a"))
    b = F.element_at("ring", F.when(F.col("i") + 2 > F.size("ring"), 1).otherwise(F.col("i") + 2))
    side = side.withColumn("b", b)
    ex, ey = F.col("b")["x"] - F.col("a")["x"], F.col("b")["y"] - F.col("a")["y"]
    n = F.sqrt(ex * ex + ey * ey)
    side = side.withColumns({"nx": ey / n, "ny": -ex / n}).where(n > 1e-9)
    walls = side.select("footprint_id", F.col("i").alias("facade_index"), F.concat(angles.facade_direction(F.col("nx"), F.col("ny"), F.lit(0.0)), F.lit("_wall_"), F.col("i")).alias("label"), F.lit("21.1").alias("component_tag"), "nx", "ny", F.lit(0.0).alias("nz"), n.alias("width_m"), F.col("height").cast("double").alias("height_m"))
    roof = rows.select("footprint_id", F.size("ring").alias("facade_index"), F.lit("roof_flat").alias("label"), F.lit("47.1").alias("component_tag"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (F.array_max(F.transform("ring", lambda p: p["x"])) - F.array_min(F.transform("ring", lambda p: p["x"]))).alias("width_m"), (F.array_max(F.transform("ring", lambda p: p["y"])) - F.array_min(F.transform("ring", lambda p: p["y"]))).alias("height_m"))
    return walls.unionByName(roof)


def _first_outside(step: float):
    """For Arrow batches: the first mark of a ray that lies outside its ring, null if none does, -1 if the ray starts outside."""

    def run(cx: pa.Array, cy: pa.Array, ux: pa.Array, uy: pa.Array, want: pa.Array, ring: pa.Array) -> pa.Array:
        cx, cy, ux, uy, want = (a.to_numpy(zero_copy_only=False) for a in (cx, cy, ux, uy, want))
        size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False)
        corner = ring.flatten()
        x, y = (corner.field(corner.type.get_field_index(a)).to_numpy(zero_copy_only=False).astype(float) for a in "xy")
        row = np.repeat(np.arange(len(size)), size)
        turned = np.arange(1, len(row) + 1)
        end = np.cumsum(size)[size > 0]
        turned[end - 1] = end - size[size > 0]
        bx, by = x[turned], y[turned]
        found = np.full(len(cx), np.nan)
        with np.errstate(all="ignore"):
            last = np.where(np.isfinite(want), np.maximum(np.floor(want / step), 1), 0)

            def inside(rows: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
                own = rows[row]
                r, ax, ay, ex, ey = row[own], x[own], y[own], bx[own], by[own]
                cross = ((ay > py[r]) != (ey > py[r])) & (px[r] < (ex - ax) * (py[r] - ay) / (ey - ay) + ax)
                return np.bincount(r[cross], minlength=len(rows)) % 2 == 1

            live = np.ones(len(cx), bool)
            live &= inside(live, cx, cy)
            found[~live] = -1.0
            live &= np.isfinite(ux) & np.isfinite(uy)
            k = 1
            while (live := live & (k <= last) & (k * step <= want)).any():
                out = live & ~inside(live, cx + ux * (k * step), cy + uy * (k * step))
                found[out] = k * step
                live &= ~out
                k += 1
        return pa.array(found, pa.float64(), mask=np.isnan(found))

    return run


def clamp_standoff(cx: Column, cy: Column, nx: Column, ny: Column, want: Column, ring: Column, least: float = CLEARANCE_M, buffer: float = 0.5, step: float = 0.25) -> Column:
    """Stand-off along the level normal that stays ``buffer`` inside the ring, never under
    ``least`` nor over ``want``; unchanged for roofs, faces outside, and rings under three corners.

    Rays meet rings in Arrow batches; faces with a missing or infinite number are judged by columns.
    """
    cx, cy, nx, ny, want = (c.cast("double") for c in (cx, cy, nx, ny, want))
    flat = F.sqrt(nx * nx + ny * ny)
    ux, uy = F.try_divide(nx, flat), F.try_divide(ny, flat)
    fine = lambda c: F.abs(c) < float("inf")
    whole = fine(cx) & fine(cy) & fine(nx) & fine(ny) & fine(want) & F.forall(ring, lambda p: fine(p["x"]) & fine(p["y"]))
    first = F.arrow_udf(_first_outside(step), "double")(cx, cy, ux, uy, want, ring)
    held = lambda out: F.least(want, F.greatest(F.lit(least), F.coalesce(out, want) - buffer))
    fast = F.when((flat < 1e-6) | (F.size(ring) < 3) | (first < 0), want).otherwise(held(first))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(want / step).cast("int"), F.lit(1))), lambda k: k * step)
    out = F.array_min(F.filter(marks, lambda s: (s <= want) & ~polygon.contains(ring, cx + ux * s, cy + uy * s)))
    odd = F.when((flat < 1e-6) | (F.size(ring) < 3) | ~polygon.contains(ring, cx, cy), want).otherwise(held(out))
    return F.when(whole, fast).otherwise(odd)


def facade_waypoints(facades: DataFrame, key: str = "building_id", gsd: float = GSD_MM, front: float = FRONT, side: float = SIDE, density: float = 1.0, cam: str = "wide", index: bool = False) -> DataFrame:
    """Photo grid before every face, in lawnmower order: ``key, facade_index, seq, row, col, x, y, z, heading_deg, gimbal_pitch_deg, speed_ms``.

    index: add ``idx`` as :func:`global_index` does, from the sizes of the faces before; no waypoint is sorted for it.

    Rows that would have the same camera height after the altitude floor are
    folded before columns are exploded. A column ``standoff_m`` in facades is
    used where it is; else the distance for the ground sample distance.
    """
    spec = next(s for s in camera.CAMERAS if s[0] == cam)
    rows = facades.withColumns({c: F.lit(v) for c, v in zip(("camera", "focal_length_mm", "sensor_width_mm", "sensor_height_mm", "image_width_px"), spec, strict=False)})
    want = F.greatest(camera.distance_for_gsd(F.lit(gsd)), F.lit(CLEARANCE_M))
    rows = rows.withColumn("d", F.coalesce(F.col("standoff_m"), want) if "standoff_m" in facades.columns else want)
    fw, fh = camera.footprint(F.col("d"))
    hs, vs = camera.grid_spacing(fw, fh, F.lit(front), F.lit(side))
    rows = rows.withColumns({"hs": hs / density, "vs": vs / density})
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    flat = F.sqrt(nx * nx + ny * ny)
    level = (F.abs(nz) > 0.99) | (flat < 1e-6)
    # Level tangent u and uphill v; east and north on flat roofs.
    rows = rows.withColumns({
        "ux": F.when(level, 1.0).otherwise(-ny / flat), "uy": F.when(level, 0.0).otherwise(nx / flat),
        "vx": F.when(level, 0.0).otherwise(-nx * nz / flat), "vy": F.when(level, 1.0).otherwise(-ny * nz / flat), "vz": F.when(level, 0.0).otherwise(flat),
    })
    at = lambda p: (p["x"] - F.col("cx"), p["y"] - F.col("cy"), p["z"] - F.col("cz"))
    us = F.transform("vertices", lambda p: at(p)[0] * F.col("ux") + at(p)[1] * F.col("uy"))
    vs_ = F.transform("vertices", lambda p: at(p)[0] * F.col("vx") + at(p)[1] * F.col("vy") + at(p)[2] * F.col("vz"))
    rows = rows.withColumns({"u0": F.array_min(us), "u1": F.array_max(us), "v0": F.array_min(vs_), "v1": F.array_max(vs_)})
    inset = F.least(F.lit(INSET_M), 0.25 * (F.col("u1") - F.col("u0")), 0.25 * (F.col("v1") - F.col("v0")))
    rows = rows.withColumn("inset", inset).withColumns({"u0": F.col("u0") + F.col("inset"), "u1": F.col("u1") - F.col("inset"), "v0": F.col("v0") + F.col("inset"), "v1": F.col("v1") - F.col("inset")})
    thin = (F.col("u1") <= F.col("u0")) | (F.col("v1") <= F.col("v0"))
    rows = rows.withColumns({c: F.when(thin, 0.0).otherwise(F.col(c)) for c in ("u0", "u1", "v0", "v1")})
    count = lambda a, b, s: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / F.col(s)).cast("int") + 1)
    rows = rows.withColumns({"ncol": count("u0", "u1", "hs"), "nrow": count("v0", "v1", "vs")})
    rows = rows.withColumns({"us": (F.col("u0") + F.col("u1")) / 2 - (F.col("ncol") - 1) * F.col("hs") / 2, "vs0": (F.col("v0") + F.col("v1")) / 2 - (F.col("nrow") - 1) * F.col("vs") / 2})
    height = lambda r: F.greatest(F.col("cz") + (F.col("vs0") + r * F.col("vs")) * F.col("vz") + F.col("d") * nz, F.lit(MIN_ALTITUDE_M))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("double").alias("last"))

    def fold(s: Column, r: Column) -> Column:
        z = height(r)
        new = (F.abs(nz) > 0.99) | s["last"].isNull() | (F.abs(z - s["last"]) >= 0.01)
        return F.struct(F.when(new, F.concat(s["kept"], F.array(r))).otherwise(s["kept"]).alias("kept"), F.when(new, z).otherwise(s["last"]).alias("last"))

    kept = F.aggregate(F.sequence(F.lit(0), F.col("nrow") - 1), start, fold, lambda s: s["kept"])
    if index:
        before = Window.partitionBy(key).orderBy("facade_index").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("kept", kept).withColumn("before", F.coalesce(F.sum(F.size("kept") * F.col("ncol")).over(before), F.lit(0)))
        kept = F.col("kept")
    rows = rows.select("*", F.posexplode(kept).alias("row", "r")).select("*", F.explode(F.sequence(F.lit(0), F.col("ncol") - 1)).alias("step"))
    rows = rows.withColumn("col", F.when(F.col("row") % 2 == 0, F.col("step")).otherwise(F.col("ncol") - 1 - F.col("step")))
    u, v = F.col("us") + F.col("col") * F.col("hs"), F.col("vs0") + F.col("r") * F.col("vs")
    rows = rows.withColumns({"tx": F.col("cx") + u * F.col("ux") + v * F.col("vx"), "ty": F.col("cy") + u * F.col("uy") + v * F.col("vy"), "tz": F.col("cz") + v * F.col("vz")})
    rows = rows.withColumns({"x": F.col("tx") + F.col("d") * nx, "y": F.col("ty") + F.col("d") * ny, "z": F.greatest(F.col("tz") + F.col("d") * nz, F.lit(MIN_ALTITUDE_M))})
    heading, pitch = angles.look_at(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("tz") - F.col("z"), MARGIN_DEG)
    seq = F.col("row") * F.col("ncol") + F.col("step")
    idx = [(F.col("before") + seq).cast("int").alias("idx")] if index else []
    return rows.select(key, "facade_index", seq.alias("seq"), "row", "col", "x", "y", "z", heading.alias("heading_deg"), pitch.alias("gimbal_pitch_deg"), F.lit(SPEED_MS).alias("speed_ms"), *idx)


def global_index(waypoints: DataFrame, key: str = "building_id", order: tuple[str, ...] = ("facade_index", "seq")) -> DataFrame:
    """Add ``idx``: contiguous from 0 within each key."""
    return waypoints.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def path_shots(waypoints: DataFrame, spacing: float = 0.65, poses: int = 5) -> DataFrame:
    """A shot every ``spacing`` metres of each mission's path: ``mission_id, shot, segment, distance_m, pose`` with the pose cycling over the whole path."""
    from scanloom.operators.paths import path, with_path

    p = with_path(waypoints)
    p = p.withColumn("before", F.coalesce(F.lag("cum_m").over(path()), F.lit(0.0))).where("seg_m > 0")
    first, last = F.ceil(F.col("before") / spacing), F.ceil(F.col("cum_m") / spacing) - 1
    shots = p.where(last >= first).select("mission_id", F.col("idx").alias("segment"), F.explode(F.sequence(first, last)).alias("shot"))
    return shots.select("mission_id", "shot", "segment", (F.col("shot") * spacing).alias("distance_m"), (F.col("shot") % poses).alias("pose"))


def zones_from_rings(rings: DataFrame) -> DataFrame:
    """Drawn corners ``mission_id, seq, x, y`` as prisms of height 15 +- 15 over their bounding box."""
    box = rings.groupBy("mission_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("polygon"))
    return box.select("mission_id", ((F.col("x0") + F.col("x1")) / 2).alias("center_x"), ((F.col("y0") + F.col("y1")) / 2).alias("center_y"), F.lit(15.0).alias("center_z"), (F.col("x1") - F.col("x0")).alias("size_x"), (F.col("y1") - F.col("y0")).alias("size_y"), F.lit(30.0).alias("size_z"), "polygon")
