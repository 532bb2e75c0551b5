"""Filters of waypoints, faces and clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import polygon, vec
from scanloom.operators.joins import small, within

#: The least and largest value of mission knobs.
BOUNDS = (("speed_ms", 0.5, 15.0), ("gimbal_pitch_deg", -90.0, 35.0), ("z", 2.0, 120.0), ("heading_deg", 0.0, 360.0))


def zone_verdicts(waypoints: DataFrame, zones: DataFrame) -> DataFrame:
    """Waypoints with ``allowed``: inside some inclusion zone of their mission if it has any, in no
    no-fly zone, and (inspection rows) in no no-inspect zone. Zones with a ``polygon`` of three corners
    or more are that prism, others their box. Equal zones are met once, and a row only by zones that hold it."""
    ring = ["polygon"] if "polygon" in zones.columns else []
    z = zones.select("mission_id", "zone_type", "center_x", "center_y", "center_z", "size_x", "size_y", "size_z", *ring).distinct()
    inside = polygon.zone_contains(F.col("x"), F.col("y"), F.col("z"), (F.col("center_x"), F.col("center_y"), F.col("center_z")), (F.col("size_x"), F.col("size_y"), F.col("size_z")), F.col("polygon") if ring else None)
    held = waypoints.select("mission_id", "idx", "x", "y", "z").join(small(z), "mission_id").where(inside)
    hit = held.groupBy("mission_id", "idx").agg(*[F.bool_or(F.col("zone_type") == t).alias(n) for t, n in (("inclusion", "included"), ("no_fly", "no_fly"), ("no_inspect", "no_inspect"))])
    bounded = z.where("zone_type = 'inclusion'").select("mission_id").distinct().withColumn("bounded", F.lit(True))
    rows = waypoints.join(hit, ["mission_id", "idx"], "left").join(small(bounded), "mission_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    allowed = (~no("bounded") | no("included")) & ~no("no_fly") & (F.col("is_transition") | ~no("no_inspect"))
    return rows.withColumn("allowed", allowed).drop("bounded", "included", "no_fly", "no_inspect")


def filter_by_zones(waypoints: DataFrame, zones: DataFrame) -> DataFrame:
    return zone_verdicts(waypoints, zones).where("allowed").drop("allowed")


def clip_to_area(waypoints: DataFrame, areas: DataFrame, margin: float = 2.0) -> DataFrame:
    """Inspection rows inside their mission's ring (``mission_id, ring``) widened by margin; transit rows and missions without a ring pass."""
    rows = waypoints.join(small(areas.select("mission_id", polygon.expand(F.col("ring"), F.lit(margin)).alias("ring"))), "mission_id", "left")
    inside = polygon.contains(F.col("ring"), F.col("x"), F.col("y"))
    return rows.where(F.col("is_transition") | F.col("ring").isNull() | (F.size("ring") < 3) | inside).drop("ring")


def facades_in_area(facades: DataFrame, areas: DataFrame, key: str = "building_id", margin: float = 2.0) -> DataFrame:
    """Faces whose centre lies in the widened ring of their key."""
    rows = facades.join(small(areas.select(key, polygon.expand(F.col("ring"), F.lit(margin)).alias("ring"))), key, "left")
    return rows.where(F.col("ring").isNull() | polygon.contains(F.col("ring"), F.col("cx"), F.col("cy"))).drop("ring")


def obstructed(waypoints: DataFrame, points: DataFrame, facades: DataFrame, clearance: float = 2.0, cone_deg: float = 60.0, key: str = "building_id") -> DataFrame:
    """Waypoints with a cloud point within clearance that isn't in the cone towards their own face:
    ``mission_id, idx``. A point at the waypoint itself always counts; transit rows have no cone."""
    # Poses that are flown again and points at one place are judged once.
    pose = [key, "x", "y", "z", "is_transition", "facade_index"]
    w = waypoints.select("mission_id", "idx", *pose)
    f = facades.select(key, "facade_index", "nx", "ny", "nz")
    poses = w.select(*pose).distinct().join(small(f), [key, "facade_index"], "left")
    near = within(poses, points.select(key, "x", "y", "z").distinct(), clearance, key)
    a, b = F.col("a"), F.col("b")
    cos = -((b["x"] - a["x"]) * a["nx"] + (b["y"] - a["y"]) * a["ny"] + (b["z"] - a["z"]) * a["nz"]) / F.col("distance")
    subject = ~a["is_transition"] & a["nx"].isNotNull() & (F.col("distance") >= 1e-6) & (cos > F.cos(F.radians(F.lit(cone_deg))))
    hit = near.where(~F.coalesce(subject, F.lit(False))).select("a.*").select(*[F.col(c).alias(f"_{c}") for c in pose]).distinct()
    # A face may be null, as the row of a face that isn't there.
    return w.join(hit, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pose], "left_semi").select("mission_id", "idx").distinct()


def height_slice(points: DataFrame, low: float, high: float, strict: bool = True) -> DataFrame:
    """Points between two height percentiles of their cloud."""
    q = points.groupBy("cloud_id").agg(F.percentile("z", F.array(F.lit(low), F.lit(high))).alias("q"))
    rows = points.join(small(q), "cloud_id")
    inside = (F.col("z") > F.col("q")[0]) & (F.col("z") < F.col("q")[1]) if strict else F.col("z").between(F.col("q")[0], F.col("q")[1])
    return rows.where(inside).drop("q")


def drop_ground(points: DataFrame, above: float = 1.0) -> DataFrame:
    """Points at least ``above`` over their cloud's fifth height percentile."""
    q = points.groupBy("cloud_id").agg(F.percentile("z", 0.05).alias("q"))
    return points.join(small(q), "cloud_id").where(F.col("z") >= F.col("q") + above).drop("q")


def invalid_numbers(waypoints: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows with a NaN or infinite field, and the first such field."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    first = F.coalesce(*[F.when(bad(c), F.lit(c)) for c in fields])
    return waypoints.withColumn("bad_field", first).where("bad_field is not null")


def out_of_range(rows: DataFrame, key: list[str], bounds: tuple = BOUNDS) -> DataFrame:
    """One row per violation of the inclusive bounds."""
    checks = F.array(*[F.struct(F.lit(n).alias("knob"), F.col(n).cast("double").alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for n, lo, hi in bounds])
    return rows.select(*key, F.inline(checks)).where("value < low or value > high")


def best_extraction(found: DataFrame, key: str = "building_id", least: int = 3) -> DataFrame:
    """Of faces by several methods (``priority``): those of the first method with at least ``least`` faces."""
    n = found.groupBy(key, "priority").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = n.groupBy(key).agg(F.min("priority").alias("priority"))
    return found.join(first, [key, "priority"], "left_semi")


def with_selection(facades: DataFrame, disabled: DataFrame, candidates: DataFrame, key: str = "building_id") -> DataFrame:
    """Faces less the disabled ones, and the enabled candidates after them with the next indexes and an ``added_`` label."""
    kept = facades.join(disabled, [key, "facade_index"], "left_anti")
    top = facades.groupBy(key).agg(F.max("facade_index").alias("top"))
    order = Window.partitionBy(key).orderBy("facade_index")
    added = candidates.join(top, key, "left").withColumns({"label": F.concat(F.lit("added_"), "label"), "facade_index": F.coalesce("top", F.lit(-1)) + F.row_number().over(order)}).select(*facades.columns)
    return kept.unionByName(added)


def reject_reason(regions: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first of area, normal, ground, occlusion that a region fails (null: kept)."""
    why: Column = F.when(F.col("area_m2") < 1.0, "area").when(F.col("nz") < -0.3, "normal").when(F.col("cz") < 0.3, "ground").when(F.col("visible") < 0.3, "occlusion")
    return regions.withColumn("reject_reason", why)


def size_gate(planes: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Planes large enough for their kind, with ``kind`` and a label numbered within it."""
    n = F.abs("nz")
    kind = F.when(n <= 0.35, "wall").when(n >= 0.70, "roof").otherwise("tilted")
    rows = planes.withColumn("kind", kind).withColumns({"lo": F.least("width_m", "height_m"), "hi": F.greatest("width_m", "height_m")})
    least = F.when(F.col("kind") == "wall", 0.6).when(F.col("kind") == "roof", 0.5).otherwise(0.4)
    ok = F.when(F.col("kind") == "wall", (F.col("lo") >= 0.4) & (F.col("hi") >= 0.6) & (F.col("lo") * F.col("hi") >= 0.5)).otherwise(F.col("lo") >= least)
    order = Window.partitionBy(key, "kind").orderBy("plane_id")
    return rows.where(ok).withColumn("label", F.concat("kind", F.lit("_"), F.row_number().over(order) - 1)).drop("lo", "hi")


def density_gate(planes: DataFrame, least: float = 25.0) -> DataFrame:
    """Planes with at least ``least`` points per square metre."""
    return planes.where(F.col("points") / F.col("area_m2") >= least)


def photographable(samples: DataFrame, standoff: float) -> DataFrame:
    """Samples that don't look down, lie above ground and whose camera stays above the floor."""
    return samples.where((F.col("nz") >= -0.3) & (F.col("z") >= 0.3) & (F.col("z") + F.col("nz") * standoff >= 2.0))


def plane_distance(prefix: str = "") -> Column:
    """Signed distance of (x, y, z) from the plane through c with normal n."""
    return vec.dot(vec.sub(vec.at(), vec.at(f"{prefix}cx", f"{prefix}cy", f"{prefix}cz")), vec.at(f"{prefix}nx", f"{prefix}ny", f"{prefix}nz"))
