"""Mission rules: one row per finding, ``mission_id, severity, code, n, waypoint_indices``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators import aggregates, filters, joins, paths

#: Hardware limits.
MAX_WAYPOINTS, MIN_Z, MAX_SPEED, MAX_MINUTES, CLEARANCE_M = 65_535, 2.0, 21.0, 32.0, 2.0
RANK = {"error": 0, "warning": 1, "info": 2}
NUMBERS = ("x", "y", "z", "heading_deg", "gimbal_pitch_deg", "gimbal_yaw_deg", "speed_ms")


def _finding(rows: DataFrame, rule: int, severity: str, code: str, keep: int | None = None, each: bool = False) -> DataFrame:
    """Findings of the rows that break a rule: one a mission, or one a row."""
    idx = F.sort_array(F.collect_list("idx"))
    g = rows.groupBy("mission_id", *(["idx"] if each else [])).agg(F.count("*").alias("n"), (idx if keep is None else F.slice(idx, 1, keep)).alias("waypoint_indices"))
    return g.select("mission_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), "n", "waypoint_indices")


def _mission(rows: DataFrame, rule: int, severity: Column | str, code: Column | str, n: Column) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select("mission_id", F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(code).alias("code"), n.cast("long").alias("n"), F.array().cast("array<int>").alias("waypoint_indices"))


def issues(missions: DataFrame, waypoints: DataFrame, facades: DataFrame, zones: DataFrame) -> DataFrame:
    """All rules over all missions. missions lists every ``mission_id``, so empty ones are found too."""
    look = waypoints.where("not is_transition")
    w = Window.partitionBy("mission_id").orderBy("idx")
    first = lambda df: df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    n = waypoints.groupBy("mission_id").agg(F.count("*").alias("n"))
    minutes = aggregates.flight_time(waypoints).withColumn("share", F.col("model_a_s") / 60 / MAX_MINUTES)
    faced = look.join(joins.small(facades.select("building_id", "facade_index", "nx", "ny", "nz", "cx", "cy", "cz")), ["building_id", "facade_index"])
    verdicts = filters.zone_verdicts(waypoints, zones)
    own = waypoints.select("mission_id", "building_id").distinct()
    bare = joins.uncovered(facades, waypoints).join(own, "building_id").groupBy("mission_id").agg(F.count("*").alias("k"))
    turn = paths.angles.angle_delta(F.col("heading_deg"), F.coalesce("gimbal_yaw_deg", "heading_deg"))
    found = [
        _mission(missions.join(n, "mission_id", "left_anti"), 1, "error", "no_waypoints", F.lit(0)),
        _finding(filters.invalid_numbers(waypoints, NUMBERS), 2, "error", "invalid_waypoint_value", each=True),
        _mission(n.where(F.col("n") > MAX_WAYPOINTS), 3, "error", "too_many_waypoints", F.col("n")),
        _finding(waypoints.where(F.col("z") < MIN_Z), 4, "error", "altitude_below_min"),
        _finding(waypoints.where(F.col("speed_ms") > MAX_SPEED), 5, "error", "speed_exceeds_max"),
        _finding(first(look.where("gimbal_pitch_deg < -90 or gimbal_pitch_deg > 35")), 6, "warning", "gimbal_pitch_clamped"),
        _finding(look.where("gimbal_pitch_deg <= -80"), 7, "info", "gimbal_near_limit", 5),
        _finding(paths.photo_interval(waypoints), 8, "warning", "photo_interval_too_short", 5),
        _mission(minutes.where("share > 0.8"), 9, "warning", "exceeds_flight_time", F.col("model_a_s") / 60),
        _mission(minutes.where("share > 0.65 and share <= 0.8"), 10, "info", "near_flight_time_limit", F.col("model_a_s") / 60),
        _finding(first(faced.where(F.abs(filters.plane_distance()) < CLEARANCE_M)), 11, "warning", "too_close_to_surface"),
        _finding(verdicts.where("not allowed"), 12, "info", "exclusion_zone_filtered", 5),
        _mission(bare, 13, "warning", "facades_uncovered", F.col("k")),
        _finding(paths.near_duplicates(waypoints), 19, "warning", "near_duplicate", 5),
        _finding(look.where(turn > 30), 20, "info", "heading_misaligned", 5),
        _finding(paths.reversals(waypoints), 21, "info", "path_reversal", 5),
    ]
    return reduce(DataFrame.unionByName, found)


def filter_issues(clipped: DataFrame, blocked: DataFrame, collisions: DataFrame, resolved: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings about what filters did, one a mission: rows ``mission_id, idx`` clipped at the area's edge, blocked by the
    cloud, legs that still meet the mesh, legs that a detour mended, and disabled faces ``mission_id, facade_index``."""
    return reduce(DataFrame.unionByName, [
        _finding(clipped, 14, "warning", "mapping_polygon_clipped", 5),
        _finding(blocked, 15, "warning", "pointcloud_obstacle", 5),
        _finding(collisions, 16, "warning", "path_collision", 5),
        _finding(resolved, 17, "info", "path_collision_resolved", 5),
        _finding(disabled.withColumnRenamed("facade_index", "idx"), 18, "info", "facades_disabled", 5),
    ])


def ranked(found: DataFrame) -> DataFrame:
    """Worst severity first, then in rule order, within each mission: adds ``position``."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    order = Window.partitionBy("mission_id").orderBy(rank, "rule", F.element_at(F.concat("waypoint_indices", F.array(F.lit(-1))), 1))
    return found.withColumn("position", F.row_number().over(order))


def counts(found: DataFrame) -> DataFrame:
    """Errors, warnings and infos per mission, and whether export is blocked."""
    g = found.groupBy("mission_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in RANK])
    return g.withColumn("blocked", F.col("error") > 0)
