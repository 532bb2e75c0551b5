"""Flown missions re-aimed at the faces of their scans, for many missions in one job.

A mission that can't go on becomes a status row and the others do; no step loops over missions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators import aggregates, clouds, edges, filters, joins, planes, voting
from scanloom.operators.joins import small
from scanloom.session import kept

#: Speed of re-aimed missions, faces that a method must find to be taken.
SPEED_MS, LEAST_FACES = 3.0, 3
FACE = ("cloud_id", "facade_index", "label", "component_tag", "nx", "ny", "nz", "vertices")
Method = Callable[[DataFrame, DataFrame | None], DataFrame]


def footprints(points: DataFrame) -> DataFrame:
    """``cloud_id, ring``: the hull in plan of each cloud's middle heights (30th to 70th percentile, exclusive), of all its points where these have no area."""
    middle = filters.height_slice(points, 0.30, 0.70)
    hulls = clouds.convex_hulls(middle.select("cloud_id", "x", "y")).unionByName(clouds.convex_hulls(points.join(middle.select("cloud_id").distinct(), "cloud_id", "left_anti").select("cloud_id", "x", "y")))
    return hulls.groupBy("cloud_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def grown_faces(points: DataFrame, rings: DataFrame | None = None, cell: float = 0.5, epsilon: float = 0.05, min_points: int = 60, density: float = planes.MIN_DENSITY, snap_deg: float = 5.0, coplanar_m: float | None = None) -> DataFrame:
    """Faces of grown planes: parallel ones share a normal, like offsets merge if ``coplanar_m`` is given, inliers become rectangles."""
    regions = clouds.plane_regions(points, cell, epsilon=epsilon)
    found = kept(clouds.planes_of(regions, min_points), "grown-planes")
    inliers = clouds.plane_inliers(points, found, regions, cell, epsilon)
    snapped = planes.snap_parallel(found.drop("region", "d", "rms"), snap_deg)
    if coplanar_m is not None:
        snapped = kept(planes.merge_coplanar(snapped, coplanar_m), "merged-planes")
        inliers = planes.relabel(inliers, snapped)
    r = planes.as_facades(planes.oriented_rectangles(snapped, inliers, density=density)).withColumnRenamed("building_id", "cloud_id")
    return r.select(*FACE)


def _edge_faces(points: DataFrame, rings: DataFrame | None) -> DataFrame:
    rings = footprints(points) if rings is None else rings
    return edges.polygon_edge_facades(rings, points)[0].select(*FACE)


#: Ways to faces, the first that finds enough is taken; edges come last.
METHODS: dict[str, Method] = {
    "grown": grown_faces,
    "walls": lambda points, rings: voting.ransac_wall_faces(points).select(*FACE),
    "voted": lambda points, rings: voting.ransac_plane_faces(points).select(*FACE),
    "edges": _edge_faces,
}


def extract_faces(points: DataFrame, rings: DataFrame | None = None, methods: dict[str, Method] | None = None, least: int = LEAST_FACES, margin: float = 2.0) -> DataFrame:
    """``building_id`` (the cloud's), faces with centre and ``method``: of the first method that finds ``least`` in a cloud, the last if none does.

    Each method sees only the clouds that are still open. Faces whose centre lies outside the cloud's ring (``cloud_id, ring``), widened by margin, go.
    """
    methods, parts, open_ = methods or METHODS, [], points
    for n, (name, method) in enumerate(methods.items()):
        found = kept(method(open_, rings).withColumn("method", F.lit(name)), f"faces-{name}")
        if n < len(methods) - 1:
            enough = small(found.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cloud_id"))
            parts.append(found.join(enough, "cloud_id", "left_semi"))
            open_ = kept(open_.join(enough, "cloud_id", "left_anti"), "faces-open")
            if not open_.head(1):
                break
        else:
            parts.append(found)
    whole = reduce(DataFrame.unionByName, parts).withColumnRenamed("cloud_id", "building_id")
    centre = lambda a: F.aggregate("vertices", F.lit(0.0), lambda s, p: s + p[a]) / F.size("vertices")
    whole = whole.withColumns({f"c{a}": centre(a) for a in "xyz"})
    return whole if rings is None else filters.facades_in_area(whole, rings.withColumnRenamed("cloud_id", "building_id"), margin=margin)


def apply_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points moved by their cloud's row-major 4x4 ``m``; clouds without one stay where they are."""
    m = F.col("m")
    at = [F.when(m.isNull(), F.col(a)).otherwise(m[4 * r] * F.col("x") + m[4 * r + 1] * F.col("y") + m[4 * r + 2] * F.col("z") + m[4 * r + 3]) for r, a in enumerate("xyz")]
    return points.join(small(poses.select("cloud_id", "m")), "cloud_id", "left").select(*[e.alias(c) if e is not None else F.col(c) for c, e in ((c, dict(zip("xyz", at, strict=True)).get(c)) for c in points.columns)])


@dataclass
class Augmented:
    """waypoints: of the missions that went through, re-aimed; facades; status: ``mission_id, status, reason, waypoints, faces, matched, mean_pitch`` of every mission."""

    waypoints: DataFrame
    facades: DataFrame
    status: DataFrame


def augment_missions(waypoints: DataFrame, points: DataFrame, rings: DataFrame | None = None, poses: DataFrame | None = None, methods: dict[str, Method] | None = None) -> Augmented:
    """Re-aim every mission at the faces of its scan.

    waypoints: flown rows in local metres (``mission_id, idx, x, y, z, heading_deg, gimbal_pitch_deg, gimbal_yaw_deg, speed_ms, is_transition``); points and
    rings: ``cloud_id`` is the mission's; poses: ``cloud_id, m``, the registration of scans that aren't in the mission's frame yet. Rows look at the centre of their best
    face at 3 m/s; rows without a face in reach keep their look. Missions without a scan or without a face have status ``failed`` and give no
    waypoints; so do scans without a mission nothing at all.
    """
    mine = waypoints.select(F.col("mission_id").alias("cloud_id")).distinct()
    scans = points.join(mine, "cloud_id", "left_semi")
    scans = kept(scans if poses is None else apply_poses(scans, poses), "augment-scans")
    f = kept(extract_faces(scans, rings, methods), "augment-faces")
    faces = f.groupBy(F.col("building_id").alias("mission_id")).agg(F.count("*").alias("faces"))
    able = faces.select("mission_id")
    rows = waypoints.join(small(able), "mission_id", "left_semi").drop("building_id").withColumn("building_id", F.col("mission_id"))
    aimed = joins.reaim(rows, f.withColumn("mission_id", F.col("building_id")).drop("mission_id")).withColumn("speed_ms", F.lit(SPEED_MS)).drop("building_id")
    aimed = kept(aimed, "augment-waypoints")
    n = waypoints.groupBy("mission_id").agg(F.count("*").alias("waypoints"))
    matched = aimed.groupBy("mission_id").agg(F.count_if(F.col("facade_index") >= 0).alias("matched"))
    pitch = aggregates.gimbal_stats(aimed).select("mission_id", "mean_pitch")
    scanned = scans.select(F.col("cloud_id").alias("mission_id"), F.lit(True).alias("scanned")).distinct()
    zero = F.lit(0).cast("long")
    s = n.join(scanned, "mission_id", "left").join(faces, "mission_id", "left").join(matched, "mission_id", "left").join(pitch, "mission_id", "left")
    reason = F.when(F.col("scanned").isNull(), "no scan").when(F.col("faces").isNull(), "no faces")
    status = s.select("mission_id", F.when(reason.isNull(), "ok").otherwise("failed").alias("status"), reason.alias("reason"), "waypoints", F.coalesce("faces", zero).alias("faces"), F.coalesce("matched", zero).alias("matched"), "mean_pitch")
    return Augmented(aimed, f, status)


def summaries(status: DataFrame) -> DataFrame:
    """``mission_id, value``: one JSON document a mission, its gimbal figures nested."""
    return status.select("mission_id", F.to_json(F.struct("mission_id", "status", "reason", "waypoints", "faces", F.struct("matched", (F.col("waypoints") - F.col("matched")).alias("unmatched"), "mean_pitch").alias("gimbal"))).alias("value"))


def read_summaries(lines: DataFrame) -> DataFrame:
    """The status rows of documents as :func:`summaries` writes them, in ``value``; what is no such document gives a row of nulls."""
    d = F.from_json("value", "mission_id BIGINT, status STRING, reason STRING, waypoints BIGINT, faces BIGINT, gimbal STRUCT<matched: BIGINT, unmatched: BIGINT, mean_pitch: DOUBLE>")
    return lines.select(d.alias("d")).select("d.mission_id", "d.status", "d.reason", "d.waypoints", "d.faces", "d.gimbal.matched", "d.gimbal.unmatched", "d.gimbal.mean_pitch")


def ordered_versions(versions: DataFrame) -> DataFrame:
    """Versions ``mission_id, version_id, ts, …`` newest first with ``age`` (0: the newest of its mission; of equal times the higher id)."""
    w = Window.partitionBy("mission_id").orderBy(F.desc("ts"), F.desc("version_id"))
    return versions.withColumn("age", F.row_number().over(w) - 1).orderBy(F.desc("ts"), F.desc("version_id"))
