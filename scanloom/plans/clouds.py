"""Queries of the cloud operators, graph and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import clouds, neighbours, graph, validate
from scanloom.plans.common import FACADES_SQL, facades, fold180, rounded
from scanloom.plans.missions import SEG
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

PT, WP, ZN = (f"{n} AS ({VIEWS[n]})" for n in ("points", "waypoints", "zones"))


def pts(spark, sf_dir):
    return view(spark, sf_dir, "points")


_KEY = ", ".join(f"CAST(floor({a}/0.25e0) AS BIGINT) AS i{a}" for a in "xyz")


@register("voxel_mean", f"WITH {PT}, k AS (SELECT *, {_KEY} FROM points) SELECT cloud_id, ix, iy, iz, round(avg(x),6)+0 AS x, round(avg(y),6)+0 AS y, round(avg(z),6)+0 AS z, count(*) AS n FROM k GROUP BY cloud_id, ix, iy, iz")
def voxel_mean(spark, sf_dir):
    return rounded(clouds.voxel_downsample(pts(spark, sf_dir), 0.25))


@register("voxel_first", f"WITH {PT}, k AS (SELECT *, {_KEY} FROM points) SELECT cloud_id, ix, iy, iz, round(arg_min(x,point_id),6)+0 AS x, round(arg_min(y,point_id),6)+0 AS y, round(arg_min(z,point_id),6)+0 AS z, min(point_id) AS point_id, count(*) AS n FROM k GROUP BY cloud_id, ix, iy, iz")
def voxel_first(spark, sf_dir):
    return rounded(clouds.voxel_downsample(pts(spark, sf_dir), 0.25, "first"))


@register("nn_spacing_defaults", f"WITH {PT}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY md5(cloud_id || '|' || point_id), point_id) AS rn FROM points) WHERE rn <= 5000), m AS (SELECT a.cloud_id, a.point_id, sqrt(min((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) AS d FROM v a JOIN points b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id GROUP BY ALL), s AS (SELECT cloud_id, median(greatest(0.01e0, least(0.3e0, d))) AS nn_m FROM m GROUP BY cloud_id) SELECT cloud_id, round(nn_m,6) AS nn_m, round(greatest(0.015e0, least(0.05e0, nn_m*0.5)),6) AS epsilon_m, round(greatest(0.1e0, least(0.5e0, nn_m*4)),6) AS cluster_m, CAST(greatest(25e0, least(250e0, round(0.3/(nn_m*nn_m)))) AS INT) AS min_points, round(greatest(0.03e0, least(0.15e0, nn_m*1.5)),6) AS mesh_voxel_m FROM s")
def nn_spacing_defaults(spark, sf_dir):
    return rounded(clouds.detection_defaults(clouds.nn_spacing(pts(spark, sf_dir), reach=0.3)))


#: Every point has six others within a metre here.
_KNN = f"{PT}, c AS (SELECT *, floor(x) AS cx, floor(y) AS cy, floor(z) AS cz FROM points), u AS (SELECT unnest([-1e0,0e0,1e0]) AS o), n AS (SELECT a.cloud_id, a.point_id, b.point_id AS o, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d FROM (SELECT c.*, cx+i.o AS kx, cy+j.o AS ky, cz+k.o AS kz FROM c, u i, u j, u k) a JOIN c b ON a.cloud_id = b.cloud_id AND a.kx = b.cx AND a.ky = b.cy AND a.kz = b.cz AND a.point_id <> b.point_id WHERE (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 1e0)"


@register("statistical_outliers", f"WITH {_KNN}, k AS (SELECT cloud_id, point_id, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, point_id ORDER BY d, o) AS r FROM n) WHERE r <= 6 GROUP BY ALL), l AS (SELECT cloud_id, avg(m) + 1.5e0*stddev_samp(m) AS lim FROM k GROUP BY cloud_id) SELECT cloud_id, point_id FROM k JOIN l USING (cloud_id) WHERE m <= lim")
def statistical_outliers(spark, sf_dir):
    return clouds.remove_outliers(pts(spark, sf_dir), k=6, ratio=1.5).select("cloud_id", "point_id")


@register("rigid_transform", f"WITH {PT} SELECT cloud_id, point_id, round(0.8e0*x-0.6e0*y+1,6)+0 AS x, round(0.6e0*x+0.8e0*y-2,6)+0 AS y, round(z+0.5e0,6)+0 AS z FROM points")
def rigid_transform(spark, sf_dir):
    m = [0.8, -0.6, 0.0, 1.0, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    return rounded(clouds.apply_transform(pts(spark, sf_dir), m).select("cloud_id", "point_id", "x", "y", "z"))


@register("greedy_point_dedup", f"WITH RECURSIVE {WP}, e AS (SELECT b.mission_id, b.idx AS hi, list(a.idx) AS lows FROM waypoints a JOIN waypoints b ON a.mission_id = b.mission_id AND a.idx < b.idx AND (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 2.25e0 GROUP BY ALL), o AS (SELECT v.mission_id, v.idx, lows FROM waypoints v LEFT JOIN e ON e.mission_id = v.mission_id AND e.hi = v.idx), "
          "g AS (SELECT mission_id, idx, [idx] AS kept FROM o WHERE idx = 0 UNION ALL SELECT o.mission_id, o.idx, CASE WHEN lows IS NOT NULL AND list_has_any(kept, lows) THEN kept ELSE list_append(kept, o.idx) END FROM g JOIN o ON o.mission_id = g.mission_id AND o.idx = g.idx + 1), z AS (SELECT mission_id, max(idx) AS idx FROM g GROUP BY mission_id) SELECT mission_id, unnest(kept) AS idx FROM g JOIN z USING (mission_id, idx)")
def greedy_point_dedup(spark, sf_dir):
    """The positions of every mission, as its path takes them."""
    p = view(spark, sf_dir, "waypoints").select(F.col("mission_id").alias("cloud_id"), F.col("idx").alias("point_id"), "x", "y", "z")
    return clouds.greedy_dedupe(p, 1.5).select(F.col("cloud_id").alias("mission_id"), F.col("point_id").alias("idx"))


@register("pose_dedup_within", f"""WITH RECURSIVE {WP}, e AS (SELECT a.mission_id, a.idx AS i, b.idx AS j, CASE WHEN abs(a.gimbal_pitch_deg) <= abs(b.gimbal_pitch_deg) THEN b.idx ELSE a.idx END AS loser FROM waypoints a JOIN waypoints b ON a.mission_id = b.mission_id AND a.idx < b.idx
  AND (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 9e0 AND least(abs(a.heading_deg-b.heading_deg), 360-abs(a.heading_deg-b.heading_deg)) < 60),
o AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY i, j) AS r FROM e),
g AS (SELECT mission_id, CAST(0 AS BIGINT) AS r, CAST([] AS INT[]) AS gone FROM waypoints WHERE idx = 0 UNION ALL
  SELECT o.mission_id, o.r, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END FROM g JOIN o ON o.mission_id = g.mission_id AND o.r = g.r + 1),
z AS (SELECT mission_id, arg_max(gone, r) AS gone FROM g GROUP BY mission_id)
SELECT w.mission_id, w.idx FROM waypoints w JOIN z USING (mission_id) WHERE NOT list_contains(gone, idx)""")
def pose_dedup_within(spark, sf_dir):
    """Positions that look the same way, thinned to the flatter look."""
    p = view(spark, sf_dir, "waypoints").select(F.col("mission_id").alias("cloud_id"), F.col("idx").alias("point_id"), "x", "y", "z", "heading_deg", "gimbal_pitch_deg")
    return clouds.dedupe_poses_within(p, 3.0, 60.0).select(F.col("cloud_id").alias("mission_id"), F.col("point_id").alias("idx"))


@register("cloud_normals")
def cloud_normals(spark, sf_dir):
    """Normals of all points, counted by the face that they are on and the axis that they follow within 10 degrees."""
    p = pts(spark, sf_dir)
    n = neighbours.estimate_normals(p, 18)
    axis = F.when(F.abs("nx") > 0.985, "x").when(F.abs("ny") > 0.985, "y").when(F.abs("nz") > 0.985, "z").otherwise("none")
    return p.join(n, ["cloud_id", "point_id"]).groupBy("cloud_id", "plane_id", axis.alias("axis")).agg(F.count("*").alias("points"))


@register("dbscan")
def dbscan(spark, sf_dir):
    return clouds.dbscan(pts(spark, sf_dir), 0.12, 4)


@register("grow_planes")
def grow_planes(spark, sf_dir):
    return rounded(clouds.grow_planes(pts(spark, sf_dir)))


@register("plane_fit")
def plane_fit(spark, sf_dir):
    return rounded(clouds.fit_planes(clouds.moments(pts(spark, sf_dir), "cloud_id", "plane_id")).select("cloud_id", "plane_id", "n", "nx", "ny", "nz", "d", "rms"))


@register("convex_hulls")
def convex_hulls(spark, sf_dir):
    return rounded(clouds.convex_hulls(pts(spark, sf_dir)))


@register("register_clouds")
def register_clouds(spark, sf_dir):
    """Every cloud against itself turned by 90 degrees and its number, and moved: the yaw found (from before or behind, which a box can't tell)."""
    p = pts(spark, sf_dir)
    a = F.radians(90 + F.col("cloud_id"))
    turned = p.withColumns({"x": F.col("x") * F.cos(a) - F.col("y") * F.sin(a) + 3, "y": F.col("x") * F.sin(a) + F.col("y") * F.cos(a) - 2, "z": F.col("z") + 0.5})
    found = clouds.register_scales(turned, p, (0.6, 0.3), rounds=6)
    return found.select("cloud_id", F.round("yaw_deg", 3).alias("yaw_deg"), F.round(F.element_at("per_scale", -1)["fitness"], 4).alias("fitness"))


_EDGES = "SELECT o_orderkey AS src, 10000000 + o_custkey AS dst FROM orders"


@register("connected_components", f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT DISTINCT a AS n, a AS m FROM b UNION SELECT b.b, c.m FROM c JOIN b ON b.a = c.n WHERE c.m < b.b) SELECT n AS node, min(m) AS component FROM c GROUP BY n")
def connected_components(spark, sf_dir):
    view(spark, sf_dir, "waypoints")  # registers orders
    return graph.connected_components(spark.sql(_EDGES))


_T = f"{fold180('(heading_deg - lag(heading_deg) OVER (PARTITION BY mission_id ORDER BY idx))')}"
_V = f"""WITH {FACADES_SQL}, {SEG}, {ZN}, ms AS (SELECT DISTINCT s_suppkey % 60 AS mission_id FROM supplier), lk AS (SELECT * FROM waypoints WHERE NOT is_transition),
t AS (SELECT *, {_T} AS turn FROM s), ft AS (SELECT mission_id, sum(seg_m)/3e0 + count(*) FILTER (NOT is_transition) + coalesce(sum(turn/60e0) FILTER (turn > 1),0) + 60 AS a FROM t GROUP BY mission_id),
pi AS (SELECT mission_id, idx FROM (SELECT mission_id, idx, facade_index, lag(facade_index) OVER w AS f, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) AS d FROM lk WINDOW w AS (PARTITION BY mission_id ORDER BY idx)) WHERE f = facade_index AND d/3e0 < 0.5 AND d < 1.5),
sf AS (SELECT w.mission_id, w.idx, row_number() OVER (PARTITION BY w.mission_id ORDER BY w.idx) AS r FROM lk w JOIN facades f USING (building_id, facade_index) WHERE abs((w.x-cx)*nx+(w.y-cy)*ny+(w.z-cz)*nz) < 2),
h AS (SELECT w.mission_id, w.idx, bool_or(zone_type = 'inclusion') AS b, bool_or(zone_type = 'inclusion' AND i) AS inc, bool_or(zone_type = 'no_fly' AND i) AS nf, bool_or(zone_type = 'no_inspect' AND i) AS ni FROM (SELECT w.*, zone_type, abs(w.z-center_z) <= size_z/2 AND abs(w.x-center_x) <= size_x/2 AND abs(w.y-center_y) <= size_y/2 AS i FROM waypoints w JOIN zones zz USING (mission_id)) w GROUP BY ALL),
zo AS (SELECT w.mission_id, w.idx FROM waypoints w JOIN h USING (mission_id, idx) WHERE NOT ((NOT b OR inc) AND NOT nf AND (is_transition OR NOT ni))),
un AS (SELECT DISTINCT w.mission_id, f.building_id, f.facade_index FROM facades f JOIN (SELECT DISTINCT mission_id, building_id FROM waypoints) w USING (building_id) WHERE width_m*height_m >= 2 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.building_id = f.building_id AND lk.facade_index = f.facade_index)),
nd AS (SELECT a.mission_id, a.idx FROM lk a JOIN lk b ON a.mission_id = b.mission_id AND b.idx BETWEEN a.idx+1 AND a.idx+4 WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) < 0.5),
rv AS (SELECT mission_id, idx FROM (SELECT mission_id, idx, x-lag(x) OVER w AS ax, y-lag(y) OVER w AS ay, lead(x) OVER w-x AS bx, lead(y) OVER w-y AS b2, is_transition OR lag(is_transition) OVER w OR lead(is_transition) OVER w AS t FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx)) WHERE sqrt(ax*ax+ay*ay) >= 0.1 AND sqrt(bx*bx+b2*b2) >= 0.1 AND NOT t AND degrees(acos(greatest(-1e0, least(1e0, (ax*bx+ay*b2)/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+b2*b2)))))) > 150),
al AS (SELECT mission_id, 1 AS rule, 'error' AS severity, 'no_waypoints' AS code, 0 AS n FROM ms WHERE NOT EXISTS (SELECT 1 FROM waypoints w WHERE w.mission_id = ms.mission_id)
UNION ALL SELECT mission_id, 3, 'error', 'too_many_waypoints', count(*) FROM waypoints GROUP BY mission_id HAVING count(*) > 65535
UNION ALL SELECT mission_id, 4, 'error', 'altitude_below_min', count(*) FROM waypoints WHERE z < 2 GROUP BY mission_id
UNION ALL SELECT mission_id, 5, 'error', 'speed_exceeds_max', count(*) FROM waypoints WHERE speed_ms > 21 GROUP BY mission_id
UNION ALL SELECT DISTINCT mission_id, 6, 'warning', 'gimbal_pitch_clamped', 1 FROM lk WHERE gimbal_pitch_deg < -90 OR gimbal_pitch_deg > 35
UNION ALL SELECT mission_id, 7, 'info', 'gimbal_near_limit', count(*) FROM lk WHERE gimbal_pitch_deg <= -80 GROUP BY mission_id
UNION ALL SELECT mission_id, 8, 'warning', 'photo_interval_too_short', count(*) FROM pi GROUP BY mission_id
UNION ALL SELECT mission_id, 9, 'warning', 'exceeds_flight_time', CAST(floor(a/60) AS BIGINT) FROM ft WHERE a/60/32 > 0.8
UNION ALL SELECT mission_id, 10, 'info', 'near_flight_time_limit', CAST(floor(a/60) AS BIGINT) FROM ft WHERE a/60/32 > 0.65 AND a/60/32 <= 0.8
UNION ALL SELECT mission_id, 11, 'warning', 'too_close_to_surface', 1 FROM sf WHERE r = 1
UNION ALL SELECT mission_id, 12, 'info', 'exclusion_zone_filtered', count(*) FROM zo GROUP BY mission_id
UNION ALL SELECT mission_id, 13, 'warning', 'facades_uncovered', count(*) FROM un GROUP BY mission_id
UNION ALL SELECT mission_id, 19, 'warning', 'near_duplicate', count(*) FROM nd GROUP BY mission_id
UNION ALL SELECT mission_id, 20, 'info', 'heading_misaligned', count(*) FROM lk WHERE gimbal_yaw_deg IS NOT NULL AND {fold180('(heading_deg-gimbal_yaw_deg)')} > 30 GROUP BY mission_id
UNION ALL SELECT mission_id, 21, 'info', 'path_reversal', count(*) FROM rv GROUP BY mission_id)"""


def found(spark, sf_dir):
    view(spark, sf_dir, "zones")
    missions = spark.sql("SELECT DISTINCT s_suppkey % 60 AS mission_id FROM supplier")
    return validate.issues(missions, view(spark, sf_dir, "waypoints"), facades(spark, sf_dir), view(spark, sf_dir, "zones"))


@register("mission_issues", f"{_V} SELECT mission_id, rule, severity, code, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY mission_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule) AS position FROM al")
def mission_issues(spark, sf_dir):
    return validate.ranked(found(spark, sf_dir)).drop("waypoint_indices")


@register("issue_counts", f"{_V} SELECT mission_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, bool_or(severity = 'error') AS blocked FROM al GROUP BY mission_id")
def issue_counts(spark, sf_dir):
    return validate.counts(found(spark, sf_dir))
