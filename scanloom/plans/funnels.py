"""Queries of funnels, gates and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import aggregates, clouds, filters, funnels, joins, meshes
from scanloom.plans.common import FACADES_SQL, facades, rounded
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

WP, PT, RG, BD = (f"{n} AS ({VIEWS[n]})" for n in ("waypoints", "points", "rings", "buildings"))

_REGIONS = f"{BD}, g AS (SELECT building_id AS mesh_id, unnest([{{'k':0,'a':width*height,'z':height/2,'n':0e0}},{{'k':2,'a':depth*height,'z':height/2,'n':0e0}},{{'k':4,'a':width*height,'z':height/2,'n':0e0}},{{'k':6,'a':depth*height,'z':height/2,'n':0e0}},{{'k':8,'a':width*depth,'z':height,'n':1e0}},{{'k':10,'a':width*depth,'z':0e0,'n':-1e0}}]) AS u, building_id FROM buildings), r AS (SELECT mesh_id, u.k AS k, u.a AS area_m2, u.z AS cz, u.n AS nz, ((building_id * 7 + u.k * 3) % 10) / 10e0 AS visible FROM g)"


def regions(spark, sf_dir):
    """The six planar regions of every box, with a made-up visible share."""
    r = meshes.with_normals(meshes.box_meshes(view(spark, sf_dir, "buildings"))).withColumn("k", F.col("fid") - F.col("fid") % 2)
    g = r.groupBy("mesh_id", "k").agg(F.sum("area").alias("area_m2"), F.avg("fnz").alias("nz"), F.avg(F.expr("(az+bz+cz)/3")).alias("cz"))
    return g.withColumn("visible", F.pmod(F.col("mesh_id") * 7 + F.col("k") * 3, F.lit(10)) / 10.0)


_WHY = "CASE WHEN area_m2 < 1 THEN 'area' WHEN nz < -0.3 THEN 'normal' WHEN cz < 0.3 THEN 'ground' WHEN visible < 0.3 THEN 'occlusion' END"


@register("region_rejects", f"WITH {_REGIONS} SELECT mesh_id, CAST(k AS INT) AS k, round(area_m2,6) AS area_m2, {_WHY} AS reject_reason FROM r")
def region_rejects(spark, sf_dir):
    return rounded(filters.reject_reason(regions(spark, sf_dir)).select("mesh_id", "k", "area_m2", "reject_reason"))


@register("extraction_funnel", f"WITH {_REGIONS}, w AS (SELECT *, {_WHY} AS why FROM r) SELECT mesh_id, count(*) AS regions, count(*) FILTER (why = 'area') AS lost_area, count(*) FILTER (why = 'normal') AS lost_normal, count(*) FILTER (why = 'ground') AS lost_ground, count(*) FILTER (why = 'occlusion') AS lost_occlusion, count(*) FILTER (why IS NULL AND abs(nz) < 0.3) AS walls, count(*) FILTER (why IS NULL AND nz >= 0.3) AS roofs FROM w GROUP BY mesh_id")
def extraction_funnel(spark, sf_dir):
    return funnels.extraction_funnel(filters.reject_reason(regions(spark, sf_dir)))


@register("generation_funnel", f"WITH {WP}, a AS (SELECT * FROM waypoints WHERE z >= 2), b AS (SELECT * FROM a WHERE speed_ms <= 15), c AS (SELECT * FROM b w WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.mission_id = w.mission_id AND w.facade_index > o.facade_index AND (o.x-w.x)**2+(o.y-w.y)**2+(o.z-w.z)**2 <= 6.6564e0 AND abs(o.gimbal_pitch_deg-w.gimbal_pitch_deg) <= 20 AND CASE WHEN abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) > 180 THEN 360-abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) ELSE abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) END <= 20)) SELECT mission_id, 0 AS stage_no, 'planned' AS stage, count(*) AS rows FROM waypoints GROUP BY ALL UNION ALL SELECT mission_id, 1, 'altitude', count(*) FROM a GROUP BY ALL UNION ALL SELECT mission_id, 2, 'speed', count(*) FROM b GROUP BY ALL UNION ALL SELECT mission_id, 3, 'deduplicated', count(*) FROM c GROUP BY ALL")
def generation_funnel(spark, sf_dir):
    w = view(spark, sf_dir, "waypoints")
    a = w.where("z >= 2")
    b = a.where("speed_ms <= 15")
    return funnels.funnel([("planned", w), ("altitude", a), ("speed", b), ("deduplicated", joins.drop_cross_facade_duplicates(b, radius=2.58))], "mission_id")


@register("weighted_mean_normal", f"WITH {FACADES_SQL}, s AS (SELECT building_id, sum(nx*width_m*height_m) AS sx, sum(ny*width_m*height_m) AS sy, sum(nz*width_m*height_m) AS sz FROM facades GROUP BY building_id) SELECT building_id, round(sx/sqrt(sx*sx+sy*sy+sz*sz),6)+0 AS nx, round(sy/sqrt(sx*sx+sy*sy+sz*sz),6)+0 AS ny, round(sz/sqrt(sx*sx+sy*sy+sz*sz),6)+0 AS nz FROM s WHERE sqrt(sx*sx+sy*sy+sz*sz) >= 1e-9")
def weighted_mean_normal(spark, sf_dir):
    return rounded(funnels.weighted_mean_normal(facades(spark, sf_dir), "building_id", "area_m2"))


@register("archive_bounds", f"WITH {RG}, {PT}, r AS (SELECT mission_id, max(x)-min(x) AS w, max(y)-min(y) AS d FROM rings GROUP BY mission_id), c AS (SELECT cloud_id AS mission_id, max(z)-min(z) AS h FROM points GROUP BY cloud_id) SELECT mission_id, round(coalesce(w,0),6)+0 AS width_m, round(coalesce(d,0),6)+0 AS depth_m, round(coalesce(h,0),6)+0 AS height_m FROM r FULL JOIN c USING (mission_id)")
def archive_bounds(spark, sf_dir):
    return rounded(funnels.archive_bounds(view(spark, sf_dir, "rings"), view(spark, sf_dir, "points")))


@register("footprint_rings", f"WITH {FACADES_SQL} SELECT building_id, 5 AS corners, round(width*depth,4)+0 AS area FROM buildings")
def footprint_rings(spark, sf_dir):
    from scanloom.functions import polygon

    r = funnels.footprint_rings(facades(spark, sf_dir))
    return r.select("building_id", F.size("ring").alias("corners"), (F.round(polygon.signed_area(F.slice("ring", 1, 4)), 4) + 0.0).alias("area"))


@register("plane_gates", f"WITH {PT}, g AS (SELECT cloud_id, plane_id, count(*) AS points, (CASE WHEN plane_id IN (1,3) THEN max(y)-min(y) ELSE max(x)-min(x) END) AS width_m, (CASE WHEN plane_id = 4 THEN max(y)-min(y) ELSE max(z)-min(z) END) AS height_m, CASE WHEN plane_id = 4 THEN 1e0 ELSE 0e0 END AS nz FROM points GROUP BY cloud_id, plane_id), k AS (SELECT * FROM g WHERE points/(width_m*height_m) >= 25 AND least(width_m,height_m) >= 0.5), l AS (SELECT *, CASE WHEN nz = 1 THEN 'roof' ELSE 'wall' END AS kind FROM k) SELECT cloud_id, plane_id, points, kind, kind || '_' || (row_number() OVER (PARTITION BY cloud_id, kind ORDER BY plane_id) - 1) AS label FROM l")
def plane_gates(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    side, top = F.col("plane_id").isin(1, 3), F.col("plane_id") == 4
    span = lambda a: F.max(a) - F.min(a)
    g = p.groupBy("cloud_id", "plane_id").agg(F.count("*").alias("points"), span("x").alias("dx"), span("y").alias("dy"), span("z").alias("dz"))
    g = g.select("cloud_id", "plane_id", "points", F.when(side, F.col("dy")).otherwise(F.col("dx")).alias("width_m"), F.when(top, F.col("dy")).otherwise(F.col("dz")).alias("height_m"), F.when(top, 1.0).otherwise(0.0).alias("nz")).withColumn("area_m2", F.col("width_m") * F.col("height_m"))
    return filters.size_gate(filters.density_gate(g)).select("cloud_id", "plane_id", "points", "kind", "label")


@register("photographable_samples", f"WITH {PT}, s AS (SELECT cloud_id, point_id, z, CASE WHEN plane_id = 4 THEN 1e0 ELSE ((point_id % 9) - 4) / 8e0 END AS nz FROM points) SELECT cloud_id, point_id FROM s WHERE nz >= -0.3 AND z >= 0.3 AND z + nz*3 >= 2")
def photographable_samples(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumn("nz", F.when(F.col("plane_id") == 4, 1.0).otherwise((F.col("point_id") % 9 - 4) / 8.0))
    return filters.photographable(p, 3.0).select("cloud_id", "point_id")


@register("mission_documents")
def mission_documents(spark, sf_dir):
    w = view(spark, sf_dir, "waypoints")
    return funnels.mission_json(aggregates.mission_summary(w), aggregates.gimbal_stats(w))


@register("mesh_adjacency", f"WITH {BD} SELECT building_id AS mesh_id, unnest([0,2,4,6,8,10]) AS fa, unnest([1,3,5,7,9,11]) AS fb FROM buildings")
def mesh_adjacency(spark, sf_dir):
    return meshes.adjacent_faces(meshes.box_meshes(view(spark, sf_dir, "buildings")))


@register("cloud_look_hits")
def cloud_look_hits(spark, sf_dir):
    """Looks from inspection rows of the four buildings with clouds to the middle of the cloud, that meet it."""
    p = view(spark, sf_dir, "points").withColumnRenamed("cloud_id", "building_id")
    w = view(spark, sf_dir, "waypoints").where("not is_transition and building_id < 4")
    looks = w.select("building_id", F.col("idx").alias("id"), "x", "y", "z", F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(2.0).alias("tz"))
    return joins.ray_hits(looks, clouds.voxel_downsample(p.withColumnRenamed("building_id", "cloud_id"), 0.1).withColumnRenamed("cloud_id", "building_id"), "building_id", more_than=2)
