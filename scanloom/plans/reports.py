"""Queries of the fleet reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import reports
from scanloom.plans.common import FACADES_SQL, facades, fold180, rounded
from scanloom.plans.spatial import _ENDS
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

WP, PT = (f"{n} AS ({VIEWS[n]})" for n in ("waypoints", "points"))


def wps(spark, sf_dir):
    return view(spark, sf_dir, "waypoints")


@register("mission_seeds", f"WITH {FACADES_SQL}, {WP}, c AS (SELECT w.mission_id, w.idx, f.facade_index, abs((x-cx)*nx+(y-cy)*ny+(z-cz)*nz) AS d, row_number() OVER (PARTITION BY w.mission_id, w.idx ORDER BY sqrt((x-cx)**2+(y-cy)**2), f.facade_index) AS r FROM waypoints w JOIN facades f USING (building_id) WHERE NOT is_transition), k AS (SELECT *, count(*) OVER (PARTITION BY mission_id) AS n, row_number() OVER (PARTITION BY mission_id ORDER BY d, idx) AS rn FROM c WHERE r = 1) SELECT mission_id, any_value(n) AS waypoints, round(greatest(1e0, least(15e0, median(d))),6) AS standoff_m FROM k WHERE rn <= greatest(1, floor(n*0.9)) GROUP BY mission_id")
def mission_seeds(spark, sf_dir):
    return rounded(reports.mission_seeds(wps(spark, sf_dir), facades(spark, sf_dir)))


@register("aim_quality_sweep", f"WITH {FACADES_SQL}, {WP}, c AS (SELECT w.mission_id, w.idx, sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2) AS d, CASE WHEN label LIKE '%_wall' THEN 0.5e0 ELSE 1e0 END AS m FROM waypoints w JOIN facades f USING (building_id) WHERE NOT is_transition AND (x-cx)*nx+(y-cy)*ny+(z-cz)*nz > 0), b AS (SELECT reach, mission_id, idx, min(d*m) AS w FROM c, (SELECT unnest([20e0, 40e0, 60e0]) AS reach) WHERE d <= reach GROUP BY ALL), n AS (SELECT mission_id, count(*) AS n FROM waypoints WHERE NOT is_transition GROUP BY mission_id) SELECT reach, mission_id, count(*) AS aimed, round(count(*)/any_value(n)*100,6) AS aimed_pct, round(avg(w),6) AS mean_weight FROM b JOIN n USING (mission_id) GROUP BY reach, mission_id")
def aim_quality_sweep(spark, sf_dir):
    return rounded(reports.aim_quality(wps(spark, sf_dir), facades(spark, sf_dir)))


_FWD = "CASE WHEN gimbal_yaw_deg IS NULL THEN radians(heading_deg) ELSE radians(gimbal_yaw_deg) END"


@register("camera_cone_targets", f"WITH {WP}, {PT}, t AS (SELECT cloud_id, x AS px, y AS py, z AS pz, point_id FROM points), c AS (SELECT mission_id, idx, point_id, sqrt((px-x)**2+(py-y)**2+(pz-z)**2) AS d, ((px-x)*sin({_FWD})*cos(radians(gimbal_pitch_deg))+(py-y)*cos({_FWD})*cos(radians(gimbal_pitch_deg))+(pz-z)*sin(radians(gimbal_pitch_deg)))/sqrt((px-x)**2+(py-y)**2+(pz-z)**2) AS c FROM waypoints w JOIN t ON t.cloud_id = w.building_id WHERE NOT is_transition AND (px-x)**2+(py-y)**2+(pz-z)**2 > 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY mission_id, idx ORDER BY round(c-0.001e0*d/60,9) DESC, point_id) AS n FROM c WHERE d <= 60 AND c >= cos(radians(45))) SELECT mission_id, idx, point_id, round(degrees(acos(greatest(-1e0,least(1e0,c)))),4)+0 AS off_deg FROM r WHERE n = 1")
def camera_cone_targets(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumnRenamed("cloud_id", "building_id")
    return reports.cone_targets(wps(spark, sf_dir), p).withColumn("off_deg", F.round("off_deg", 4) + 0.0)


_VERSIONS = "SELECT o_orderkey AS version_id, o_custkey % 200 AS building_id, CASE o_orderkey % 3 WHEN 0 THEN 'dji' WHEN 1 THEN 'dji_pinned' ELSE 'inspection' END AS mode, o_orderdate AS ts, o_totalprice AS cost FROM orders"


@register("snapshot_upsert", f"WITH v AS ({_VERSIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY building_id, mode ORDER BY ts DESC, version_id DESC) AS n FROM v) SELECT version_id, building_id, mode, cost FROM r WHERE n = 1")
def snapshot_upsert(spark, sf_dir):
    wps(spark, sf_dir)  # registers orders
    return reports.latest(spark.sql(_VERSIONS), ["building_id", "mode"], "ts", "version_id").drop("ts")


@register("new_archives", f"WITH v AS ({_VERSIONS}) SELECT DISTINCT version_id, md5(building_id || '|' || mode) AS fingerprint FROM v a WHERE version_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.version_id % 4 = 0 AND b.version_id < 9000 AND md5(b.building_id || '|' || b.mode) = md5(a.building_id || '|' || a.mode))")
def new_archives(spark, sf_dir):
    wps(spark, sf_dir)
    v = spark.sql(_VERSIONS).select("version_id", F.md5(F.concat_ws("|", "building_id", "mode")).alias("fingerprint"))
    return reports.unseen(v.where("version_id % 4 <> 0"), v.where("version_id % 4 = 0 and version_id < 9000"), "fingerprint").select("version_id", "fingerprint")


@register("worst_turns", f"WITH {WP}, d AS (SELECT mission_id, idx, heading_deg - lag(heading_deg) OVER (PARTITION BY mission_id ORDER BY idx) AS h FROM waypoints), r AS (SELECT mission_id, idx, {fold180('h')} AS yaw_jump FROM d WHERE h IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY yaw_jump DESC, idx) AS rank FROM r) SELECT mission_id, idx, round(yaw_jump,6)+0 AS yaw_jump, rank FROM k WHERE rank <= 10")
def worst_turns(spark, sf_dir):
    return rounded(reports.worst_turns(wps(spark, sf_dir)).select("mission_id", "idx", "yaw_jump", "rank"))


@register("order_benchmark", f"""WITH RECURSIVE {_ENDS}, s AS (SELECT mission_id, g, l, row_number() OVER (PARTITION BY mission_id ORDER BY (f.x+l.x)**2+(f.y+l.y)**2+(f.z+l.z)**2, g) AS n FROM g),
t AS (SELECT mission_id, 0 AS position, g, l, [g] AS seen FROM s WHERE n = 1 UNION ALL
  SELECT mission_id, position, g, l, seen FROM (SELECT t.mission_id, t.position + 1 AS position, g.g, g.l, list_append(t.seen, g.g) AS seen,
    row_number() OVER (PARTITION BY t.mission_id ORDER BY least(sqrt((t.l.x-g.f.x)**2+(t.l.y-g.f.y)**2+(t.l.z-g.f.z)**2), sqrt((t.l.x-g.l.x)**2+(t.l.y-g.l.y)**2+(t.l.z-g.l.z)**2)), g.g) AS n
    FROM t JOIN g ON g.mission_id = t.mission_id AND NOT list_contains(t.seen, g.g)) WHERE n = 1),
o AS (SELECT mission_id, 'nearest_neighbour' AS method, position, g FROM t UNION ALL SELECT mission_id, 'faces', row_number() OVER (PARTITION BY mission_id ORDER BY g), g FROM g),
l AS (SELECT o.mission_id, method, sqrt((g.f.x-lag(g.l.x) OVER w)**2+(g.f.y-lag(g.l.y) OVER w)**2+(g.f.z-lag(g.l.z) OVER w)**2) AS d FROM o JOIN g ON g.mission_id = o.mission_id AND g.g = o.g WINDOW w AS (PARTITION BY o.mission_id, method ORDER BY position)),
m AS (SELECT mission_id, method, coalesce(sum(d), 0) AS transit FROM l GROUP BY ALL)
SELECT m.mission_id, m.method, round(m.transit,6)+0 AS transit_m, round(b.transit-m.transit,6)+0 AS saved_m FROM m JOIN m b ON b.mission_id = m.mission_id AND b.method = 'faces'""")
def order_benchmark(spark, sf_dir):
    return rounded(reports.order_benchmark(wps(spark, sf_dir)))


@register("prepare_scan", f"WITH {PT}, q AS (SELECT cloud_id, quantile_cont(z,0.05) AS q, max(z) AS top FROM points GROUP BY cloud_id), k AS (SELECT cloud_id, x, y, z, CAST(floor(x/0.1e0) AS BIGINT) AS ix, CAST(floor(y/0.1e0) AS BIGINT) AS iy, CAST(floor(z/0.1e0) AS BIGINT) AS iz FROM points JOIN q USING (cloud_id) WHERE z > q + 1 OR top <= q + 1) SELECT cloud_id, ix, iy, iz, round(avg(x),6)+0 AS x, round(avg(y),6)+0 AS y, round(avg(z),6)+0 AS z, count(*) AS n FROM k GROUP BY cloud_id, ix, iy, iz")
def prepare_scan(spark, sf_dir):
    return rounded(reports.prepare_scan(view(spark, sf_dir, "points")))


@register("frustum_corners", f"WITH {WP}, v AS (SELECT *, sin({_FWD})*cos(radians(gimbal_pitch_deg)) AS vx, cos({_FWD})*cos(radians(gimbal_pitch_deg)) AS vy, sin(radians(gimbal_pitch_deg)) AS vz, cos({_FWD}) AS rx, -sin({_FWD}) AS ry, tan(radians(42e0)) AS h FROM waypoints), u AS (SELECT *, ry*vz AS ux, -rx*vz AS uy, rx*vy-ry*vx AS uz FROM v) SELECT mission_id, idx, round(x+vx+h*rx+0.75*h*ux,6)+0 AS x3, round(y+vy+h*ry+0.75*h*uy,6)+0 AS y3, round(z+vz+0.75*h*uz,6)+0 AS z3 FROM u")
def frustum_corners(spark, sf_dir):
    f = reports.frustum(wps(spark, sf_dir))
    return rounded(f.select("mission_id", "idx", *[F.col("corners")[3][a].alias(f"{a}3") for a in "xyz"]))


@register("version_diff", f"WITH {FACADES_SQL}, a AS (SELECT building_id, count(*) AS faces_a, round(sum(width_m*height_m),2) AS area_a FROM facades GROUP BY building_id), b AS (SELECT building_id, count(*) AS faces_b, round(sum(width_m*height_m),2) AS area_b FROM facades WHERE (building_id + facade_index) % 4 <> 0 GROUP BY building_id) SELECT building_id, faces_a, area_a, coalesce(faces_b,0) AS faces_b, coalesce(area_b,0) AS area_b, coalesce(faces_b,0)-faces_a AS faces_change, round(coalesce(area_b,0)-area_a,2)+0 AS area_change FROM a LEFT JOIN b USING (building_id)")
def version_diff(spark, sf_dir):
    f = facades(spark, sf_dir)
    d = reports.version_diff(f, f.where("(building_id + facade_index) % 4 <> 0"))
    return d.withColumn("area_change", F.col("area_change") + 0.0)


@register("capped_sample")
def capped_sample(spark, sf_dir):
    return rounded(reports.sample_capped(view(spark, sf_dir, "points"), 2000))


@register("viewer_payload")
def viewer_payload(spark, sf_dir):
    return reports.viewer_payload(facades(spark, sf_dir))
