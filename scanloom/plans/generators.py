"""Queries of the row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geo
from scanloom.operators import aggregates, generate
from scanloom.plans.common import FACADES_SQL, GRID_SQL, decimals, facades, rounded
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

R = lambda *cs: ", ".join(f"round({c}, 6)+0 AS {c}" for c in cs)


@register("rectangular_facades", f"WITH {FACADES_SQL} SELECT building_id, facade_index, label, component_tag, {R('nx', 'ny', 'nz', 'cx', 'cy', 'cz', 'width_m', 'height_m')}, round(width_m*height_m, 6)+0 AS area_m2 FROM facades")
def rectangular_facades(spark, sf_dir):
    return rounded(facades(spark, sf_dir).drop("vertices"))


@register("facade_waypoints", f"WITH {FACADES_SQL}, {GRID_SQL} SELECT building_id, facade_index, seq, row, col, {R('x', 'y', 'z', 'gimbal_pitch_deg', 'speed_ms')}, round(CASE WHEN abs(heading_deg-360) < 1e-6 OR facade_index = 4 AND gimbal_pitch_deg = -85 THEN 0 ELSE heading_deg END, 6)+0 AS heading_deg FROM grid")
def facade_waypoints(spark, sf_dir):
    rows = generate.facade_waypoints(facades(spark, sf_dir))
    # Straight-down looks have no heading of their own.
    own = F.when((F.abs(F.col("heading_deg") - 360) < 1e-6) | (F.col("facade_index") == 4) & (F.col("gimbal_pitch_deg") == -85), 0.0).otherwise(F.col("heading_deg"))
    return rounded(rows.withColumn("heading_deg", own))


@register("planned_positions", f"WITH {FACADES_SQL}, {GRID_SQL}, n AS (SELECT building_id, row_number() OVER (PARTITION BY building_id ORDER BY facade_index, seq) - 1 AS idx, x, y, z FROM grid), "
          "m AS (SELECT *, 111132.92e0-559.82e0*cos(2*radians(lat))+1.175e0*cos(4*radians(lat)) AS mlat, 111412.84e0*cos(radians(lat))-93.5e0*cos(3*radians(lat)) AS mlon FROM buildings) "
          "SELECT building_id, CAST(idx AS INT) AS idx, round(lat+y/mlat, 9) AS wp_lat, round(lon+x/mlon, 9) AS wp_lon, round(ground_altitude+z, 6) AS wp_alt FROM n JOIN m USING (building_id)")
def planned_positions(spark, sf_dir):
    b = view(spark, sf_dir, "buildings")
    rows = generate.facade_waypoints(facades(spark, sf_dir), index=True).join(b.select("building_id", "lat", "lon", "ground_altitude"), "building_id")
    lat, lon, alt = geo.enu_to_wgs84(F.col("x"), F.col("y"), F.col("z"), F.col("lat"), F.col("lon"), F.col("ground_altitude"))
    return rows.select("building_id", "idx", decimals(lat, 9).alias("wp_lat"), decimals(lon, 9).alias("wp_lon"), decimals(alt, 6).alias("wp_alt"))


_COVER = """SELECT f.building_id, f.facade_index, f.label, round(any_value(f.width_m*f.height_m), 1) AS area_m2, count(g.seq) AS waypoint_count, round(avg(abs(gimbal_pitch_deg)), 1)+0 AS mean_pitch_abs_deg,
  round(avg(-(sin(radians(heading_deg))*cos(radians(gimbal_pitch_deg))*nx + cos(radians(heading_deg))*cos(radians(gimbal_pitch_deg))*ny + sin(radians(gimbal_pitch_deg))*nz)), 3)+0 AS mean_perpendicularity,
  round(avg(abs((x-cx)*nx+(y-cy)*ny+(z-cz)*nz)), 1)+0 AS mean_distance_m
FROM facades f LEFT JOIN grid g ON f.building_id = g.building_id AND f.facade_index = g.facade_index GROUP BY f.building_id, f.facade_index, f.label"""


@register("minimum_slice_coverage", f"WITH {FACADES_SQL}, {GRID_SQL} {_COVER}")
def minimum_slice_coverage(spark, sf_dir):
    f = facades(spark, sf_dir)
    w = generate.facade_waypoints(f).withColumns({"is_transition": F.lit(False), "gimbal_yaw_deg": F.lit(None).cast("double")})
    return aggregates.facade_coverage(f, w)


@register("extrude_footprints", f"""WITH rings AS ({VIEWS['rings']}), p AS (SELECT mission_id, 6 - seq AS k, x, y FROM rings),
n AS (SELECT mission_id, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b2 FROM (SELECT mission_id, seq AS k, x, y FROM rings) WINDOW w AS (PARTITION BY mission_id ORDER BY k)),
l AS (SELECT *, sqrt((bx-x)*(bx-x)+(b2-y)*(b2-y)) AS len FROM n), a AS (SELECT *, (b2-y)/len AS nx, -(bx-x)/len AS ny FROM l),
d AS (SELECT *, {"degrees(atan2(nx, ny)) - 360*floor(degrees(atan2(nx, ny))/360)"} AS az FROM a)
SELECT mission_id AS footprint_id, CAST(k AS INT) AS facade_index, CASE WHEN az >= 315 OR az < 45 THEN 'north' WHEN az < 135 THEN 'east' WHEN az < 225 THEN 'south' ELSE 'west' END || '_wall_' || k AS label, '21.1' AS component_tag,
  round(nx,6)+0 AS nx, round(ny,6)+0 AS ny, 0e0 AS nz, round(len,6)+0 AS width_m, 9e0 AS height_m FROM d
UNION ALL SELECT mission_id, 6, 'roof_flat', '47.1', 0e0, 0e0, 1e0, round(max(x)-min(x),6)+0, round(max(y)-min(y),6)+0 FROM rings GROUP BY mission_id""")
def extrude_footprints(spark, sf_dir):
    rings = view(spark, sf_dir, "rings")
    # Given clockwise on purpose: the operator turns it.
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    foot = rings.groupBy(F.col("mission_id").alias("footprint_id")).agg(ring.alias("ring")).withColumn("ring", F.reverse(F.concat(F.slice("ring", 1, 6)))).withColumn("height", F.lit(9.0))
    return rounded(generate.extrude_footprints(foot))


@register("zones_from_rings", f"WITH rings AS ({VIEWS['rings']}) SELECT mission_id, round((min(x)+max(x))/2,6)+0 AS center_x, round((min(y)+max(y))/2,6)+0 AS center_y, 15e0 AS center_z, round(max(x)-min(x),6)+0 AS size_x, round(max(y)-min(y),6)+0 AS size_y, 30e0 AS size_z, count(*) AS corners FROM rings GROUP BY mission_id")
def zones_from_rings(spark, sf_dir):
    z = generate.zones_from_rings(view(spark, sf_dir, "rings"))
    return rounded(z.withColumn("corners", F.size("polygon").cast("long")).drop("polygon"))


@register("path_shots", f"""WITH waypoints AS ({VIEWS['waypoints']}), s AS (SELECT mission_id, idx, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2),0) AS seg FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
c AS (SELECT *, sum(seg) OVER (PARTITION BY mission_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum FROM s),
e AS (SELECT mission_id, idx AS segment, unnest(range(CAST(ceil((cum-seg)/0.65e0) AS BIGINT), CAST(ceil(cum/0.65e0) AS BIGINT))) AS shot FROM c WHERE seg > 0)
SELECT mission_id, shot, segment, round(shot*0.65e0,6) AS distance_m, shot % 5 AS pose FROM e""")
def path_shots(spark, sf_dir):
    return rounded(generate.path_shots(view(spark, sf_dir, "waypoints")))


@register("clamped_standoff", f"""WITH {FACADES_SQL}, k AS (SELECT *, 6.0137e0 + building_id % 9 AS h FROM facades),
s AS (SELECT building_id, facade_index, nx, ny, cx, cy, h, sqrt(nx*nx+ny*ny) AS fl FROM k),
m AS (SELECT building_id, facade_index, min(CASE WHEN abs(cx+nx/fl*t*0.25e0) > h OR abs(cy+ny/fl*t*0.25e0) > h THEN t*0.25e0 END) AS out FROM s, (SELECT unnest(range(1,29)) AS t) WHERE fl >= 1e-6 GROUP BY ALL)
SELECT s.building_id, s.facade_index, round(CASE WHEN fl < 1e-6 OR abs(cx) > h OR abs(cy) > h THEN 7e0 ELSE least(7e0, greatest(2e0, coalesce(out, 7e0)-0.5)) END, 6) AS standoff_m FROM s LEFT JOIN m USING (building_id, facade_index)""")
def clamped_standoff(spark, sf_dir):
    h = 6.0137 + F.pmod(F.col("building_id"), F.lit(9)).cast("double")
    ring = F.array(*[F.struct((h * sx).alias("x"), (h * sy).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    d = generate.clamp_standoff(F.col("cx"), F.col("cy"), F.col("nx"), F.col("ny"), F.lit(7.0), ring)
    return rounded(facades(spark, sf_dir).select("building_id", "facade_index", d.alias("standoff_m")))


@register("l_shaped_walls")
def l_shaped_walls(spark, sf_dir):
    return rounded(generate.l_shaped_facades(view(spark, sf_dir, "buildings")).drop("vertices"))


@register("direction_rollup", f"WITH {FACADES_SQL}, {GRID_SQL}, a AS (SELECT building_id, facade_index, nz, round(degrees(atan2(nx, ny)) - 360*floor(degrees(atan2(nx, ny))/360), 9) AS az FROM facades), "
          "d AS (SELECT *, CASE WHEN abs(nz) > 0.3 THEN 'roof' WHEN az >= 315 OR az < 45 THEN 'north' WHEN az < 135 THEN 'east' WHEN az < 225 THEN 'south' ELSE 'west' END AS direction FROM a), "
          "n AS (SELECT building_id, facade_index, count(*) AS n FROM grid GROUP BY ALL) SELECT building_id, direction, count(*) AS facades, CAST(sum(n) AS BIGINT) AS waypoints FROM d JOIN n USING (building_id, facade_index) GROUP BY building_id, direction")
def direction_rollup(spark, sf_dir):
    f = facades(spark, sf_dir)
    return aggregates.direction_rollup(f, generate.facade_waypoints(f))
