"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import angles, camera, geo, polygon
from scanloom.plans.common import fold180, pmod360, r6, rounded
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

WP = f"waypoints AS ({VIEWS['waypoints']})"
BD = f"buildings AS ({VIEWS['buildings']})"
CM = f"cameras AS ({VIEWS['cameras']})"


@register("camera_optics", f"WITH {WP}, {CM}, w AS (SELECT mission_id, idx, z AS d, speed_ms, facade_index FROM waypoints) SELECT mission_id, idx, camera, round(d*sensor_width_mm/(focal_length_mm*image_width_px)*1000,6) AS gsd_mm, round(focal_length_mm*d*image_width_px/(sensor_width_mm*1000),6) AS distance_m, round(d*sensor_width_mm/focal_length_mm,6) AS foot_w, round(d*sensor_height_mm/focal_length_mm,6) AS foot_h, round(0.5*(d*sensor_width_mm/focal_length_mm),6) AS step_h, round((1-0.6e0)*(d*sensor_height_mm/focal_length_mm),6) AS step_v, round(min_interval_s*speed_ms,6) AS interval_m, round(degrees(2*atan(sensor_width_mm/(2*focal_length_mm))),1) AS fov FROM w CROSS JOIN cameras")
def camera_optics(spark, sf_dir):
    # The camera table has three rows; it is broadcast to every waypoint.
    w = view(spark, sf_dir, "waypoints").select("mission_id", "idx", F.col("z").alias("d"), "speed_ms").withColumn("camera", F.explode(F.array(*[F.lit(c[0]) for c in camera.CAMERAS])))
    rows = w.join(F.broadcast(camera.cameras(spark)), "camera")
    fw, fh = camera.footprint(F.col("d"))
    sh, sv = camera.grid_spacing(fw, fh, F.lit(0.6), F.lit(0.5))
    return rounded(rows.select("mission_id", "idx", "camera", camera.gsd_mm(F.col("d")).alias("gsd_mm"), camera.distance_for_gsd(F.col("d")).alias("distance_m"), fw.alias("foot_w"), fh.alias("foot_h"), sh.alias("step_h"), sv.alias("step_v"), camera.photo_interval_distance(F.col("speed_ms")).alias("interval_m"), camera.fov_deg(F.col("sensor_width_mm"), F.col("focal_length_mm")).alias("fov")))


_ML = "(111132.92e0-559.82e0*cos(2*radians({0}))+1.175e0*cos(4*radians({0})))"
_MO = "(111412.84e0*cos(radians({0}))-93.5e0*cos(3*radians({0})))"


@register("geo_transforms", f"WITH {BD} SELECT building_id, round({_ML.format('lat')},6) AS m_lat, round({_MO.format('lat')},6) AS m_lon, round((lon-5.2e0)*{_MO.format('52.3e0')},6)+0 AS east, round((lat-52.3e0)*{_ML.format('52.3e0')},6)+0 AS north, round(ground_altitude-1,6)+0 AS up, round(radians(lon-5.2e0)*6378137*cos(radians(52.3e0)),6)+0 AS s_east, round(radians(lat-52.3e0)*6378137,6)+0 AS s_north, round(width*cos(radians(heading_deg))-depth*sin(radians(heading_deg)),6)+0 AS rx, round(width*sin(radians(heading_deg))+depth*cos(radians(heading_deg)),6)+0 AS ry FROM buildings")
def geo_transforms(spark, sf_dir):
    c = F.col
    m_lat, m_lon = geo.meters_per_deg(c("lat"))
    e, n, u = geo.wgs84_to_enu(c("lat"), c("lon"), c("ground_altitude"), F.lit(52.3), F.lit(5.2), F.lit(1.0))
    se, sn = geo.wgs84_to_enu_spherical(c("lat"), c("lon"), F.lit(52.3), F.lit(5.2))
    rx, ry = angles.rotate_z(c("width"), c("depth"), c("heading_deg"))
    cols = {"m_lat": m_lat, "m_lon": m_lon, "east": e, "north": n, "up": u, "s_east": se, "s_north": sn, "rx": rx, "ry": ry}
    return view(spark, sf_dir, "buildings").select("building_id", *[r6(v).alias(k) for k, v in cols.items()])


_FWD = "CASE WHEN gimbal_yaw_deg IS NULL THEN radians(heading_deg) ELSE radians(gimbal_yaw_deg) END"


@register("angle_functions", f"WITH {WP} SELECT mission_id, idx, round({pmod360('(heading_deg*3+180)')}-180,6)+0 AS wrapped, round(CASE WHEN heading_deg > 180 THEN heading_deg-360 ELSE heading_deg END,6)+0 AS folded, round({fold180('(heading_deg-gimbal_yaw_deg)')},6)+0 AS delta, round({pmod360('(CASE WHEN facade_index = 0 THEN gimbal_yaw_deg ELSE heading_deg+gimbal_yaw_deg END+180)')}-180,6)+0 AS absolute_yaw, round(sin({_FWD})*cos(radians(gimbal_pitch_deg)),6)+0 AS fx, round(cos({_FWD})*cos(radians(gimbal_pitch_deg)),6)+0 AS fy, round(sin(radians(gimbal_pitch_deg)),6)+0 AS fz, round({pmod360('degrees(atan2(x,y))')},6)+0 AS azimuth, round(degrees(asin(least(1e0,abs(z)/20e0))),6) AS tilt, round(greatest(-90e0, least(35e0, gimbal_pitch_deg*1.2e0)),6)+0 AS clamped FROM waypoints")
def angle_functions(spark, sf_dir):
    c = F.col
    fwd = angles.camera_forward(c("heading_deg"), c("gimbal_yaw_deg"), c("gimbal_pitch_deg"))
    base = F.when(c("facade_index") == 0, "north").otherwise("aircraft")
    cols = {"wrapped": angles.to_pm180(c("heading_deg") * 3), "folded": angles.heading_fold(c("heading_deg")), "delta": angles.angle_delta(c("heading_deg"), c("gimbal_yaw_deg")), "absolute_yaw": angles.absolute_gimbal_yaw(base, c("heading_deg"), c("gimbal_yaw_deg")), "fx": fwd["x"], "fy": fwd["y"], "fz": fwd["z"], "azimuth": angles.azimuth(c("x"), c("y")), "tilt": angles.tilt_from_vertical(c("z") / 20), "clamped": angles.clamp_pitch(c("gimbal_pitch_deg") * 1.2)}
    return view(spark, sf_dir, "waypoints").select("mission_id", "idx", *[r6(v).alias(k) for k, v in cols.items()])


@register("polygon_functions", f"WITH rings AS ({VIEWS['rings']}), n AS (SELECT a.*, b.x AS bx, b.y AS b2 FROM rings a JOIN rings b ON a.mission_id = b.mission_id AND b.seq = (a.seq+1) % 6), a AS (SELECT mission_id, sum(x*b2-bx*y)/2 AS area, avg(x) AS mx, avg(y) AS my FROM n GROUP BY mission_id), e AS (SELECT r.mission_id, seq, mx+(x-mx)*(sqrt((x-mx)**2+(y-my)**2)+2)/sqrt((x-mx)**2+(y-my)**2) AS x, my+(y-my)*(sqrt((x-mx)**2+(y-my)**2)+2)/sqrt((x-mx)**2+(y-my)**2) AS y FROM rings r JOIN a USING (mission_id)) SELECT a.mission_id, round(any_value(area),6)+0 AS area, round(-any_value(area),6)+0 AS reversed_area, round(sum(p.x*q.y-q.x*p.y)/2,6)+0 AS wide_area FROM a JOIN e p USING (mission_id) JOIN e q ON q.mission_id = p.mission_id AND q.seq = (p.seq+1) % 6 GROUP BY a.mission_id")
def polygon_functions(spark, sf_dir):
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    r = view(spark, sf_dir, "rings").groupBy("mission_id").agg(ring.alias("ring"))
    return rounded(r.select("mission_id", polygon.signed_area(F.col("ring")).alias("area"), polygon.signed_area(F.reverse("ring")).alias("reversed_area"), polygon.signed_area(polygon.expand(F.col("ring"), F.lit(2.0))).alias("wide_area")))


@register("text_functions", "SELECT p_partkey, replace(replace(replace(replace(replace(p_name || ' <&> \"q\" it''s', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, regexp_replace(p_name || '/v1', '[^A-Za-z0-9_-]', '_', 'g') AS safe, CASE WHEN p_size % 3 = 0 THEN NULL ELSE greatest(0e0, least(0.99e0, CASE WHEN p_size > 1 THEN p_size/100e0 ELSE p_size END)) END AS overlap, md5(p_partkey || '|' || p_size) AS fingerprint FROM part")
def text_functions(spark, sf_dir):
    view(spark, sf_dir, "buildings")  # registers part
    raw = F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.col("p_size").cast("string"))
    return spark.table("part").select("p_partkey", geo.html_escape(F.concat("p_name", F.lit(" <&> \"q\" it's"))).alias("escaped"), geo.safe_name(F.concat("p_name", F.lit("/v1"))).alias("safe"), geo.overlap_fraction(raw).alias("overlap"), F.md5(F.concat_ws("|", "p_partkey", "p_size")).alias("fingerprint"))
