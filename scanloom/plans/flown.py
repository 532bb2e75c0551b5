"""Queries of templates, flown routes, filter findings and aim verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import filters, meshes, reports, validate
from scanloom.plans import meshes as mesh_plans
from scanloom.plans import reports as report_plans
from scanloom.plans import spatial
from scanloom.plans.common import FACADES_SQL, facades, fold180, pmod360, rounded
from scanloom.registry import register, twin
from scanloom.sources import missions, templates
from scanloom.sources.fixtures import VIEWS, view

WP, RG = (f"{n} AS ({VIEWS[n]})" for n in ("waypoints", "rings"))
_M = lambda lat: f"111132.92e0-559.82e0*cos(2*radians({lat}))+1.175e0*cos(4*radians({lat}))"
_K = lambda lat: f"111412.84e0*cos(radians({lat}))-93.5e0*cos(3*radians({lat}))"


def _capture_xml(w):
    """Routes as capture flights write them: heading and gimbal stand in the placemark, the yaw base once before, an area beside the rows, no actions."""
    n = lambda c: F.format_string("%.8f", c)
    tag = lambda name, *inner: F.concat(F.lit(f"<wpml:{name}>"), *inner, F.lit(f"</wpml:{name}>"))
    place = F.concat(
        F.lit("<Placemark>\n  <Point><coordinates>\n    "), n(F.col("lon")), F.lit(","), n(F.col("lat")), F.lit("\n  </coordinates></Point>"), tag("index", F.col("idx").cast("string")), tag("executeHeight", n(F.col("alt"))), tag("waypointSpeed", n(F.col("speed_ms"))),
        tag("waypointHeadingParam", tag("waypointHeadingMode", F.lit("followWayline")), tag("waypointHeadingAngle", n(F.col("heading_deg")))),
        tag("waypointGimbalHeadingParam", tag("waypointGimbalHeadingMode", F.lit("fixed")), tag("waypointGimbalPitchAngle", n(F.col("gimbal_pitch_deg"))), tag("waypointGimbalYawAngle", n(F.coalesce("gimbal_yaw_deg", F.lit(0.0))))), F.lit("</Placemark>"),
    )
    g = w.groupBy("mission_id", missions.part_of(F.col("idx"), missions.PART_ROWS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", place.alias("place")))).alias("p"))
    start = F.when(F.col("mission_id") % 2 == 0, "<wpml:startActionGroup><wpml:action><wpml:actionActuatorFuncParam><wpml:gimbalHeadingYawBase> north </wpml:gimbalHeadingYawBase></wpml:actionActuatorFuncParam></wpml:action></wpml:startActionGroup>").otherwise("")
    area = "<Placemark><Point><coordinates>\n5.0,52.0,1\n5.1,52.0,1\n5.1,52.1,1\n</coordinates></Point></Placemark>"
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<kml xmlns="k" xmlns:wpml="w"><Document><Folder>'), start, F.lit(area), F.array_join(F.transform("p", lambda x: x["place"]), "\n"), F.lit("</Folder></Document></kml>"))
    return g.select("mission_id", "part", xml.alias("xml"))


def _members(spark, sf_dir):
    """Members of archives built from the waypoints: every third mission as a capture flight, the others as exported; every second
    mission has a take-off point, every fifth a scan description, long missions are several files, and in the first of them rows 10 to 19 two rosettes, of which the first counts."""
    w = view(spark, sf_dir, "waypoints").withColumns({"lat": 52 + F.col("y") / 10_000, "lon": 5 + F.col("x") / 10_000, "alt": F.col("z")})
    pose = lambda pitch, k: f"<wpml:smartObliquePoint><wpml:smartObliqueEulerPitch>{pitch}</wpml:smartObliqueEulerPitch><wpml:smartObliqueEulerYaw>{30 * k}</wpml:smartObliqueEulerYaw></wpml:smartObliquePoint>"
    group = lambda a, b, poses: f"<wpml:actionGroup><wpml:actionGroupStartIndex>{a}</wpml:actionGroupStartIndex><wpml:actionGroupEndIndex>{b}</wpml:actionGroupEndIndex><wpml:action><wpml:actionActuatorFunc>startSmartOblique</wpml:actionActuatorFunc><wpml:actionActuatorFuncParam>{poses}</wpml:actionActuatorFuncParam></wpml:action></wpml:actionGroup>"
    groups = group(10, 19, "".join(pose(-45, k) for k in range(5))) + group(0, 19, pose(-90, 0)).replace("<wpml:actionGroupStartIndex>0<", "<wpml:actionGroupStartIndex>12<")
    flown = _capture_xml(w.where("mission_id % 3 = 1")).unionByName(missions.waylines_xml(w.where("mission_id % 3 <> 1"), part_rows=missions.PART_ROWS).drop("n"))
    routes = flown.select(F.col("mission_id").alias("archive_id"), F.lit("waylines").alias("kind"), F.when(F.col("part") == 0, F.replace("xml", F.lit("</Folder>"), F.lit(f"{groups}</Folder>"))).otherwise(F.col("xml")).alias("text"))
    ring = spatial.ring_table(spark, sf_dir).select("mission_id", F.transform("ring", lambda p: F.struct((5 + F.round(p["x"], 1) / 10_000).alias("lon"), (52 + F.round(p["y"], 1) / 10_000).alias("lat"), F.lit(7.5).alias("alt"))).alias("ring"))
    ids = w.select("mission_id").distinct().join(ring, "mission_id", "left")
    at = F.when(F.col("mission_id") % 2 == 0, F.struct(F.lit(51.99).alias("lat"), F.lit(4.99).alias("lon"), F.lit(3.0).alias("alt")))
    config = F.create_map(F.lit("finishAction"), F.lit("goHome"), F.lit("autoFlightSpeed"), (F.col("mission_id") % 7 + 1).cast("string"))
    plans = templates.template_xml(ids.select("mission_id", "ring", config.alias("config"), at.alias("takeoff"))).select(F.col("mission_id").alias("archive_id"), F.lit("template").alias("kind"), F.col("xml").alias("text"))
    scans = ids.where("mission_id % 5 = 0").select(F.col("mission_id").alias("archive_id"), F.lit("geo_desc").alias("kind"), F.lit('{"ref_GPS": {"latitude": 52.0, "longitude": 5.0}}').alias("text"))
    return routes.unionByName(plans).unionByName(scans)


@register("template_round_trip", f"WITH {WP}, {RG}, r AS (SELECT mission_id, count(*) AS n FROM rings GROUP BY mission_id) SELECT w.mission_id AS archive_id, 'goHome' AS finish, CAST(w.mission_id % 7 + 1 AS VARCHAR) AS speed, CAST(coalesce(n, 0) AS INT) AS corners, CASE WHEN w.mission_id % 2 = 0 THEN 51.99e0 END AS takeoff_lat FROM (SELECT DISTINCT mission_id FROM waypoints) w LEFT JOIN r ON r.mission_id = w.mission_id")
def template_round_trip(spark, sf_dir):
    t = templates.parse_template(_members(spark, sf_dir))
    return t.select("archive_id", F.col("config")["finishAction"].alias("finish"), F.col("config")["autoFlightSpeed"].alias("speed"), F.size("ring").alias("corners"), F.col("takeoff.lat").alias("takeoff_lat"))


@register("flown_waypoints", f"""WITH {WP}, f AS (SELECT mission_id, arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, arg_min(z, idx) AS fz FROM waypoints GROUP BY mission_id),
r AS (SELECT mission_id, CASE WHEN mission_id % 5 = 0 THEN 52e0 WHEN mission_id % 2 = 0 THEN 51.99e0 ELSE 52e0 + fy/10000 END AS rlat, CASE WHEN mission_id % 5 = 0 THEN 5e0 WHEN mission_id % 2 = 0 THEN 4.99e0 ELSE 5e0 + fx/10000 END AS rlon,
  CASE WHEN mission_id % 5 = 0 THEN 0e0 WHEN mission_id % 2 = 0 THEN 3e0 WHEN mission_id % 3 <> 1 AND fz = 0 THEN 2e0 ELSE fz END AS ralt FROM f),
k AS (SELECT w.mission_id, idx, (5e0 + x/10000 - rlon) * ({_K('rlat')}) AS x, (52e0 + y/10000 - rlat) * ({_M('rlat')}) AS y, CASE WHEN w.mission_id % 3 <> 1 AND z = 0 THEN 2e0 ELSE z END - ralt AS z, heading_deg AS h,
  CASE WHEN w.mission_id % 3 = 1 THEN coalesce(gimbal_yaw_deg, 0e0) + CASE WHEN w.mission_id % 2 = 0 THEN 0 ELSE heading_deg END WHEN is_transition OR gimbal_yaw_deg IS NULL THEN heading_deg ELSE gimbal_yaw_deg END AS g FROM waypoints w JOIN r USING (mission_id))
SELECT mission_id AS archive_id, idx, round(x,4)+0 AS x, round(y,4)+0 AS y, round(z,4)+0 AS z, round({pmod360('(g+180)')}-180,6)+0 AS gimbal_yaw_deg, CAST(CASE WHEN idx BETWEEN 10 AND 19 THEN 5 ELSE 0 END AS INT) AS poses, CASE WHEN idx BETWEEN 10 AND 19 THEN round({pmod360('(h+120+180)')}-180,6)+0 END AS last_yaw FROM k""")
def flown_waypoints(spark, sf_dir):
    m = _members(spark, sf_dir)
    route = missions.parse_waylines(m)
    flown = templates.flown_waypoints(route, templates.resolve_reference(m, route, templates.parse_template(m)), templates.parse_oblique_groups(m))
    four = lambda c: (F.round(c, 4) + 0.0).alias(c)
    six = lambda c: F.round(c, 6) + 0.0
    return flown.select("archive_id", "idx", four("x"), four("y"), four("z"), six(F.col("gimbal_yaw_deg")).alias("gimbal_yaw_deg"), F.size("poses").alias("poses"), six(F.try_element_at("poses", F.lit(-1))["yaw"]).alias("last_yaw"))


@register("filter_issues", f"""WITH a AS ({twin('area_clip')}), b AS ({twin('obstacle_filter')}), c AS ({twin('colliding_segments')}), d AS ({twin('facade_selection')}), {WP},
f AS (SELECT p_partkey AS building_id FROM part), l AS (
  SELECT mission_id, 14 AS rule, 'warning' AS severity, 'mapping_polygon_clipped' AS code, idx FROM waypoints w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.mission_id = w.mission_id AND a.idx = w.idx)
  UNION ALL SELECT mission_id, 15, 'warning', 'pointcloud_obstacle', idx FROM b UNION ALL SELECT mission_id, 16, 'warning', 'path_collision', idx FROM c
  UNION ALL SELECT building_id, 18, 'info', 'facades_disabled', 1 FROM f WHERE building_id % 4 = 0)
SELECT mission_id, rule, severity, code, count(*) AS n, array_to_string(list_sort(list(idx))[1:5], ',') AS first_idx FROM l GROUP BY mission_id, rule, severity, code""")
def filter_issues(spark, sf_dir):
    w, faces = mesh_plans.parts(spark, sf_dir)
    w = w.drop("mesh_id")
    f = facades(spark, sf_dir)
    p = view(spark, sf_dir, "points").withColumnRenamed("cloud_id", "building_id")
    kept = filters.clip_to_area(w, spatial.ring_table(spark, sf_dir)).select("mission_id", "idx")
    clipped = w.select("mission_id", "idx").join(kept, ["mission_id", "idx"], "left_anti")
    legs = meshes.colliding_segments(*mesh_plans.parts(spark, sf_dir))
    off = f.where("building_id % 4 = 0 and facade_index = 1").select(F.col("building_id").alias("mission_id"), "facade_index")
    found = validate.filter_issues(clipped, filters.obstructed(w, p, f, clearance=1.23), legs, legs.limit(0), off)
    return found.select("mission_id", "rule", "severity", "code", "n", F.array_join("waypoint_indices", ",").alias("first_idx"))


@register("aim_verification", f"""WITH c AS ({twin('camera_cone_targets')}), {WP}, k AS (SELECT *, coalesce(gimbal_yaw_deg, heading_deg) AS yaw FROM waypoints WHERE NOT is_transition),
j AS (SELECT *, abs(gimbal_pitch_deg - lag(gimbal_pitch_deg) OVER w) AS dp, yaw - lag(yaw) OVER w AS dyaw FROM k WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
r AS (SELECT j.mission_id, off_deg, gimbal_pitch_deg AS p, dp, {fold180('dyaw')} AS dy FROM j LEFT JOIN c ON c.mission_id = j.mission_id AND c.idx = j.idx)
SELECT mission_id, count(*) AS n, count(*) FILTER (off_deg IS NULL) AS no_hit, count(*) FILTER (off_deg <= 15) AS on_target, round(median(off_deg),6)+0 AS aim_median, round(avg(off_deg),6)+0 AS aim_mean, round(quantile_cont(off_deg,0.9),6)+0 AS aim_p90, round(max(off_deg),6)+0 AS aim_max,
  count(*) FILTER (p > 25) AS pitch_up, count(*) FILTER (p < -85) AS pitch_down, count(*) FILTER (p > -30 AND p < 10) AS pitch_level, round(median(dp),6)+0 AS pitch_jump_median, round(quantile_cont(dp,0.9),6)+0 AS pitch_jump_p90,
  round(median(dy),6)+0 AS yaw_jump_median, round(quantile_cont(dy,0.9),6)+0 AS yaw_jump_p90, count(*) FILTER (dy > 30) AS yaw_jumps, round(count(*) FILTER (off_deg IS NULL)/count(*)*100,6) AS no_hit_pct, round(count(*) FILTER (off_deg <= 15)/count(*)*100,6) AS on_target_pct, round(count(*) FILTER (dy > 30)/nullif(count(*)-1,0)*100,6) AS yaw_jumps_pct FROM r GROUP BY mission_id""")
def aim_verification(spark, sf_dir):
    return rounded(reports.aim_verification(view(spark, sf_dir, "waypoints"), report_plans.camera_cone_targets(spark, sf_dir)))


@register("envelope_faces", f"WITH {FACADES_SQL} SELECT building_id, CAST(row_number() OVER (PARTITION BY building_id ORDER BY facade_index) - 1 AS INT) AS facade_index, label FROM facades")
def envelope_faces(spark, sf_dir):
    """No probe of a lone building's own faces lies inside its box."""
    return meshes.envelope_filter(facades(spark, sf_dir), meshes.box_meshes(view(spark, sf_dir, "buildings"))).select("building_id", "facade_index", "label")
