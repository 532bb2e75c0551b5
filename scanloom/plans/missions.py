"""Queries of the path windows and mission reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import aggregates, paths
from scanloom.plans.common import fold180, rounded
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

WP = f"waypoints AS ({VIEWS['waypoints']})"
SEG = f"{WP}, s AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2), 0) AS seg_m FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx))"


def wps(spark, sf_dir):
    return view(spark, sf_dir, "waypoints")


@register("path_lengths", f"WITH {SEG} SELECT mission_id, idx, round(seg_m,6) AS seg_m, round(sum(seg_m) OVER (PARTITION BY mission_id ORDER BY idx),6) AS cum_m FROM s")
def path_lengths(spark, sf_dir):
    return rounded(paths.with_path(wps(spark, sf_dir)).select("mission_id", "idx", "seg_m", "cum_m"))


@register("path_timeline", f"WITH {SEG} SELECT mission_id, idx, round(sum(CASE WHEN idx = 0 THEN 0 WHEN is_transition THEN seg_m/9e0 ELSE seg_m/3e0+1 END) OVER (PARTITION BY mission_id ORDER BY idx),6)+0 AS t_s FROM s")
def path_timeline(spark, sf_dir):
    return rounded(paths.timeline(wps(spark, sf_dir)).select("mission_id", "idx", "t_s"))


@register("adjacent_deltas", f"WITH {WP}, d AS (SELECT mission_id, idx, abs(gimbal_pitch_deg - lag(gimbal_pitch_deg) OVER w) AS pitch_jump, heading_deg - lag(heading_deg) OVER w AS h FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx)) SELECT mission_id, idx, round(pitch_jump,6)+0 AS pitch_jump, round({fold180('h')},6)+0 AS yaw_jump FROM d WHERE pitch_jump IS NOT NULL")
def adjacent_deltas(spark, sf_dir):
    return rounded(paths.adjacent_deltas(wps(spark, sf_dir)).select("mission_id", "idx", "pitch_jump", "yaw_jump"))


@register("facade_transitions", f"WITH {WP}, d AS (SELECT *, last_value(CASE WHEN NOT is_transition AND facade_index >= 0 THEN facade_index END IGNORE NULLS) OVER (PARTITION BY mission_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_facade, heading_deg - lag(heading_deg) OVER (PARTITION BY mission_id ORDER BY idx) AS h FROM waypoints) SELECT mission_id, idx, from_facade, facade_index AS to_facade, round({fold180('h')},6)+0 AS turn_deg FROM d WHERE NOT is_transition AND facade_index >= 0 AND from_facade <> facade_index")
def facade_transitions(spark, sf_dir):
    return rounded(paths.facade_transitions(wps(spark, sf_dir)))


@register("path_near_duplicates", f"WITH {WP} SELECT a.mission_id, a.idx, b.idx AS other_idx, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6) AS distance_m FROM waypoints a JOIN waypoints b ON a.mission_id = b.mission_id AND b.idx BETWEEN a.idx+1 AND a.idx+4 WHERE NOT a.is_transition AND NOT b.is_transition AND sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) < 5")
def path_near_duplicates(spark, sf_dir):
    return rounded(paths.near_duplicates(wps(spark, sf_dir), within=5.0))


@register("path_reversals", f"""WITH {WP}, d AS (SELECT mission_id, idx, x-lag(x) OVER w AS ax, y-lag(y) OVER w AS ay, lead(x) OVER w-x AS bx, lead(y) OVER w-y AS b2, is_transition OR lag(is_transition) OVER w OR lead(is_transition) OVER w AS t FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
e AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, (ax*bx+ay*b2)/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+b2*b2)))))) AS turn FROM d WHERE sqrt(ax*ax+ay*ay) >= 0.1 AND sqrt(bx*bx+b2*b2) >= 0.1 AND NOT t)
SELECT mission_id, idx, round(turn,4) AS turn_deg FROM e WHERE turn > 150""")
def path_reversals(spark, sf_dir):
    return paths.reversals(wps(spark, sf_dir)).withColumn("turn_deg", F.round("turn_deg", 4))


@register("photo_interval_check", f"WITH {WP}, d AS (SELECT mission_id, idx, facade_index, lag(facade_index) OVER w AS f, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) AS d FROM waypoints WHERE NOT is_transition WINDOW w AS (PARTITION BY mission_id ORDER BY idx)) SELECT mission_id, idx, round(d,6) AS distance_m FROM d WHERE f = facade_index AND d/0.3e0 < 30 AND d < 9")
def photo_interval_check(spark, sf_dir):
    return rounded(paths.photo_interval(wps(spark, sf_dir), speed=0.3, interval_s=30.0, least_m=9.0))


@register("pose_dedup", f"""WITH RECURSIVE {WP}, f AS (
  SELECT mission_id, idx, NOT is_transition AS g, NOT is_transition AS hh, CASE WHEN NOT is_transition THEN gimbal_pitch_deg END AS p, CASE WHEN NOT is_transition THEN gimbal_yaw_deg END AS yw, CASE WHEN NOT is_transition THEN heading_deg END AS h FROM waypoints WHERE idx = 0
  UNION ALL
  SELECT mission_id, idx, g, hh, CASE WHEN g THEN gp ELSE p END, CASE WHEN g THEN coalesce(gy, yw) ELSE yw END, CASE WHEN hh THEN hd ELSE h END FROM (
    SELECT w.mission_id, w.idx, f.p, f.yw, f.h, w.gimbal_pitch_deg AS gp, w.gimbal_yaw_deg AS gy, w.heading_deg AS hd,
      NOT w.is_transition AND (f.p IS NULL OR abs(w.gimbal_pitch_deg-f.p) > 5 OR coalesce({fold180('(w.gimbal_yaw_deg-f.yw)')} > 5, false)) AS g,
      NOT w.is_transition AND (f.h IS NULL OR {fold180('(w.heading_deg-f.h)')} > 5) AS hh
    FROM f JOIN waypoints w ON w.mission_id = f.mission_id AND w.idx = f.idx + 1))
SELECT mission_id, idx, g AS emit_gimbal, hh AS emit_heading FROM f""")
def pose_dedup(spark, sf_dir):
    return paths.dedupe_poses(wps(spark, sf_dir))


@register("mission_summary", f"WITH {SEG} SELECT mission_id, count(*) AS waypoints, count(*) FILTER (NOT is_transition) AS inspection, count(*) FILTER (is_transition) AS transit, round(sum(seg_m),6) AS path_m, round(coalesce(sum(CASE WHEN idx > 0 THEN seg_m/speed_ms + CASE WHEN is_transition THEN 0 ELSE 1 END END),0),6)+0 AS flight_s, count(DISTINCT CASE WHEN NOT is_transition AND facade_index >= 0 THEN facade_index END) AS facades FROM s GROUP BY mission_id")
def mission_summary(spark, sf_dir):
    return rounded(aggregates.mission_summary(wps(spark, sf_dir)))


@register("flight_time_models", f"WITH {SEG}, t AS (SELECT *, {fold180('(heading_deg - lag(heading_deg) OVER (PARTITION BY mission_id ORDER BY idx))')} AS turn FROM s) SELECT mission_id, round(sum(seg_m)/3e0 + count(*) FILTER (NOT is_transition) + coalesce(sum(turn/60e0) FILTER (turn > 1),0) + 60,6) AS model_a_s, round(coalesce(sum(seg_m/speed_ms) FILTER (idx > 0),0) + count(*) FILTER (idx > 0 AND NOT is_transition),6)+0 AS model_b_s, round(sum(seg_m)/3e0 + 0.5*count(*),6) AS model_c_s FROM t GROUP BY mission_id")
def flight_time_models(spark, sf_dir):
    return rounded(aggregates.flight_time(wps(spark, sf_dir)))


@register("gimbal_stats", f"WITH {WP}, g AS (SELECT mission_id, avg(gimbal_pitch_deg) AS m, list_sort(list(gimbal_pitch_deg)) AS v, count(DISTINCT round(gimbal_yaw_deg,1)) AS dy, list_sort(list(idx) FILTER (gimbal_pitch_deg >= 25)) AS u, list_sort(list(idx) FILTER (gimbal_pitch_deg <= -85)) AS d FROM waypoints WHERE NOT is_transition GROUP BY mission_id) SELECT mission_id, round(m,6)+0 AS mean_pitch, v[1]+0 AS min_pitch, v[-1]+0 AS max_pitch, v[len(v)//4+1]+0 AS p25, v[len(v)//2+1]+0 AS median, v[3*len(v)//4+1]+0 AS p75, dy AS distinct_yaw, CAST(coalesce(len(u),0) AS INT) AS n_up, CAST(coalesce(len(d),0) AS INT) AS n_down, array_to_string(u[1:10], ',') AS up_idx, array_to_string(d[1:10], ',') AS down_idx FROM g")
def gimbal_stats(spark, sf_dir):
    g = aggregates.gimbal_stats(wps(spark, sf_dir))
    return rounded(g.withColumns({c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("up_idx", "down_idx")}))


@register("five_number_pitch", f"WITH {WP} SELECT mission_id, min(gimbal_pitch_deg)+0 AS min, quantile_cont(gimbal_pitch_deg,0.25)+0 AS p25, quantile_cont(gimbal_pitch_deg,0.5)+0 AS median, quantile_cont(gimbal_pitch_deg,0.75)+0 AS p75, max(gimbal_pitch_deg)+0 AS max FROM waypoints GROUP BY mission_id")
def five_number_pitch(spark, sf_dir):
    return rounded(aggregates.five_number(wps(spark, sf_dir), "mission_id", "gimbal_pitch_deg"))


@register("path_totals", f"WITH {SEG}, t AS (SELECT *, is_transition OR coalesce(lag(is_transition) OVER (PARTITION BY mission_id ORDER BY idx), false) AS tr FROM s), g AS (SELECT mission_id, sum(seg_m) AS a, coalesce(sum(seg_m) FILTER (tr),0) AS b FROM t GROUP BY mission_id) SELECT mission_id, round(a,6) AS total_m, round(b,6)+0 AS transit_m, round(CASE WHEN a > 0 THEN (a-b)/a*100 ELSE 0 END,6)+0 AS efficiency_pct FROM g")
def path_totals(spark, sf_dir):
    return rounded(aggregates.path_totals(wps(spark, sf_dir)))


@register("orbit_radius", f"WITH {WP}, m AS (SELECT mission_id, avg(x) AS mx, avg(y) AS my FROM waypoints GROUP BY mission_id), g AS (SELECT mission_id, median(sqrt((x-mx)**2+(y-my)**2)) AS r FROM waypoints JOIN m USING (mission_id) GROUP BY mission_id) SELECT mission_id, round(CASE WHEN r > 0.1 THEN r ELSE 8 END,6) AS radius_m FROM g")
def orbit_radius(spark, sf_dir):
    return rounded(aggregates.orbit_radius(wps(spark, sf_dir)))


@register("cloud_stats", f"WITH points AS ({VIEWS['points']}) SELECT cloud_id, count(*) AS points, {', '.join(f'round(min({a}),6)+0 AS min_{a}, round(max({a}),6)+0 AS max_{a}' for a in 'xyz')}, round(quantile_cont(z,0.05),6)+0 AS z_p5, round(quantile_cont(z,0.95),6)+0 AS z_p95, round(count(*)/greatest(1,(max(x)-min(x))*(max(y)-min(y))),6) AS density FROM points GROUP BY cloud_id")
def cloud_stats(spark, sf_dir):
    return rounded(aggregates.cloud_stats(view(spark, sf_dir, "points")))
