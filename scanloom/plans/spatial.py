"""Queries of the spatial joins, filters and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import filters, joins, ordering, paths
from scanloom.plans.common import FACADES_SQL, facades, fold180, pmod360, rounded
from scanloom.registry import register
from scanloom.sources.fixtures import VIEWS, view

WP, PT, ZN, RG = (f"{n} AS ({VIEWS[n]})" for n in ("waypoints", "points", "zones", "rings"))


def wps(spark, sf_dir):
    return view(spark, sf_dir, "waypoints")


def ring_table(spark, sf_dir, key="mission_id"):
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return view(spark, sf_dir, "rings").groupBy(F.col("mission_id").alias(key)).agg(ring.alias("ring"))


@register("within_range_join", f"WITH {WP} SELECT a.mission_id, a.idx, b.idx AS other_idx, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6)+0 AS distance FROM waypoints a JOIN waypoints b ON a.mission_id = b.mission_id AND a.idx < b.idx WHERE (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 1.2321e0")
def within_range_join(spark, sf_dir):
    w = wps(spark, sf_dir).select("mission_id", "idx", "x", "y", "z")
    return rounded(joins.within(w, w, 1.11, "mission_id").where("a.idx < b.idx").select("a.mission_id", "a.idx", F.col("b.idx").alias("other_idx"), "distance"))


@register("nearest_facade", f"WITH {FACADES_SQL}, {WP}, d AS (SELECT w.building_id, mission_id, idx, facade_index AS f, 0 AS k, (SELECT 1) AS o FROM waypoints w), c AS (SELECT w.building_id, w.idx, f.facade_index, sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2) AS d FROM waypoints w JOIN facades f ON f.building_id = w.building_id), r AS (SELECT *, row_number() OVER (PARTITION BY building_id, idx ORDER BY round(d, 9), facade_index) AS n FROM c) SELECT building_id, idx, facade_index, round(d,6)+0 AS distance FROM r WHERE n = 1")
def nearest_facade(spark, sf_dir):
    f = facades(spark, sf_dir).select("building_id", "facade_index", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return rounded(joins.nearest(wps(spark, sf_dir), f, "building_id", ["building_id", "idx"], "facade_index"))


_PICK = f"""{FACADES_SQL}, {WP}, c AS (SELECT w.mission_id, w.idx, f.facade_index AS f, cx, cy, cz, sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2) * CASE WHEN f.label LIKE '%_wall' THEN 0.5e0 ELSE 1e0 END AS wt
  FROM waypoints w JOIN facades f ON f.building_id = w.building_id WHERE NOT is_transition AND (x-cx)*nx+(y-cy)*ny+(z-cz)*nz > 0 AND (x-cx)**2+(y-cy)**2+(z-cz)**2 <= 3600),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, idx ORDER BY wt, f) AS n FROM c) WHERE n = 1)"""


@register("pick_facade", f"WITH {_PICK} SELECT w.mission_id, w.idx, p.f AS picked, round(p.wt,6) AS weight FROM waypoints w LEFT JOIN p USING (mission_id, idx)")
def pick_facade(spark, sf_dir):
    return rounded(joins.pick_facade(wps(spark, sf_dir), facades(spark, sf_dir)).select("mission_id", "idx", "picked", "weight"))


_YAW = pmod360("degrees(atan2(cx-x, cy-y))")


@register("reaim_missions", f"WITH {_PICK} SELECT mission_id, idx, coalesce(p.f, -1) AS facade_index, round(CASE WHEN p.f IS NULL THEN gimbal_yaw_deg WHEN {_YAW} > 180 THEN {_YAW} - 360 ELSE {_YAW} END, 6)+0 AS gimbal_yaw_deg, round(CASE WHEN p.f IS NULL THEN gimbal_pitch_deg ELSE greatest(-88e0, least(33e0, CASE WHEN sqrt((cx-x)**2+(cy-y)**2) > 1e-6 THEN degrees(atan2(cz-z, sqrt((cx-x)**2+(cy-y)**2))) ELSE -90e0 END)) END, 6)+0 AS gimbal_pitch_deg FROM waypoints w LEFT JOIN p USING (mission_id, idx)")
def reaim_missions(spark, sf_dir):
    return rounded(joins.reaim(wps(spark, sf_dir), facades(spark, sf_dir)).select("mission_id", "idx", "facade_index", "gimbal_yaw_deg", "gimbal_pitch_deg"))


_GROUPS = "SELECT s_suppkey % 50 AS mission_id, CAST(s_suppkey AS INT) AS group_no, CAST((s_suppkey * 7) % 200 AS INT) AS start_idx, CAST((s_suppkey * 7) % 200 + s_suppkey % 40 AS INT) AS end_idx FROM supplier"


@register("action_group_interval_join", f"WITH {WP}, g AS ({_GROUPS}) SELECT w.mission_id, w.idx, min(group_no) AS group_no FROM waypoints w LEFT JOIN g ON g.mission_id = w.mission_id AND w.idx BETWEEN start_idx AND end_idx GROUP BY ALL")
def action_group_interval_join(spark, sf_dir):
    view(spark, sf_dir, "zones")  # registers supplier
    return joins.interval_groups(wps(spark, sf_dir), spark.sql(_GROUPS))


@register("cross_facade_dedup", f"WITH {WP} SELECT mission_id, idx FROM waypoints w WHERE NOT EXISTS (SELECT 1 FROM waypoints o WHERE o.mission_id = w.mission_id AND w.facade_index > o.facade_index AND (o.x-w.x)**2+(o.y-w.y)**2+(o.z-w.z)**2 <= 6.6564e0 AND abs(o.gimbal_pitch_deg-w.gimbal_pitch_deg) <= 20 AND CASE WHEN abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) > 180 THEN 360-abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) ELSE abs(coalesce(o.gimbal_yaw_deg,0)-coalesce(w.gimbal_yaw_deg,0)) END <= 20)")
def cross_facade_dedup(spark, sf_dir):
    return joins.drop_cross_facade_duplicates(wps(spark, sf_dir), radius=2.58).select("mission_id", "idx")


@register("pose_as_of", f"""WITH {WP}, s AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2), 0) AS seg_m FROM waypoints WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
tl AS (SELECT *, sum(CASE WHEN idx = 0 THEN 0 WHEN is_transition THEN seg_m/9e0 ELSE seg_m/3e0+1 END) OVER (PARTITION BY mission_id ORDER BY idx) AS t_s FROM s),
q AS (SELECT DISTINCT mission_id, unnest(range(200)) * 7.3e0 + 0.37e0 AS at_s FROM waypoints),
a AS (SELECT q.mission_id, at_s, max(idx) AS i, max(idx) + 1 AS j FROM q JOIN tl ON tl.mission_id = q.mission_id AND t_s < at_s GROUP BY ALL),
m AS (SELECT mission_id, max(idx) AS top FROM waypoints GROUP BY mission_id),
f AS (SELECT a.mission_id, at_s, i, p.x AS px, p.y AS py, p.z AS pz, n.x AS qx, n.y AS qy, n.z AS qz, CASE WHEN n.t_s > p.t_s THEN (at_s-p.t_s)/(n.t_s-p.t_s) ELSE 0 END AS f, n.is_transition AS tr
  FROM a JOIN m USING (mission_id) JOIN tl p ON p.mission_id = a.mission_id AND p.idx = a.i JOIN tl n ON n.mission_id = a.mission_id AND n.idx = least(a.j, top)),
g AS (SELECT *, CASE WHEN tr THEN f*f*(3-2*f) ELSE f END AS e FROM f)
SELECT mission_id, round(at_s,6) AS at_s, i AS from_idx, round(px+(qx-px)*e,6)+0 AS x, round(py+(qy-py)*e,6)+0 AS y, round(pz+(qz-pz)*e,6)+0 AS z FROM g""")
def pose_as_of(spark, sf_dir):
    w = wps(spark, sf_dir)
    q = w.select("mission_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199)))).select("mission_id", (F.col("k") * 7.3 + 0.37).alias("at_s"))
    return rounded(joins.pose_at(paths.timeline(w), q))


@register("before_after_diff", f"WITH {_PICK}, b AS (SELECT mission_id, idx, gimbal_yaw_deg AS y0, gimbal_pitch_deg AS p0, CASE WHEN p.f IS NULL THEN gimbal_yaw_deg WHEN {_YAW} > 180 THEN {_YAW} - 360 ELSE {_YAW} END AS y1, CASE WHEN p.f IS NULL THEN gimbal_pitch_deg ELSE greatest(-88e0, least(33e0, degrees(atan2(cz-z, sqrt((cx-x)**2+(cy-y)**2))))) END AS p1 FROM waypoints w LEFT JOIN p USING (mission_id, idx)), d AS (SELECT mission_id, abs(p1-p0) AS dp, {fold180('(y1-y0)')} AS dy FROM b WHERE y0 IS NOT NULL) SELECT mission_id, count(*) AS compared, round(avg(dp),6)+0 AS mean_pitch, round(max(dy),6)+0 AS max_yaw, count(*) FILTER (greatest(dp,dy) >= 0.5) AS over_half, count(*) FILTER (greatest(dp,dy) >= 1) AS over_one, count(*) FILTER (greatest(dp,dy) >= 5) AS over_five FROM d GROUP BY mission_id")
def before_after_diff(spark, sf_dir):
    w = wps(spark, sf_dir)
    return rounded(joins.before_after(w, joins.reaim(w, facades(spark, sf_dir))))


@register("uncovered_facades", f"WITH {FACADES_SQL}, {WP} SELECT building_id, facade_index, label FROM facades f WHERE width_m*height_m >= 2 AND NOT EXISTS (SELECT 1 FROM waypoints w WHERE NOT is_transition AND w.building_id = f.building_id AND w.facade_index = f.facade_index)")
def uncovered_facades(spark, sf_dir):
    return joins.uncovered(facades(spark, sf_dir), wps(spark, sf_dir)).select("building_id", "facade_index", "label")


@register("zone_filter", f"""WITH {WP}, {ZN}, h AS (SELECT w.mission_id, w.idx, bool_or(zone_type = 'inclusion') AS b, bool_or(zone_type = 'inclusion' AND i) AS inc, bool_or(zone_type = 'no_fly' AND i) AS nf, bool_or(zone_type = 'no_inspect' AND i) AS ni
  FROM (SELECT w.*, zone_type, abs(w.z-center_z) <= size_z/2 AND abs(w.x-center_x) <= size_x/2 AND abs(w.y-center_y) <= size_y/2 AS i FROM waypoints w JOIN zones zz USING (mission_id)) w GROUP BY ALL)
SELECT w.mission_id, w.idx FROM waypoints w LEFT JOIN h USING (mission_id, idx) WHERE (NOT coalesce(b,false) OR coalesce(inc,false)) AND NOT coalesce(nf,false) AND (is_transition OR NOT coalesce(ni,false))""")
def zone_filter(spark, sf_dir):
    return filters.filter_by_zones(wps(spark, sf_dir), view(spark, sf_dir, "zones")).select("mission_id", "idx")


_RING = f"""{RG}, c AS (SELECT mission_id, avg(x) AS mx, avg(y) AS my FROM rings GROUP BY mission_id),
e AS (SELECT r.mission_id, seq, mx + (x-mx)*(sqrt((x-mx)**2+(y-my)**2)+2)/sqrt((x-mx)**2+(y-my)**2) AS x, my + (y-my)*(sqrt((x-mx)**2+(y-my)**2)+2)/sqrt((x-mx)**2+(y-my)**2) AS y FROM rings r JOIN c USING (mission_id)),
sd AS (SELECT a.mission_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b2 FROM e a JOIN e b ON a.mission_id = b.mission_id AND b.seq = (a.seq + 1) % 6)"""


@register("area_clip", f"WITH {WP}, {_RING} SELECT w.mission_id, w.idx FROM waypoints w LEFT JOIN sd ON sd.mission_id = w.mission_id GROUP BY w.mission_id, w.idx, is_transition HAVING is_transition OR count(sd.ax) = 0 OR count(*) FILTER ((ay > w.y) <> (b2 > w.y) AND w.x < (bx-ax)*(w.y-ay)/(b2-ay)+ax) % 2 = 1".replace("GROUP BY w.mission_id, w.idx, is_transition", "GROUP BY w.mission_id, w.idx, is_transition, w.x, w.y"))
def area_clip(spark, sf_dir):
    return filters.clip_to_area(wps(spark, sf_dir), ring_table(spark, sf_dir)).select("mission_id", "idx")


@register("facades_in_area", f"WITH {FACADES_SQL}, {_RING} SELECT f.building_id, f.facade_index FROM facades f LEFT JOIN sd ON sd.mission_id = f.building_id GROUP BY f.building_id, f.facade_index, cx, cy HAVING count(sd.ax) = 0 OR count(*) FILTER ((ay > cy) <> (b2 > cy) AND cx < (bx-ax)*(cy-ay)/(b2-ay)+ax) % 2 = 1")
def facades_in_area(spark, sf_dir):
    return filters.facades_in_area(facades(spark, sf_dir), ring_table(spark, sf_dir, "building_id")).select("building_id", "facade_index")


@register("obstacle_filter", f"""WITH {FACADES_SQL}, {WP}, {PT}, w AS (SELECT w.*, nx, ny, nz FROM waypoints w LEFT JOIN facades f ON f.building_id = w.building_id AND f.facade_index = w.facade_index),
b AS (SELECT DISTINCT w.mission_id, w.idx FROM w JOIN points p ON p.cloud_id = w.building_id AND (p.x-w.x)**2+(p.y-w.y)**2+(p.z-w.z)**2 <= 1.5129e0
  WHERE NOT coalesce(NOT is_transition AND nx IS NOT NULL AND sqrt((p.x-w.x)**2+(p.y-w.y)**2+(p.z-w.z)**2) >= 1e-6 AND -((p.x-w.x)*nx+(p.y-w.y)*ny+(p.z-w.z)*nz)/sqrt((p.x-w.x)**2+(p.y-w.y)**2+(p.z-w.z)**2) > cos(radians(60)), false))
SELECT mission_id, idx FROM b""")
def obstacle_filter(spark, sf_dir):
    p = view(spark, sf_dir, "points").withColumnRenamed("cloud_id", "building_id")
    return filters.obstructed(wps(spark, sf_dir), p, facades(spark, sf_dir), clearance=1.23)


@register("height_slice", f"WITH {PT}, q AS (SELECT cloud_id, quantile_cont(z,0.3) AS a, quantile_cont(z,0.7) AS b FROM points GROUP BY cloud_id) SELECT cloud_id, point_id FROM points JOIN q USING (cloud_id) WHERE z > a AND z < b")
def height_slice(spark, sf_dir):
    return filters.height_slice(view(spark, sf_dir, "points"), 0.3, 0.7).select("cloud_id", "point_id")


@register("drop_ground", f"WITH {PT}, q AS (SELECT cloud_id, quantile_cont(z,0.05) AS a FROM points GROUP BY cloud_id) SELECT cloud_id, point_id FROM points JOIN q USING (cloud_id) WHERE z >= a + 1")
def drop_ground(spark, sf_dir):
    return filters.drop_ground(view(spark, sf_dir, "points")).select("cloud_id", "point_id")


@register("config_out_of_range", f"WITH {WP} SELECT mission_id, idx, knob, value+0 AS value, low, high FROM (SELECT mission_id, idx, unnest([{{'k':'speed_ms','v':speed_ms,'l':0.5e0,'h':15e0}},{{'k':'gimbal_pitch_deg','v':gimbal_pitch_deg,'l':-90e0,'h':35e0}},{{'k':'z','v':z,'l':2e0,'h':120e0}},{{'k':'heading_deg','v':heading_deg,'l':0e0,'h':360e0}}]) AS u FROM waypoints) t, LATERAL (SELECT u.k AS knob, u.v AS value, u.l AS low, u.h AS high) WHERE value < low OR value > high")
def config_out_of_range(spark, sf_dir):
    return rounded(filters.out_of_range(wps(spark, sf_dir), ["mission_id", "idx"]))


@register("best_extraction", f"WITH {FACADES_SQL}, m AS (SELECT building_id, facade_index, CAST((building_id + facade_index) % 3 AS INT) AS priority FROM facades), n AS (SELECT building_id, min(priority) AS priority FROM (SELECT building_id, priority FROM m GROUP BY ALL HAVING count(*) >= 2) GROUP BY building_id) SELECT m.building_id, m.facade_index, m.priority FROM m JOIN n USING (building_id, priority)")
def best_extraction(spark, sf_dir):
    f = facades(spark, sf_dir).select("building_id", "facade_index", ((F.col("building_id") + F.col("facade_index")) % 3).cast("int").alias("priority"))
    return filters.best_extraction(f, least=2).select("building_id", "facade_index", "priority")


@register("facade_selection", f"WITH {FACADES_SQL}, t AS (SELECT building_id, max(facade_index) AS top FROM facades GROUP BY building_id) SELECT building_id, facade_index, label FROM facades WHERE NOT (building_id % 4 = 0 AND facade_index = 1) UNION ALL SELECT building_id, CAST(top + row_number() OVER (PARTITION BY building_id ORDER BY facade_index) AS INT), 'added_' || label FROM facades JOIN t USING (building_id) WHERE building_id % 5 = 0 AND facade_index IN (0, 2)")
def facade_selection(spark, sf_dir):
    f = facades(spark, sf_dir).select("building_id", "facade_index", "label")
    return filters.with_selection(f, f.where("building_id % 4 = 0 and facade_index = 1"), f.where("building_id % 5 = 0 and facade_index in (0, 2)"))


_ENDS = f"{WP}, g AS (SELECT mission_id, facade_index AS g, arg_min(struct_pack(x := x, y := y, z := z), idx) AS f, arg_max(struct_pack(x := x, y := y, z := z), idx) AS l FROM waypoints WHERE facade_index >= 0 GROUP BY ALL)"


@register("sweep_reversal", f"""WITH RECURSIVE {_ENDS}, k AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY g) AS n FROM g),
t AS (SELECT mission_id, g, n, false AS r, l AS e FROM k WHERE n = 1 UNION ALL
  SELECT mission_id, g, n, r, CASE WHEN r THEN f ELSE l END FROM (SELECT k.*, sqrt((t.e.x-k.l.x)**2+(t.e.y-k.l.y)**2+(t.e.z-k.l.z)**2) < sqrt((t.e.x-k.f.x)**2+(t.e.y-k.f.y)**2+(t.e.z-k.f.z)**2) - 0.1 AS r FROM t JOIN k ON k.mission_id = t.mission_id AND k.n = t.n + 1))
SELECT mission_id, g AS facade_index, r AS reversed FROM t""")
def sweep_reversal(spark, sf_dir):
    return ordering.sweep_reversal(ordering.face_groups(wps(spark, sf_dir)))


@register("facade_tour", f"""WITH RECURSIVE {_ENDS}, s AS (SELECT mission_id, g, l, row_number() OVER (PARTITION BY mission_id ORDER BY (f.x+l.x)**2+(f.y+l.y)**2+(f.z+l.z)**2, g) AS n FROM g),
t AS (SELECT mission_id, 0 AS position, g, l, [g] AS seen FROM s WHERE n = 1 UNION ALL
  SELECT mission_id, position, g, l, seen FROM (SELECT t.mission_id, t.position + 1 AS position, g.g, g.l, list_append(t.seen, g.g) AS seen,
    row_number() OVER (PARTITION BY t.mission_id ORDER BY least(sqrt((t.l.x-g.f.x)**2+(t.l.y-g.f.y)**2+(t.l.z-g.f.z)**2), sqrt((t.l.x-g.l.x)**2+(t.l.y-g.l.y)**2+(t.l.z-g.l.z)**2)), g.g) AS n
    FROM t JOIN g ON g.mission_id = t.mission_id AND NOT list_contains(t.seen, g.g)) WHERE n = 1)
SELECT mission_id, position, g AS facade_index FROM t""")
def facade_tour(spark, sf_dir):
    return ordering.nearest_neighbour_tour(ordering.face_groups(wps(spark, sf_dir)))


@register("common_waypoints", f"WITH {WP}, a AS (SELECT mission_id, idx FROM waypoints WHERE idx % 3 <> 0), b AS (SELECT mission_id, idx FROM waypoints WHERE idx % 5 <> 0), c AS (SELECT mission_id, count(*) FILTER (b.idx IS NOT NULL AND a.idx IS NOT NULL) AS common, count(*) FILTER (b.idx IS NULL) AS only_a, count(*) FILTER (a.idx IS NULL) AS only_b FROM a FULL JOIN b USING (mission_id, idx) GROUP BY mission_id) SELECT * FROM c")
def common_waypoints(spark, sf_dir):
    w = wps(spark, sf_dir).select("mission_id", "idx")
    a, b = w.where("idx % 3 <> 0"), w.where("idx % 5 <> 0")
    parts = [a.intersect(b).withColumn("s", F.lit("common")), a.exceptAll(b).withColumn("s", F.lit("only_a")), b.exceptAll(a).withColumn("s", F.lit("only_b"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("mission_id").agg(*[F.count_if(F.col("s") == n).alias(n) for n in ("common", "only_a", "only_b")])
