"""Queries of cloud planes and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import augment, clouds, edges, planes, voting
from scanloom.plans.common import rounded
from scanloom.registry import register
from scanloom.session import table
from scanloom.sources.fixtures import VIEWS, view

PT = f"points AS ({VIEWS['points']})"
#: Planes given as rows: angles are multiples of 3.1 degrees, so that none is 5 degrees from another.
PLANES = """SELECT p_partkey % 40 AS cloud_id, p_partkey AS plane_id, 50 + p_size * 3 AS points,
  sin(radians((p_partkey * 37 % 100) * 31e-1)) * cos(radians((p_partkey % 7) * 31e-1)) AS nx, cos(radians((p_partkey * 37 % 100) * 31e-1)) * cos(radians((p_partkey % 7) * 31e-1)) AS ny, sin(radians((p_partkey % 7) * 31e-1)) AS nz,
  (p_partkey * 13 % 90) / 1e1 AS cx, (p_partkey * 29 % 70) / 1e1 AS cy, (p_partkey * 7 % 40) / 1e1 AS cz FROM part"""
_DOT = "abs({0}.nx*{1}.nx + {0}.ny*{1}.ny + {0}.nz*{1}.nz) >= cos(radians(5e0))"
SNAPPED = f"""p AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY plane_id) AS r FROM ({PLANES})),
f AS (SELECT cloud_id, r, [{{'plane_id': plane_id, 'nx': nx, 'ny': ny, 'nz': nz}}] AS leads FROM p WHERE r = 1
  UNION ALL SELECT p.cloud_id, p.r, CASE WHEN len(list_filter(f.leads, lambda g: {_DOT.format('g', 'p')})) > 0 THEN f.leads ELSE list_append(f.leads, {{'plane_id': p.plane_id, 'nx': p.nx, 'ny': p.ny, 'nz': p.nz}}) END FROM f JOIN p ON p.cloud_id = f.cloud_id AND p.r = f.r + 1),
l AS (SELECT cloud_id, arg_max(leads, r) AS leads FROM f GROUP BY cloud_id),
j AS (SELECT p.*, list_filter(leads, lambda g: {_DOT.format('g', 'p')})[1] AS g FROM p JOIN l USING (cloud_id)),
k AS (SELECT *, CASE WHEN g.nx*nx + g.ny*ny + g.nz*nz < 0 THEN -1e0 ELSE 1e0 END * points AS w FROM j),
m AS (SELECT cloud_id, g.plane_id AS group_id, sum(nx*w) AS mx, sum(ny*w) AS my, sum(nz*w) AS mz, sqrt(sum(nx*w)**2 + sum(ny*w)**2 + sum(nz*w)**2) AS s FROM k GROUP BY ALL),
s AS (SELECT k.cloud_id, k.plane_id, group_id, points, mx/s AS nx, my/s AS ny, mz/s AS nz, (mx*cx + my*cy + mz*cz)/s AS d FROM k JOIN m ON m.cloud_id = k.cloud_id AND m.group_id = k.g.plane_id)"""


def given_planes(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(PLANES)


@register("snapped_planes", f"WITH RECURSIVE {SNAPPED} SELECT cloud_id, plane_id, group_id, points, round(nx,6)+0 AS nx, round(ny,6)+0 AS ny, round(nz,6)+0 AS nz, round(d,6)+0 AS d FROM s")
def snapped_planes(spark, sf_dir):
    return rounded(planes.snap_parallel(given_planes(spark, sf_dir)).drop("cx", "cy", "cz"))


@register("merged_planes", f"""WITH RECURSIVE {SNAPPED}, o AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, group_id ORDER BY d, plane_id) AS r FROM s),
a AS (SELECT cloud_id, group_id, r, 1 AS run, d AS m, points AS w FROM o WHERE r = 1
  UNION ALL SELECT o.cloud_id, o.group_id, o.r, CASE WHEN abs(a.m - o.d) <= 0.45e0 THEN a.run ELSE a.run + 1 END, CASE WHEN abs(a.m - o.d) <= 0.45e0 THEN (a.m*a.w + o.d*o.points)/(a.w + o.points) ELSE o.d END, CASE WHEN abs(a.m - o.d) <= 0.45e0 THEN a.w + o.points ELSE o.points END
  FROM a JOIN o ON o.cloud_id = a.cloud_id AND o.group_id = a.group_id AND o.r = a.r + 1)
SELECT cloud_id, CAST(arg_max(o.plane_id, o.points * 1000000 - r) AS BIGINT) AS plane_id, group_id, CAST(sum(o.points) AS BIGINT) AS points, round(arg_max(m, r),6)+0 AS d, count(*) AS members FROM a JOIN o USING (cloud_id, group_id, r) GROUP BY cloud_id, group_id, run""")
def merged_planes(spark, sf_dir):
    found = planes.merge_coplanar(planes.snap_parallel(given_planes(spark, sf_dir)), 0.45)
    return rounded(found.select("cloud_id", F.col("plane_id").cast("long").alias("plane_id"), "group_id", F.col("points").cast("long").alias("points"), "d", F.size("members").cast("long").alias("members")))


_GIVEN = "(VALUES (0, 0e0, -1e0, 0e0), (1, -1e0, 0e0, 0e0), (2, 0e0, 1e0, 0e0), (3, 1e0, 0e0, 0e0), (4, 0e0, 0e0, -1e0)) AS g(plane_id, nx, ny, nz)"


@register("plane_rectangles", f"""WITH {PT}, o AS (SELECT cloud_id, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM points GROUP BY cloud_id),
c AS (SELECT cloud_id, plane_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY ALL),
f AS (SELECT c.* EXCLUDE (nx, ny, nz), s*nx AS nx, s*ny AS ny, s*nz AS nz FROM (SELECT c.*, nx, ny, nz, CASE WHEN nx*(cx-ox)+ny*(cy-oy)+nz*(cz-oz) < 0 THEN -1e0 ELSE 1e0 END AS s FROM c JOIN o USING (cloud_id) JOIN {_GIVEN} USING (plane_id)) c),
e AS (SELECT cloud_id, plane_id, 0.5e0*atan2(2*sum((x-cx)*(y-cy)), sum((x-cx)**2) - sum((y-cy)**2)) AS t FROM points JOIN c USING (cloud_id, plane_id) GROUP BY ALL),
u AS (SELECT f.*, CASE WHEN abs(nz) > 0.5 THEN cos(t)*sg ELSE ny END AS ux, CASE WHEN abs(nz) > 0.5 THEN sin(t)*sg ELSE -nx END AS uy FROM f JOIN (SELECT *, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS sg FROM e) USING (cloud_id, plane_id)),
w AS (SELECT u.cloud_id, u.plane_id, ux*(x-cx)+uy*(y-cy) AS pu, (ny*0-nz*uy)*(x-cx) + (nz*ux)*(y-cy) + (nx*uy-ny*ux)*(z-cz) AS pv FROM points p JOIN u ON u.cloud_id = p.cloud_id AND u.plane_id = p.plane_id),
q AS (SELECT cloud_id, plane_id, list_sort(list(pu)) AS us, list_sort(list(pv)) AS vs, greatest((max(pu)-min(pu))*(max(pv)-min(pv)), 1e-6) AS raw, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, (CASE WHEN raw < 2 THEN 0e0 ELSE 5e0*(0.4e0+0.6e0*least(1, raw/20)) END / 100)*(n-1) AS k0, (1 - CASE WHEN raw < 2 THEN 0e0 ELSE 5e0*(0.4e0+0.6e0*least(1, raw/20)) END / 100)*(n-1) AS k1 FROM q),
b AS (SELECT *, CAST(floor(k0) AS INT) AS i, CAST(floor(k1) AS INT) AS j FROM r),
x AS (SELECT cloud_id, plane_id, us[i+1] + (us[least(i+2,n)]-us[i+1])*(k0-i) AS u0, us[j+1] + (us[least(j+2,n)]-us[j+1])*(k1-j) AS u1, vs[i+1] + (vs[least(i+2,n)]-vs[i+1])*(k0-i) AS v0, vs[j+1] + (vs[least(j+2,n)]-vs[j+1])*(k1-j) AS v1, n FROM b)
SELECT x.cloud_id, x.plane_id, x.n AS points, round(u1-u0,6) AS width, round(v1-v0,6) AS height, CASE WHEN abs(nz) <= 0.35 THEN 'wall' ELSE 'roof' END AS kind, nx+0 AS nx, ny+0 AS ny, nz+0 AS nz, round(cx + ux*u0 + (ny*0-nz*uy)*v0,6)+0 AS x0, round(cy + uy*u0 + nz*ux*v0,6)+0 AS y0, round(cz + (nx*uy-ny*ux)*v0,6)+0 AS z0
FROM x JOIN u USING (cloud_id, plane_id) WHERE x.n/greatest((u1-u0)*(v1-v0), 1e-6) >= 1.5""")
def plane_rectangles(spark, sf_dir):
    """The box's planes as given, their points labelled: extents, outward normals, first corner."""
    p = view(spark, sf_dir, "points").select("cloud_id", "plane_id", "x", "y", "z")
    given = spark.sql(f"SELECT * FROM {_GIVEN}")
    own = p.select("cloud_id", "plane_id").distinct().join(F.broadcast(given), "plane_id")
    r = planes.oriented_rectangles(own, p, density=1.5)
    return rounded(r.select("cloud_id", "plane_id", "points", "width", "height", "kind", "nx", "ny", "nz", F.col("vertices")[0]["x"].alias("x0"), F.col("vertices")[0]["y"].alias("y0"), F.col("vertices")[0]["z"].alias("z0")))


@register("plane_faces")
def plane_faces(spark, sf_dir):
    """Clouds to faces: regions grown, parallel planes snapped, inliers to rectangles."""
    p = view(spark, sf_dir, "points").select("cloud_id", "point_id", "x", "y", "z")
    return rounded(faces_of(p, density=1.0).drop("vertices"))


def faces_of(points, **options):
    regions = clouds.plane_regions(points)
    found = clouds.planes_of(regions)
    inliers = clouds.plane_inliers(points, found, regions)
    return planes.as_facades(planes.oriented_rectangles(planes.snap_parallel(found.drop("d", "rms", "region")), inliers, **options))


#: The planted box's faces, offsets to the nearest half metre.
_BOX = "(VALUES ('x', -5e0), ('x', 5e0), ('y', -25e-1), ('y', 25e-1), ('z', 4e0)) AS b(axis, offset_m)"
_AXIS = "CASE WHEN abs(nx) > 0.99 THEN 'x' WHEN abs(ny) > 0.99 THEN 'y' WHEN abs(nz) > 0.99 THEN 'z' END AS axis"


@register("voted_planes", f"WITH {PT} SELECT cloud_id, axis, offset_m FROM (SELECT DISTINCT cloud_id FROM points) c CROSS JOIN {_BOX}")
def voted_planes(spark, sf_dir):
    """Planes that hypothesis voting finds in every cloud: one a side of the planted box and no other."""
    found, _ = voting.vote(view(spark, sf_dir, "points").select("cloud_id", "point_id", "x", "y", "z"), threshold=0.05, least=1500)
    return found.selectExpr("cloud_id", _AXIS, "round(2 * d * sign(nx + ny + nz)) / 2 + 0e0 AS offset_m")


@register("voted_walls", f"WITH {PT} SELECT cloud_id, axis, offset_m, CASE axis WHEN 'z' THEN 'roof' ELSE 'wall' END AS kind, CASE WHEN axis = 'z' THEN 1 ELSE sign(offset_m) END::DOUBLE AS outward FROM (SELECT DISTINCT cloud_id FROM points) c CROSS JOIN {_BOX}")
def voted_walls(spark, sf_dir):
    """Walls from lines of the height slice and the roof from the top slice."""
    faces = voting.ransac_wall_faces(view(spark, sf_dir, "points"), walls=(0.15, 1000, 20), skip=0.1)
    return faces.selectExpr("cloud_id", _AXIS, "round(2 * CASE WHEN abs(nx) > 0.99 THEN vertices[0].x WHEN abs(ny) > 0.99 THEN vertices[0].y ELSE vertices[0].z END) / 2 + 0e0 AS offset_m", "split(label, '_')[0] AS kind", "round(nx + ny + nz) + 0e0 AS outward")


@register("voted_clusters")
def voted_clusters(spark, sf_dir):
    """Steep planes of all clouds as one face for each cluster of their inliers."""
    return rounded(voting.ransac_plane_faces(view(spark, sf_dir, "points"), least=100, min_points=10).drop("vertices"))


#: A ring round every cloud, of which one side lies in the open and one is too short.
_RING = "(VALUES (0, 52e-1, -26e-1), (1, 52e-1, 26e-1), (2, -2e0, 26e-1), (3, -2e0, 27e-1), (4, -52e-1, 27e-1), (5, -52e-1, -26e-1), (6, -1e1, -9e0)) AS r(k, x, y)"
EDGES = f"""{PT}, z AS (SELECT cloud_id, quantile_cont(z, 0.05) AS g, quantile_cont(z, 0.95) AS t FROM points GROUP BY cloud_id), h AS (SELECT *, greatest(3e0, t - g) AS h FROM z),
e AS (SELECT k AS edge, x AS ax, y AS ay, coalesce(lead(x) OVER (ORDER BY k), first_value(x) OVER (ORDER BY k)) AS ex, coalesce(lead(y) OVER (ORDER BY k), first_value(y) OVER (ORDER BY k)) AS ey FROM {_RING}),
l AS (SELECT *, sqrt((ex-ax)**2+(ey-ay)**2) AS length FROM e), d AS (SELECT *, (ex-ax)/length AS dx, (ey-ay)/length AS dy, CASE WHEN length >= 1.5 THEN greatest(2, CAST(round_even(length, 0) AS INT)) ELSE 0 END AS samples FROM l),
s AS (SELECT *, length/samples AS pitch, unnest(range(samples)) AS sample FROM d WHERE samples > 0), a AS (SELECT *, ax + (sample+0.5e0)*pitch*dx AS sx, ay + (sample+0.5e0)*pitch*dy AS sy FROM s),
i AS (SELECT p.cloud_id, edge, sample, (x-sx)*(-dy)+(y-sy)*dx AS inward FROM a, points p JOIN h USING (cloud_id) WHERE z > g + 0.2e0*h AND z < t + 1 AND abs((x-sx)*dx+(y-sy)*dy) < 0.6e0*pitch AND (x-sx)*(-dy)+(y-sy)*dx > -0.5e0 AND (x-sx)*(-dy)+(y-sy)*dx < 5e0),
m AS (SELECT cloud_id, edge, median(inward) AS m FROM i GROUP BY cloud_id, edge, sample), n AS (SELECT cloud_id, edge, count(*) AS hits, avg(m) AS m FROM m GROUP BY ALL),
r AS (SELECT z.cloud_id, d.*, CASE WHEN samples > 0 THEN coalesce(hits, 0)/samples ELSE 0e0 END AS hit_rate, n.m, g, t FROM z CROSS JOIN d LEFT JOIN n ON n.cloud_id = z.cloud_id AND n.edge = d.edge)"""


def edge_faces(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("cloud_id", "x", "y", "z")
    ring = spark.sql(f"SELECT array_sort(collect_list(struct(k, x, y))) AS c FROM {_RING}").select(F.transform("c", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring")).first().ring
    rings = p.select("cloud_id").distinct().withColumn("ring", F.array(*[F.struct(F.lit(v.x).alias("x"), F.lit(v.y).alias("y")) for v in ring]))
    return edges.polygon_edge_facades(rings, p)


@register("edge_diagnostics", f"WITH {EDGES} SELECT cloud_id, edge, round(length,6) AS length, samples, round(hit_rate,6)+0 AS hit_rate, round(m,6)+0 AS mean_inward_m, hit_rate < 0.4 AS dropped FROM r")
def edge_diagnostics(spark, sf_dir):
    return rounded(edge_faces(spark, sf_dir)[1])


@register("edge_facades", f"""WITH {EDGES}, w AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY edge) - 1 AS k FROM r WHERE hit_rate >= 0.4)
SELECT cloud_id, CAST(k AS INT) AS facade_index, printf('wall_%02d', k) AS label, '21.1' AS component_tag, round(dy,6)+0 AS nx, round(-dx,6)+0 AS ny, 0e0 AS nz, 4 AS corners, round(ex,6)+0 AS x2, round(ey,6)+0 AS y2, round(t,6) AS z2 FROM w
UNION ALL SELECT cloud_id, CAST((SELECT count(*) FROM w WHERE w.cloud_id = z.cloud_id) AS INT), 'roof', '27.1', 0e0, 0e0, 1e0, 7, -2e0, 2.6e0, round(t,6) FROM z""")
def edge_facades(spark, sf_dir):
    return rounded(edge_faces(spark, sf_dir)[0].select("cloud_id", F.col("facade_index").cast("int").alias("facade_index"), "label", "component_tag", "nx", "ny", "nz", F.size("vertices").alias("corners"), F.col("vertices")[2]["x"].alias("x2"), F.col("vertices")[2]["y"].alias("y2"), F.col("vertices")[2]["z"].alias("z2")))


def augmented(spark, sf_dir):
    w = view(spark, sf_dir, "waypoints").drop("building_id").where("mission_id < 8")
    p = view(spark, sf_dir, "points").select("cloud_id", "point_id", "x", "y", "z")
    # Scan 3 is a corner of a few points: no face; scans of missions above 3 don't exist.
    p = p.where("cloud_id <> 3 or point_id <= 12")
    methods = {"grown": lambda points, rings: augment.grown_faces(points, density=1.0)}
    return augment.augment_missions(w, p, methods=methods)


@register("augmented_missions", f"""WITH {PT}, waypoints AS ({VIEWS['waypoints']}), n AS (SELECT mission_id, count(*) AS n FROM waypoints WHERE mission_id < 8 GROUP BY mission_id)
SELECT mission_id, CASE WHEN mission_id < 3 THEN 'ok' ELSE 'failed' END AS status, CASE mission_id WHEN 3 THEN 'no faces' WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'no scan' END AS reason, n AS waypoints, CASE WHEN mission_id < 3 THEN 5 ELSE 0 END AS faces FROM n""")
def augmented_missions(spark, sf_dir):
    """Missions re-aimed at the faces of their scans; those without go to the status table."""
    return augmented(spark, sf_dir).status.select("mission_id", "status", "reason", "waypoints", "faces")


@register("summary_round_trip", f"WITH {PT}, waypoints AS ({VIEWS['waypoints']}), n AS (SELECT mission_id, count(*) AS n FROM waypoints WHERE mission_id < 8 GROUP BY mission_id) SELECT mission_id, CASE WHEN mission_id < 3 THEN 'ok' ELSE 'failed' END AS status, n AS counted FROM n")
def summary_round_trip(spark, sf_dir):
    """Status rows through JSON documents and back: matched and unmatched rows add up to all."""
    return augment.read_summaries(augment.summaries(augmented(spark, sf_dir).status)).select("mission_id", "status", (F.col("matched") + F.col("unmatched")).alias("counted"))
