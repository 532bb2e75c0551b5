"""Steps that must not grow in one task or on the driver: broadcasts, running numbers, meshes of many buildings."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom.operators import clouds, directions, filters, generate, joins, meshes, ordering, paths, reports
from scanloom.sources import ply


def buildings(spark, n):
    return spark.range(n).selectExpr("id as building_id", "5D + id % 7 as width", "4D + id % 5 as depth", "3D + id % 3 as height", "double(id * 7 % 360) as heading_deg", "'flat' as roof_type", "0D as roof_pitch_deg")


def test_exploded_tables_are_not_broadcast(spark):
    b = buildings(spark, 20_000)
    w = spark.range(1000).selectExpr("id % 50 as building_id", "id % 50 as mission_id", "cast(id as int) as idx", "double(id % 9) as x", "double(id % 7) as y", "double(id % 5) as z", "false as is_transition")
    faces, mesh = generate.rectangular_facades(b), meshes.box_meshes(b)
    f = faces.select("building_id", "facade_index", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    points = w.withColumnRenamed("building_id", "mesh_id")
    for df in (
        joins.nearest(w, f, "building_id", ["building_id", "idx"], "facade_index"), joins.pick_facade(w, faces).select("idx", "picked"), meshes.surface_distance(points, mesh, ["idx"]),
        meshes.inside_mesh(points, mesh, ["idx"]), meshes.adjacent_faces(mesh),
    ):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_numbers_in_parts_are_those_of_a_window(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 1000 as a", "id * 31 % 17 as b", "if(id % 11 = 0, null, id % 4) as k").withColumn("a", F.when(F.col("a") != 500, F.col("a")))
    want = F.row_number().over(Window.partitionBy("k").orderBy("a", "b"))
    rows = ordering.numbered(df, F.col("k"), ["a", "b"], "n", part_rows=300)
    assert max(r["count"] for r in rows.groupBy("k", "n").count().collect()) == 1
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.withColumn("n", want).collect()))
    assert ordering.numbered(df.where("a is null"), F.col("k"), ["a", "b"], "n", part_rows=3).agg(F.max("n")).first()[0] >= 1


def test_parts_of_a_cloud_are_one_file(spark):
    df = spark.range(1250).selectExpr("id % 2 as cloud_id", "id as point_id", "double(id) as x", "0D as y", "0D as z")
    parts = ply.export_ply(df, part_rows=100)
    assert parts.count() > 8
    whole = [ply.encode(np.zeros((625, 3))) for _ in range(2)]
    assert sorted(map(tuple, ply.whole_sizes(parts).collect())) == [(k, 625, len(w)) for k, w in enumerate(whole)]


def test_equal_zones_are_met_once(spark):
    w = spark.range(40).selectExpr("0 as mission_id", "cast(id as int) as idx", "double(id) as x", "0D as y", "0D as z", "false as is_transition")
    one = [(0, t, c, 0.0, 0.0, 6.0, 2.0, 2.0) for t, c in (("inclusion", 10.0), ("no_fly", 12.0), ("no_inspect", 8.0))]
    z = spark.createDataFrame(one * 50, "mission_id int, zone_type string, center_x double, center_y double, center_z double, size_x double, size_y double, size_z double")
    rows = filters.zone_verdicts(w, z)
    assert [r.idx for r in rows.where("allowed").collect()] == []
    assert [r.idx for r in filters.filter_by_zones(w, z.where("zone_type != 'no_inspect'")).orderBy("idx").collect()] == [7, 8]
    met = [n for n in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in n and "abs(" in n]
    assert met and "Aggregate [mission_id" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_leg_that_grazes_a_corner_is_judged_as_a_whole(spark):
    b = buildings(spark, 1).selectExpr("0L as building_id", "6D as width", "4D as depth", "3D as height", "0D as heading_deg", "'flat' as roof_type", "0D as roof_pitch_deg")
    legs = [(12.100000000000001, -0.09999999999999964, 2.3), (-19.1, 7.100000000000001, 4.7), (-8.0, 0.0, 1.0), (8.0, 0.0, 1.0)]
    w = spark.createDataFrame([(0, 0, i, *p) for i, p in enumerate(legs)], "mission_id long, building_id long, idx int, x double, y double, z double")
    near = meshes.colliding_segments(w, meshes.box_meshes(b), 0.5 - 1e-6, 1e-9)
    through = meshes.through_boxes(near, b, w)
    assert [r.idx for r in near.orderBy("idx").collect()] == [0, 2]
    assert [r.idx for r in through.orderBy("idx").collect()] == [2]


def test_normals_are_computed_once(spark):
    """No filter or column writes the long expression out again: the task's code stayed interpreted, for being too large to compile."""
    plan = meshes.adjacent_faces(meshes.box_meshes(buildings(spark, 50)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") <= 2


def copied(spark, xyz, times):
    """Every place as often as times says, ids dealt across the places."""
    at = np.repeat(np.arange(len(xyz)), times)
    at = np.random.default_rng(5).permutation(at)
    return xyz[at], spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz[at])], "cloud_id long, point_id long, x double, y double, z double")


def pairs_made(monkeypatch):
    sizes, real = [], clouds._close_pairs
    monkeypatch.setattr(clouds, "_close_pairs", lambda p, r: sizes.append(real(p, r).count()) or real(p, r))
    return sizes


def test_copies_make_no_pairs_in_the_ordered_dedup(spark, monkeypatch):
    xyz = np.random.default_rng(1).random((60, 3)) * 4
    p, df = copied(spark, xyz, 40)
    sizes, kept = pairs_made(monkeypatch), []
    for i, q in enumerate(p):
        if all(np.linalg.norm(p[k] - q) > 0.9 for k in kept):
            kept.append(i)
    odd = spark.createDataFrame([(0, None, 1.0, 1.0, 1.0), (0, 9000, None, 1.0, 1.0), (None, 9001, 1.0, 1.0, 1.0)], df.schema)
    got = [r.point_id for r in clouds.greedy_dedupe(df.unionByName(odd), 0.9).collect()]
    assert sorted(i for i in got if i is not None and i < 9000) == kept and {None, 9000, 9001} <= set(got)
    assert sizes[0] <= 60 * 59 / 2


def test_neighbours_of_copies(spark):
    xyz = np.random.default_rng(2).random((40, 3)) * [3, 2, 0.1]
    times = np.random.default_rng(3).integers(1, 12, 40)
    p, df = copied(spark, xyz, times)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = [np.sort(np.delete(d[i], i))[:5].mean() for i in range(len(p))]
    got = {r.point_id: r.mean_d for r in clouds.knn_mean_distance(df, 5).collect()}
    assert sorted(got) == list(range(len(p))) and np.allclose([got[i] for i in range(len(p))], want, atol=1e-12)
    plan = clouds.knn_mean_distance(df, 5)
    assert plan.count() == len(p)
    near = [max(0.01, min(0.5, np.delete(d[i], i).min())) for i in range(len(p))]
    assert abs(clouds.nn_spacing(df).first().nn_m - np.median(near)) < 1e-12


def test_vertices_at_one_place_are_viewed_once(spark):
    xyz = np.random.default_rng(4).normal(size=(80, 3))
    xyz *= np.where(np.arange(80) % 2, 1.0, 0.2)[:, None] / np.linalg.norm(xyz, axis=1)[:, None]
    one = frame_of(spark, xyz)
    many = one.unionByName(one.withColumn("vid", F.col("vid") + 1000)).unionByName(one.withColumn("vid", F.col("vid") + 2000))
    seen = directions.visible_vertices(many, bin_deg=20.0)
    want = {r.vid for r in directions.visible_vertices(one, bin_deg=20.0).collect()}
    assert 0 < len(want) < 80 and sorted(r.vid for r in seen.collect()) == sorted(v + k for v in want for k in (0, 1000, 2000))
    views = [n for n in seen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in n]
    assert views and all("vid" not in n for n in views)


def frame_of(spark, xyz):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "mesh_id long, vid long, x double, y double, z double")


def test_long_paths_add_up(spark):
    rng = np.random.default_rng(3)
    xyz = rng.random((20_000, 3)) * 40
    w = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "mission_id int, idx int, x double, y double, z double")
    rows = paths.with_path(w).orderBy("idx").collect()
    seg = np.array([r.seg_m for r in rows])
    assert all(abs(r.cum_m - math.fsum(seg[: i + 1])) <= math.ulp(r.cum_m) for i, r in enumerate(rows) if i % 500 == 499)
    shots = generate.path_shots(w)
    assert shots.count() == shots.select("shot").distinct().count() == math.ceil(math.fsum(seg) / 0.65)


def test_cameras_and_cells_make_no_rows(spark, monkeypatch):
    def pairs(*args, **more):
        raise AssertionError("cameras and cells were joined as rows")

    monkeypatch.setattr(joins, "within", pairs)
    rng = np.random.default_rng(8)
    xyz = np.repeat(rng.random((400, 3)) * [30, 30, 10], 5, axis=0)
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "building_id int, point_id int, x double, y double, z double")
    cams = [(1, 1, i * 40_000, *map(float, rng.random(3) * [30, 30, 10]), float(i * 18), None, float(-i), False) for i in range(20)]
    w = spark.createDataFrame(cams, "building_id int, mission_id int, idx int, x double, y double, z double, heading_deg double, gimbal_yaw_deg double, gimbal_pitch_deg double, is_transition boolean")
    want = {}
    for _, _, idx, x, y, z, h, _, p, _ in cams:
        h, p = np.radians(h), np.radians(p)
        off = xyz - [x, y, z]
        d = np.sqrt((off**2).sum(axis=1))
        cos = off @ [np.sin(h) * np.cos(p), np.cos(h) * np.cos(p), np.sin(p)] / d
        score = np.where((d > 0.5) & (d <= 20) & (cos >= np.cos(np.pi / 4)), np.round(cos - 0.001 * d / 20, 9), -np.inf)
        if score.max() > -np.inf:
            want[idx] = int(score.argmax())
    assert {r.idx: r.point_id for r in reports.cone_targets(w, points, 20.0).collect()} == want and len(want) > 10


def test_looks_flown_again_are_judged_once(spark, monkeypatch):
    cast, hits = [], meshes.ray_hits
    monkeypatch.setattr(meshes, "ray_hits", lambda rays, faces, *more: cast.append(rays.count()) or hits(rays, faces, *more))
    faces = meshes.box_meshes(buildings(spark, 2))
    looks = spark.range(200).selectExpr("id % 2 as mesh_id", "id as idx", "double(id % 4 * 10 - 15) as x", "0D as y", "1D as z", "0D as tx", "0D as ty", "1D as tz", "0D as ux", "1D as uy", "0D as uz", "0D as vx", "0D as vy", "1D as vz")
    got = meshes.visible_share(looks, faces, ["idx"]).select("idx", "visible").collect()
    assert cast == [4 * 5] and sorted(r.idx for r in got) == list(range(200))
    assert {r.visible for r in got} == {0.0}


def test_copies_of_a_place_cluster_as_one(spark, monkeypatch):
    met, deal = [], clouds.blocks
    monkeypatch.setattr(clouds, "blocks", lambda rows, *more: met.append(rows.count()) or deal(rows, *more))
    df = spark.range(60).selectExpr("0 as cloud_id", "id as point_id", "double(id % 3 * 5) as x", "if(id % 2 = 0, 0D, -0D) as y", "0D as z")
    lone = spark.createDataFrame([(0, 60 + i, 50.0, 0.0, 0.0) for i in range(2)] + [(0, 62, None, 0.0, 0.0)], df.schema)
    got = {r.point_id: r.label for r in clouds.dbscan(df.unionByName(lone), 0.35, 6).collect()}
    assert met == [4] and got == {i: i % 3 for i in range(60)} | {60: -1, 61: -1, 62: -1}


def test_like_poses_of_other_faces_make_no_rows(spark, monkeypatch):
    def pairs(*args, **more):
        raise AssertionError("poses were joined as rows")

    monkeypatch.setattr(joins, "within", pairs)
    rng = np.random.default_rng(5)
    rows = [(int(k), i, int(f), *map(float, p), float(q), float(y)) for i, (k, f, p, q, y) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(-1, 4, 400), rng.integers(0, 60, (400, 3)) / 10, rng.integers(-60, 1, 400), rng.integers(-180, 180, 400), strict=True))]
    rows += [(k, 1000 + i, f + 1, x, y, z, p, q) for k, i, f, x, y, z, p, q in rows[:50]] + [(0, 2000, 3, 1.0, 1.0, None, 0.0, 0.0)]
    w = spark.createDataFrame(rows, "mission_id int, idx int, facade_index int, x double, y double, z double, gimbal_pitch_deg double, gimbal_yaw_deg double")
    turn = lambda a, b: min(abs(a - b), 360 - abs(a - b))
    full = [r for r in rows if r[5] is not None]
    want = {(a[0], a[1]) for a in full if any(a[0] == b[0] and a[2] > b[2] and np.sqrt((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) <= 1.5 and abs(a[6] - b[6]) <= 20 and turn(a[7], b[7]) <= 20 for b in full)}
    got = [tuple(r) for r in joins.cross_facade_duplicates(w).collect()]
    assert set(got) == want and len(got) == len(want) > 50
