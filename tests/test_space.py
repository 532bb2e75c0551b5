"""Clouds, meshes and zones against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import clouds, filters, meshes, reports


def kept_in_order(xyz, r):
    kept = []
    for i, p in enumerate(xyz):
        if not kept or np.sqrt(((np.array([xyz[k] for k in kept]) - p) ** 2).sum(axis=1)).min() > r:
            kept.append(i)
    return kept


def frame(spark, xyz, cloud=0):
    return spark.createDataFrame([(cloud, i, *map(float, p)) for i, p in enumerate(xyz)], "cloud_id long, point_id long, x double, y double, z double")


def test_dedupe_of_a_zigzag_across_both_axes(spark):
    """65,535 points that cross x = 0 and y = 0 at every step, each near the one before."""
    k = np.arange(65_535)
    p = np.column_stack([np.where(k % 2, 0.3, -0.3), np.where(k // 2 % 2, 0.3, -0.3), k * 1.0])
    got = sorted(r.point_id for r in clouds.greedy_dedupe(frame(spark, p), 1.5).collect())
    assert got == list(range(0, 65_535, 2))


def slow_scan(xyz, heading, pitch, r, deg):
    gone = set()
    for i in range(len(xyz)):
        for j in range(i + 1, len(xyz)):
            turn = abs(heading[i] - heading[j])
            if np.linalg.norm(xyz[i] - xyz[j]) <= r and min(turn, 360 - turn) < deg and not {i, j} & gone:
                gone.add(j if abs(pitch[i]) <= abs(pitch[j]) else i)
    return sorted(set(range(len(xyz))) - gone)


@pytest.mark.parametrize("r", [0.2, 0.7])
def test_poses_within_a_radius_in_pair_order(spark, r):
    rng = np.random.default_rng(4)
    xyz, heading, pitch = (rng.random((350, 3)) - 0.5) * [6, 2, 1], rng.integers(0, 360, 350) * 1.0, rng.integers(-3, 4, 350) * 10.0
    df = spark.createDataFrame([(9, i, *map(float, xyz[i]), float(heading[i]), float(pitch[i])) for i in range(350)], "cloud_id int, point_id int, x double, y double, z double, heading_deg double, gimbal_pitch_deg double")
    assert sorted(x.point_id for x in clouds.dedupe_poses_within(df, r, 90.0).collect()) == slow_scan(xyz, heading, pitch, r, 90.0)
    assert clouds.dedupe_poses_within(df.limit(0), r).collect() == []


def test_dedupe_of_a_long_chain_and_of_a_dense_cloud(spark):
    chain = np.column_stack([np.arange(4000), np.zeros(4000), np.zeros(4000)])
    got = sorted(r.point_id for r in clouds.greedy_dedupe(frame(spark, chain), 1.5).collect())
    assert got == list(range(0, 4000, 2))
    rng = np.random.default_rng(2)
    dense = rng.random((600, 3)) * 4
    got = sorted(r.point_id for r in clouds.greedy_dedupe(frame(spark, dense), 0.6).collect())
    assert got == kept_in_order(dense, 0.6)
    assert clouds.greedy_dedupe(frame(spark, dense).limit(0), 0.6).collect() == []


def test_neighbours_however_far(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.random((60, 3)), [[40.0, 0, 0]], [[0, 90.0, 0]]])
    got = {r.point_id: r.mean_d for r in clouds.knn_mean_distance(frame(spark, xyz).unionByName(frame(spark, xyz[:3], 1)), 5, 0.3).where("cloud_id = 0").collect()}
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    for i in range(len(xyz)):
        assert got[i] == pytest.approx(np.sort(d[i])[1:6].mean())
    assert clouds.knn_mean_distance(frame(spark, xyz[:3], 1), 5, 0.3).count() == 3
    assert clouds.knn_mean_distance(frame(spark, xyz[:1]), 5, 0.3).count() == 0


def test_sampling_by_threshold_is_the_first_by_hash(spark):
    p = frame(spark, np.random.default_rng(1).random((3000, 3)))
    mark = F.md5(F.concat_ws("|", "cloud_id", "point_id"))
    want = {r.point_id for r in p.orderBy(mark).limit(50).collect()}
    assert {r.point_id for r in clouds.spacing_sample(p, 50).collect()} == want


def box(spark, w=4.0, d=2.0, h=3.0, heading=0.0):
    return meshes.box_meshes(spark.createDataFrame([(1, w, d, h, heading)], "building_id long, width double, depth double, height double, heading_deg double"))


def test_rays_through_sides_and_corners_count_once(spark):
    """Heights and depths of the box's own sides and diagonals."""
    rows = [(1, k, x, y, z) for k, (x, y, z) in enumerate([(0.0, 0.0, 1.5), (-3.0, 0.0, 1.5), (0.0, 0.5, 0.75), (0.0, -0.5, 2.25), (-5.0, 1.0, 0.0), (-5.0, -1.0, 3.0), (0.0, 0.0, 3.0001), (1.9, 0.9, 2.9), (5.0, 0.0, 1.0), (0.0, 0.0, 1e-7)])]
    p = spark.createDataFrame(rows, "mesh_id long, id int, x double, y double, z double")
    got = {r.id: r.inside for r in meshes.inside_mesh(p, box(spark), ["id"]).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False, 9: True}


def test_first_hits_equal_a_test_of_all_faces(spark):
    rng = np.random.default_rng(6)
    tri = rng.random((400, 1, 3)) * 20 + rng.normal(0, 0.8, (400, 3, 3))
    faces = spark.createDataFrame([(1, f, *map(float, t.ravel())) for f, t in enumerate(tri)], "mesh_id long, fid int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    o = rng.random((60, 3)) * 30 - 5
    d = tri[:60].mean(axis=1) - o
    d[:6] = np.concatenate([np.eye(3), -np.eye(3)])
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    rays = spark.createDataFrame([(1, i, *map(float, o[i]), *map(float, d[i])) for i in range(60)], "mesh_id long, id int, x double, y double, z double, dx double, dy double, dz double")
    t = meshes.ray_distance(("x", "y", "z"), ("dx", "dy", "dz"))
    want = {r.id: r.hit for r in rays.join(faces, "mesh_id").groupBy("id").agg(F.min(t).alias("hit")).collect()}
    got = {r.id: r.hit for r in meshes.first_hits(rays, faces, ["id"]).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 20


def test_samples_are_dealt_by_area(spark):
    s = meshes.surface_samples(box(spark, 40.0, 0.01, 3.0), 57).collect()
    assert len(s) == 57


def test_polygon_zones(spark):
    w = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.0, False), (1, 1, 3.5, 3.5, 5.0, False), (1, 2, 9.0, 9.0, 5.0, False)], "mission_id long, idx int, x double, y double, z double, is_transition boolean")
    shape = "mission_id long, zone_type string, center_x double, center_y double, center_z double, size_x double, size_y double, size_z double, polygon array<struct<x:double,y:double>>"
    zone = lambda ring: spark.createDataFrame([(1, "no_fly", 2.0, 2.0, 5.0, 4.0, 4.0, 10.0, ring)], shape)
    ids = lambda z: [r.idx for r in filters.filter_by_zones(w, z).orderBy("idx").collect()]
    assert ids(zone([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])) == [1, 2]
    assert ids(zone(None)) == ids(zone([(0.0, 0.0)])) == ids(zone(None).drop("polygon")) == [2]


def test_cone_targets_are_the_best_of_all_points(spark):
    rng = np.random.default_rng(9)
    xyz = rng.random((3000, 3)) * [20, 20, 6]
    points = frame(spark, xyz).withColumnRenamed("cloud_id", "building_id")
    cams = [(0, 0, i, *map(float, rng.random(3) * [30, 30, 10] - 5), float(rng.random() * 360), None, float(rng.random() * 100 - 70), False) for i in range(40)]
    w = spark.createDataFrame(cams, "building_id long, mission_id long, idx int, x double, y double, z double, heading_deg double, gimbal_yaw_deg double, gimbal_pitch_deg double, is_transition boolean")
    want = {}
    for c in cams:
        h, p = np.radians(c[6]), np.radians(c[8])
        v = np.array([np.sin(h) * np.cos(p), np.cos(h) * np.cos(p), np.sin(p)])
        e = xyz - np.array(c[3:6])
        n = np.linalg.norm(e, axis=1)
        cos = e @ v / n
        ok = (n > 0.5) & (n <= 15) & (cos >= np.cos(np.radians(45)))
        if ok.any():
            want[c[2]] = int(np.where(ok, np.round(cos - 0.001 * n / 15, 9), -9).argmax())
    assert {r.idx: r.point_id for r in reports.cone_targets(w, points, 15.0).collect()} == want


@pytest.mark.parametrize("pairs", [50, 2_000_000])
def test_neighbours_and_normals_against_brute_force(spark, monkeypatch, pairs):
    """A plane, a dense clump, a far row and repeated places, some clouds smaller than k; few or many pairs at a time."""
    from scanloom.operators import neighbours

    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    flat = np.column_stack([rng.random((500, 2)) * 8 - 4, rng.normal(0, 0.003, 500)])
    clump = rng.normal(0, 0.01, (200, 3)) + [1, 1, 3]
    xyz = np.concatenate([flat, clump, [[500.0, -300.0, 40.0]], np.tile([[2.0, 2.0, 9.0]], (9, 1))])
    df = frame(spark, xyz).unionByName(frame(spark, xyz[:4], 1)).unionByName(frame(spark, xyz[:1], 2)).unionByName(frame(spark, [[np.nan, 0, 0]], 1).withColumn("point_id", F.lit(99).cast("long")))
    got = {(r.cloud_id, r.point_id): r for r in neighbours.mean_distances(df.withColumn("n", F.lit(1)), 7).collect()}
    d = np.sort(np.linalg.norm(xyz[:, None] - xyz[None], axis=2), axis=1)[:, 1:]
    assert len(got) == len(xyz) + 4 and all(abs(got[0, i].mean_d - d[i, :7].mean()) < 1e-9 for i in range(len(xyz)))
    four = np.sort(np.linalg.norm(xyz[:4, None] - xyz[None, :4], axis=2), axis=1)[:, 1:]
    assert all(abs(got[1, i].mean_d - four[i].mean()) < 1e-9 for i in range(4))
    normals = {r.point_id: r for r in neighbours.estimate_normals(frame(spark, xyz), 12).collect()}
    assert all(abs(np.sqrt(r.nx**2 + r.ny**2 + r.nz**2) - 1) < 1e-9 for r in normals.values())
    assert sum(normals[i].nz > 0.99 for i in range(500)) > 490
    assert neighbours.estimate_normals(df.limit(0)).collect() == []
