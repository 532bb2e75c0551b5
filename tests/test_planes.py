"""Planes to faces against planted boxes and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import clouds, planes
from scanloom.operators import quantiles as Q

PLANE = "cloud_id int, plane_id int, points int, nx double, ny double, nz double, cx double, cy double, cz double"


@pytest.mark.parametrize("buckets", [3, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=2000), "b": np.round(rng.random(300), 1), "c": np.array([5.0]), "d": np.full(50, 2.5), "e": np.array([1.0, 9.0]), "f": np.concatenate([np.zeros(900), [1e9]])}
    shares = {"a": [0.0, 0.031, 0.5, 0.97, 1.0], "b": [0.2], "c": [0.0, 1.0], "d": [0.3], "e": [0.25, 0.5], "f": [0.5, 0.999, 1.0], "none": [0.5]}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None)]
    got = {r.k: r.quantiles for r in Q.group_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", spark.createDataFrame(list(shares.items()), "k string, shares array<double>")).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert np.allclose(got[k], np.quantile(own, shares[k]), rtol=0, atol=1e-9), k


def slow_groups(rows, degrees):
    leads, out = [], {}
    for plane_id, n in sorted(rows):
        hit = next((k for k, m in leads if abs(np.dot(n, m)) >= np.cos(np.radians(degrees))), None)
        if hit is None:
            leads.append((plane_id, n))
        out[plane_id] = plane_id if hit is None else hit
    return out


def test_snap_and_merge(spark):
    rng = np.random.default_rng(3)
    n = rng.normal(size=(60, 3))
    n[30:] = n[:30] * rng.choice([-1, 1], (30, 1)) + rng.normal(size=(30, 3)) * 0.06
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c, w = rng.random((60, 3)) * 5, rng.integers(50, 500, 60)
    df = spark.createDataFrame([(1, i, int(w[i]), *map(float, n[i]), *map(float, c[i])) for i in range(60)] + [(2, 0, 70, 0.0, 0.0, 1.0, 1.0, 2.0, 3.0), (None, 0, 70, 0.0, 0.0, 1.0, 1.0, 2.0, 3.0)], PLANE)
    rows = planes.snap_parallel(df).collect()
    want = slow_groups([(i, n[i]) for i in range(60)], 5.0)
    got = {r.plane_id: r for r in rows if r.cloud_id == 1}
    assert {k: r.group_id for k, r in got.items()} == want and len(rows) == 61
    for g in set(want.values()):
        own = [i for i in want if want[i] == g]
        mean = sum(n[i] * w[i] * (1 if n[i] @ n[g] >= 0 else -1) for i in own)
        mean /= np.linalg.norm(mean)
        for i in own:
            assert np.allclose([got[i].nx, got[i].ny, got[i].nz], mean) and abs(got[i].d - mean @ c[i]) < 1e-9
    assert planes.snap_parallel(df.limit(0)).collect() == []
    wall = lambda i, d, points: (1, i, points, 0.0, 1.0, 0.0, 0.0, d, 0.0)
    df = spark.createDataFrame([wall(0, 0.0, 100), wall(1, 0.09, 100), wall(2, 0.14, 300), wall(3, 0.25, 50), wall(4, 0.5, 300), wall(5, 0.5, 300)], PLANE)
    got = sorted((r.plane_id, r.points, round(r.d, 6), tuple(r.members)) for r in planes.merge_coplanar(planes.snap_parallel(df)).collect())
    # 0 and 1 meet at 0.045, 2 comes within 0.1 of that; the mean is then 0.102, too far from 3.
    assert got == [(2, 500, 0.102, (0, 1, 2)), (3, 50, 0.25, (3,)), (4, 600, 0.5, (4, 5))]
    inliers = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(6)], "cloud_id int, plane_id int, x double, y double, z double")
    moved = planes.relabel(inliers, planes.merge_coplanar(planes.snap_parallel(df))).collect()
    assert sorted((r.x, r.plane_id) for r in moved) == [(0, 2), (1, 2), (2, 2), (3, 3), (4, 4), (5, 4)]


def box_points(rng, n, width, depth, height, turn=0.0, shift=(0.0, 0.0, 0.0), noise=0.004):
    """Points of four walls and a roof, turned about the vertical."""
    u, v = rng.random((2, n))
    side = rng.integers(0, 5, n)
    x = np.choose(side, [u * width, np.full(n, width), u * width, np.zeros(n), u * width])
    y = np.choose(side, [np.zeros(n), u * depth, np.full(n, depth), u * depth, v * depth])
    z = np.choose(side, [v * height] * 4 + [np.full(n, height)])
    p = np.column_stack([x - width / 2, y - depth / 2, z]) + rng.normal(0, noise, (n, 3))
    c, s = np.cos(turn), np.sin(turn)
    return np.column_stack([p[:, 0] * c - p[:, 1] * s, p[:, 0] * s + p[:, 1] * c, p[:, 2]]) + np.array(shift)


@pytest.mark.parametrize("shift", [(0.0, 0.0, 0.0), (412_345.0, 5_812_345.0, 57.0)])
def test_box_to_five_faces(spark, shift):
    """A planted box, also far from the origin: five faces, offsets and sizes within 5 cm."""
    rng = np.random.default_rng(7)
    p = box_points(rng, 40_000, 12.0, 8.0, 6.0, 0.4, shift)
    df = spark.createDataFrame([(3, i, *map(float, q)) for i, q in enumerate(p)], "cloud_id int, point_id long, x double, y double, z double")
    regions = clouds.plane_regions(df, epsilon=0.02)
    found = clouds.planes_of(regions)
    inliers = clouds.plane_inliers(df, found, regions, epsilon=0.02)
    assert inliers.count() > 0.99 * len(p)
    faces = planes.as_facades(planes.oriented_rectangles(planes.snap_parallel(found.drop("d", "rms", "region")), inliers, trim=0.0)).collect()
    assert sorted(r.label for r in faces) == ["roof_0", "wall_0", "wall_1", "wall_2", "wall_3"] and sorted(r.facade_index for r in faces) == list(range(5))
    c, s = np.cos(0.4), np.sin(0.4)
    for r in faces:
        n = np.array([r.nx * c + r.ny * s, -r.nx * s + r.ny * c, r.nz])
        assert np.abs(n).max() > 0.9999 and abs(np.linalg.norm(n) - 1) < 1e-9
        axis = int(np.abs(n).argmax())
        centre = np.array([r.cx, r.cy, r.cz]) - np.array(shift)
        out = np.array([centre[0] * c + centre[1] * s, -centre[0] * s + centre[1] * c, centre[2]])
        assert out[axis] * n[axis] > 0 and abs(abs(out[axis]) - (6.0, 4.0, 6.0)[axis]) < 0.05
        want = ((8.0, 6.0), (12.0, 6.0), (12.0, 8.0))[axis]
        slack = 0.05 if axis < 2 else 0.2  # a roof's directions are those of its spread, a degree or so off
        assert abs(r.width - want[0]) < slack and abs(r.height - want[1]) < slack
        assert r.component_tag == ("27.1" if r.label == "roof_0" else "21.1")


def test_gates_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    flat = lambda k, n, w, h, z=0.0: [(1, k, float(a * w), float(b * h), z) for a, b in rng.random((n, 2))]
    rows = flat(0, 2000, 4, 3, 5.0) + flat(1, 40, 4, 3, 1.0) + flat(2, 200, 0.5, 0.5, 2.0) + [(1, 0, float("nan"), 1.0, 1.0), (1, 0, None, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "cloud_id int, plane_id int, x double, y double, z double").withColumn("u", F.lit("clash"))
    given = spark.createDataFrame([(1, k, 0.0, 0.0, 1.0) for k in range(4)], "cloud_id int, plane_id int, nx double, ny double, nz double")
    got = planes.oriented_rectangles(given, pts).collect()
    # Plane 1 is too thin, 2 too small, 3 has no points.
    assert [(r.plane_id, r.points, r.kind) for r in got] == [(0, 2000, "roof")]
    area = 12.0
    q = 5.0 * (0.4 + 0.6 * area / 20) / 100
    assert abs(got[0].width - 4 * (1 - 2 * q)) < 0.1 and abs(got[0].height - 3 * (1 - 2 * q)) < 0.1
    assert planes.oriented_rectangles(given, pts.limit(0)).collect() == []
