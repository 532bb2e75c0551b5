"""Voting, clusters and edge faces against planted fixtures and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import clouds, voting


def frame(spark, parts):
    rows = [(k, i, *map(float, q)) for k, p in parts.items() for i, q in enumerate(p)]
    return spark.createDataFrame(rows, "cloud_id string, point_id long, x double, y double, z double")


def slow_dbscan(xyz, eps, least):
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= eps
    core = near.sum(axis=1) >= least
    label = np.full(len(xyz), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = i
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                label[j] = i
                todo.append(j)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return label


@pytest.mark.parametrize("edge", [3.0, 12.0])
def test_dbscan_against_brute_force(spark, edge):
    rng = np.random.default_rng(2)
    blobs = np.concatenate([rng.normal(c, 0.25, (90, 3)) for c in ((0, 0, 0), (1.4, 0, 0), (-3, 2, 1))] + [rng.random((120, 3)) * 8 - 4, np.tile([[6.0, 6, 6]], (12, 1))])
    other = rng.random((60, 3)) * 2
    df = frame(spark, {"a": blobs, "b": other}).unionByName(spark.createDataFrame([("b", 999, None, 0.0, 0.0)], "cloud_id string, point_id long, x double, y double, z double"))
    got = {(r.cloud_id, r.point_id): r.label for r in clouds.dbscan(df, 0.35, 6, edge).collect()}
    assert len(got) == len(blobs) + len(other) + 1 and got["b", 999] == -1
    for k, xyz in (("a", blobs), ("b", other)):
        assert [got[k, i] for i in range(len(xyz))] == slow_dbscan(xyz, 0.35, 6).tolist()
    assert clouds.dbscan(df.limit(0), 0.35, 6).collect() == []
    # Ids near the ends of 64 bits keep every digit.
    far = df.where("cloud_id = 'b' and x is not null").withColumn("point_id", F.lit(2**62 + 1) + F.col("point_id"))
    assert {r.point_id - 2**62 - 1: (r.label - 2**62 - 1 if r.label >= 0 else -1) for r in clouds.dbscan(far, 0.35, 6, edge).collect()} == {p: v for (k, p), v in got.items() if k == "b" and p < 999}


def wall(rng, n, a, b, height, noise=0.01):
    """Points of an upright wall between two corners."""
    u, v = rng.random((2, n))
    p = np.array(a)[None] * (1 - u[:, None]) + np.array(b)[None] * u[:, None]
    return np.column_stack([p + rng.normal(0, noise, (n, 2)), v * height])


def house(rng, width=12.0, depth=8.0, height=6.0, n=6000):
    c = [(0, 0), (width, 0), (width, depth), (0, depth)]
    walls = [wall(rng, n, c[k], c[(k + 1) % 4], height) for k in range(4)]
    roof = np.column_stack([rng.random((2 * n, 2)) * [width, depth], height + rng.normal(0, 0.01, 2 * n)])
    ground = np.column_stack([rng.random((n, 2)) * [width + 8, depth + 8] - 4, rng.normal(0, 0.01, n)])
    return np.concatenate([*walls, roof, ground])


def test_planes_of_many_clouds_by_voting(spark):
    rng = np.random.default_rng(5)
    gap = np.concatenate([wall(rng, 3000, (0, 0), (5, 0), 5), wall(rng, 3000, (9, 0), (14, 0), 5), rng.random((300, 3)) * [14, 6, 5]])
    df = frame(spark, {"house": house(rng), "gap": gap, "few": rng.random((100, 3)), "noise": rng.random((400, 3)) * 60})
    faces = voting.ransac_plane_faces(df).collect()
    by = {k: [r for r in faces if r.cloud_id == k] for k in ("house", "gap", "few", "noise")}
    assert len(by["house"]) == 4 and not by["few"] and not by["noise"]
    for r in by["house"]:
        n = np.array([r.nx, r.ny, r.nz])
        assert np.abs(n).max() > 0.999 and abs(r.nz) < 0.05 and r.component_tag == "21.1"
        centre = np.mean([(v.x, v.y, v.z) for v in r.vertices], axis=0)
        assert n[:2] @ (centre[:2] - [6, 4]) > 3.5
        long = 12 if abs(n[1]) > 0.9 else 8
        assert abs(r.area - long * 6) < 0.15 * long * 6
    # One plane, two clusters.
    assert sorted(round(np.mean([v.x for v in r.vertices])) for r in by["gap"])[0] < 4 and len(by["gap"]) == 2
    assert [r.facade_index for r in sorted(by["house"], key=lambda r: r.facade_index)] == [0, 1, 2, 3]
    assert voting.ransac_plane_faces(df.limit(0)).collect() == []


def test_wall_lines(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, {"h": house(rng), "few": rng.random((100, 3))})
    faces = sorted(voting.ransac_wall_faces(df).collect(), key=lambda r: r.facade_index)
    assert [r.label for r in faces] == ["wall_0", "wall_1", "wall_2", "wall_3", "roof_0"] and {r.cloud_id for r in faces} == {"h"}
    for r in faces[:4]:
        n = np.array([r.nx, r.ny])
        xs, ys, zs = ([getattr(v, a) for v in r.vertices] for a in "xyz")
        assert np.abs(n).max() > 0.999 and n @ (np.array([np.mean(xs), np.mean(ys)]) - [6, 4]) > 3.5
        length = np.hypot(xs[1] - xs[0], ys[1] - ys[0])
        assert 0.94 < length / (12 if abs(n[1]) > 0.9 else 8) < 1.02 and min(zs) < 0.5 and abs(max(zs) - 6) < 0.1
    roof = faces[4]
    assert roof.component_tag == "27.1" and abs(roof.vertices[0].z - 6) < 0.1 and abs(roof.vertices[1].x - roof.vertices[0].x - 11.5) < 0.5


def test_voting_is_repeatable_and_gives_each_point_one_plane(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, {"h": house(rng, n=1500)}).withColumn("turn_", F.lit("kept"))
    runs = []
    for n in (2, 5):
        planes, inliers = voting.vote(df.repartition(n), threshold=0.05, least=400, voters=3000)
        runs.append((sorted(map(tuple, planes.select("plane_id", "points", F.round("d", 9)).collect())), sorted((r.plane_id, r.point_id) for r in inliers.collect())))
        assert len({p for _, p in runs[-1][1]}) == len(runs[-1][1]) and len(runs[-1][0]) == 6 and sum(x[1] for x in runs[-1][0]) == len(runs[-1][1])
    assert runs[0] == runs[1]
