"""Steps that work in blocks and batches: no pairs leave a task, and the size of a batch changes nothing."""

import numpy as np
import pandas as pd
import pytest

from scanloom.operators import clouds, directions, filters, joins, meshes
from scanloom.sources import missions


def slow(xyz, heading, steep, r, deg):
    gone: set = set()
    for i in range(len(xyz)):
        for j in range(i + 1, len(xyz)):
            off, turn = (xyz[i] - xyz[j]) ** 2, abs(heading[i] - heading[j])
            if i not in gone and j not in gone and np.sqrt(off[0] + off[1] + off[2]) <= r and min(turn, 360 - turn) < deg:
                gone.add(j if steep[i] <= steep[j] else i)
    return gone


@pytest.mark.parametrize("seed", range(6))
def test_poses_are_thinned_a_few_rows_at_a_time(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(clouds, "THIN_ROWS", int(rng.integers(1, 60)))
    monkeypatch.setattr(clouds, "THIN_PAIRS", int(rng.integers(1, 400)))
    parts, want = [], set()
    for block in range(3):
        n = int(rng.integers(1, 250))
        xyz, heading, steep = np.round(rng.random((n, 3)) * [4, 2, 1], seed % 3), rng.integers(0, 360, n) * 1.0, rng.integers(0, 4, n) * 10.0
        parts.append(pd.DataFrame({"cloud_id": 1, "bx": block, "by": 0, "bz": 0, "point_id": block * 1000 + np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "heading_deg": heading, "steep": steep, "own": True}))
        want |= {block * 1000 + k for k in slow(xyz, heading, steep, 0.6, 70.0)}
    got = clouds._thin(pd.concat(parts, ignore_index=True), 0.6, 70.0)
    assert set(got["point_id"]) == want and got["gone"].all()


def test_like_poses_make_no_rows(spark, monkeypatch):
    """Poses flown again and again, in a crowd that lies over many blocks: no table of pairs."""
    monkeypatch.setattr(clouds, "_close_pairs", lambda *a: 1 / 0)
    rng = np.random.default_rng(5)
    xyz = np.repeat(np.round(rng.random((40, 3)) * [9, 3, 1], 1), 10, axis=0)
    heading, pitch = rng.integers(0, 360, 400) * 1.0, rng.integers(-3, 4, 400) * 10.0
    df = spark.createDataFrame([(i, *map(float, xyz[i]), float(heading[i]), float(pitch[i])) for i in range(400)], "point_id int, x double, y double, z double, heading_deg double, gimbal_pitch_deg double").selectExpr("'c' as cloud_id", "*")
    odd = spark.createDataFrame([("c", 900, None, 0.0, 0.0, 1.0, 1.0), ("c", None, 0.0, 0.0, 0.0, 1.0, 1.0), ("c", 901, float("nan"), 0.0, 0.0, 1.0, 1.0)], df.schema)
    got = [r.point_id for r in clouds.dedupe_poses_within(df.unionByName(odd), 0.5, 60.0).collect()]
    assert {901, 900, None} <= set(got)
    assert {i for i in range(400)} - set(got) == slow(xyz, heading, np.abs(pitch), 0.5, 60.0)


def test_rays_are_tested_in_batches(spark):
    """Rays meet the triangles of their cells inside tasks: few rays, many triangles, ids of any type, and no join of both."""
    rng = np.random.default_rng(7)
    tri = rng.random((300, 9)) * np.tile([8, 4, 2], 3)
    faces = spark.createDataFrame([("m", i, *map(float, t)) for i, t in enumerate(tri)], "mesh_id string, fid int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    at, to = rng.random((60, 3)) * [12, 8, 6] - 2, rng.random((60, 3)) * [8, 4, 2]
    way = (to - at) / np.linalg.norm(to - at, axis=1)[:, None]
    rays = spark.createDataFrame([("m", f"r{i}", *map(float, at[i]), *map(float, way[i])) for i in range(60)], "mesh_id string, id string, x double, y double, z double, dx double, dy double, dz double")
    want: set = set()
    for i in range(60):
        e1, e2, o = tri[:, 3:6] - tri[:, :3], tri[:, 6:] - tri[:, :3], at[i] - tri[:, :3]
        p, q = np.cross(way[i], e2), np.cross(o, e1)
        det = (e1 * p).sum(1)
        u, v, t = (o * p).sum(1) / det, (way[i] * q).sum(1) / det, (e2 * q).sum(1) / det
        want |= {(f"r{i}", round(float(x), 7)) for x in t[(u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-9)]}
    hits = meshes.ray_hits(rays, faces)
    assert {(r.id, round(r.t, 7)) for r in hits.collect()} == want and hits.columns == ["mesh_id", "id", "t"]
    box = meshes.box_meshes(spark.createDataFrame([(1, 10.0, 6.0, 4.0, 30.0)], "building_id long, width double, depth double, height double, heading_deg double"))
    down = spark.createDataFrame([(1, 7, 0.1, 0.2, 9.0, 0.0, 0.0, -1.0)], "mesh_id long, id long, x double, y double, z double, dx double, dy double, dz double")
    # A box is one cell: a ray meets a triangle once.
    assert sorted(round(r.t, 9) for r in meshes.ray_hits(down, box).collect()) == [5.0, 9.0]


def test_short_chains_are_walked_many_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(None if m == 3 else m, k, *map(float, np.round(rng.random(3) * 3, 1))) for m in range(30) for k in range(int(rng.integers(1, 40)))]
    got = {(r.mission_id, r.position): r.idx for r in directions.spatial_chain(spark.createDataFrame(rows, "mission_id long, idx int, x double, y double, z double")).collect()}
    assert len(got) == len(rows)
    xyz = {m: np.array([r[2:] for r in rows if r[0] == m]) for m in {r[0] for r in rows}}
    monkeypatch.setattr(directions, "FEW", 0)
    for m, p in xyz.items():
        assert [got[m, k] for k in range(len(p))] == directions._walk(p).tolist()


def test_as_of_windows_run_on(spark):
    """No frame reaches from a row to the end of its mission; equal times are taken by idx."""
    rows = [(1, k, k // 2 * 2.0, float(k), 0.0, 0.0, False) for k in range(6)]
    line = spark.createDataFrame(rows, "mission_id long, idx int, t_s double, x double, y double, z double, is_transition boolean")
    times = spark.createDataFrame([(1, t) for t in (-1.0, 1.0, 2.0, 3.0, 9.0)], "mission_id long, at_s double")
    found = joins.pose_at(line, times)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.at_s: (r.from_idx, r.x) for r in found.collect()} == {-1.0: (0, 0.0), 1.0: (1, 1.5), 2.0: (1, 2.0), 3.0: (3, 3.5), 9.0: (5, 5.0)}


def test_mission_files_are_collected_as_numbers(spark):
    """No text of rows stands in memory for a whole group, and a batch of documents ends by its bytes."""
    w = spark.range(40).selectExpr("id % 2 as mission_id", "int(id div 2) as idx", "52D + id as lat", "5D as lon", "10D as alt", "1D as x", "2D as y", "double(id) as z", "30D as heading_deg", "-10D as gimbal_pitch_deg", "cast(null as double) as gimbal_yaw_deg", "3D as speed_ms", "id % 7 = 0 as is_transition")
    xml = missions.waylines_xml(w, part_rows=6)
    held = [line for line in xml._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert held and not any("wpml" in line for line in held)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    back = missions.parse_waylines(missions.read_archives(missions.archives(xml).withColumnRenamed("mission_id", "archive_id")))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == missions.BATCH_BYTES
    rows = back.collect()
    assert sorted((r.archive_id, r.idx) for r in rows) == [(m, k) for m in (0, 1) for k in range(20)] and all(r.is_transition == ((2 * r.idx + r.archive_id) % 7 == 0) for r in rows)


def test_poses_and_looks_taken_again_are_judged_once(spark, monkeypatch):
    sizes, real = [], joins.within
    spy = lambda a, b, *more: sizes.append((a.count(), b.count())) or real(a, b, *more)
    monkeypatch.setattr(joins, "within", spy)
    monkeypatch.setattr(filters, "within", spy)
    w = spark.range(60).selectExpr("1L as building_id", "1L as mission_id", "int(id) as idx", "double(id % 3) * 2 as x", "0D as y", "3D as z", "id % 2 = 0 as is_transition", "case when id % 6 < 3 then 0 end as facade_index")
    p = spark.range(40).selectExpr("1L as building_id", "double(id % 2) * 0.5 as x", "1D as y", "3D as z")
    face = spark.createDataFrame([(1, 0, 0.0, -1.0, 0.0)], "building_id long, facade_index int, nx double, ny double, nz double")
    got = sorted(r.idx for r in filters.obstructed(w, p, face, 1.5).collect())
    # At x 0 and 2 a point is near; inspection rows of face 0 look at it, but from x 2 aside of their cone of 45 degrees.
    assert got == [r for r in range(60) if r % 3 == 0 and not (r % 2 and r % 6 < 3)] and sizes == [(6, 2)]
    wide = sorted(r.idx for r in filters.obstructed(w, p, face, 2.0, 45.0).collect())
    assert wide == [r for r in range(60) if r % 3 == 0 and not (r % 2 and r % 6 < 3) or r % 3 == 1]
    sizes.clear()
    looks = w.selectExpr("building_id", "idx as id", "x", "y", "z", "0D as tx", "2D as ty", "3D as tz")
    hits = {r.id: r.hits for r in joins.ray_hits(looks, p, "building_id").collect()}
    assert set(hits) == {r for r in range(60) if r % 3 < 2} and set(hits.values()) <= {20, 40} and sizes[0][1] == 2 and sizes[0][0] < 60
