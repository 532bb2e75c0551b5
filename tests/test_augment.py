"""Batch re-aim, fallbacks and edge faces on planted houses."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_voting import frame, house

from scanloom.operators import augment, edges

W = "mission_id string, idx int, x double, y double, z double, heading_deg double, gimbal_pitch_deg double, gimbal_yaw_deg double, speed_ms double, is_transition boolean, facade_index int"


def test_missions_with_and_without_scans(spark):
    rng = np.random.default_rng(3)
    p = frame(spark, {"a": house(rng, n=8000), "b": house(rng, 10, 6, 5, n=8000) + [100, 50, 0], "dust": rng.random((30, 3)), "nobody": house(rng, n=500)})
    at = {"a": (6, 4), "b": (105, 53), "dust": (0, 0), "none": (0, 0)}
    rows = [(m, i, x + 20 * math.sin(i), y + 20 * math.cos(i), 4.0, 10.0, 0.0, 5.0, 9.0, i == 3, -1) for m, (x, y) in at.items() for i in range(6)] + [("a", 6, 500.0, 500.0, 4.0, 10.0, -7.0, 5.0, 9.0, False, -1)]
    done = augment.augment_missions(spark.createDataFrame(rows, W), p, methods={"grown": lambda q, r: augment.grown_faces(q, epsilon=0.03)})
    status = {r.mission_id: r for r in done.status.collect()}
    assert {m: (r.status, r.reason, r.waypoints) for m, r in status.items()} == {"a": ("ok", None, 7), "b": ("ok", None, 6), "dust": ("failed", "no faces", 6), "none": ("failed", "no scan", 6)}
    assert status["a"].faces >= 5 and status["a"].matched == 5 and status["dust"].matched == 0
    faces = {(r.building_id, r.facade_index): r for r in done.facades.collect()}
    got = {(r.mission_id, r.idx): r for r in done.waypoints.collect()}
    assert {m for m, _ in got} == {"a", "b"} and len(got) == 13 and all(r.speed_ms == 3.0 for r in got.values())
    for (m, i), r in got.items():
        if i == 3 or i == 6:  # transit, and too far from every face: the look stays
            assert r.facade_index == -1 and r.gimbal_yaw_deg == 5.0
            continue
        f = faces[m, r.facade_index]
        assert f.nx * (r.x - f.cx) + f.ny * (r.y - f.cy) + f.nz * (r.z - f.cz) > 0
        yaw = math.degrees(math.atan2(f.cx - r.x, f.cy - r.y))
        assert abs((r.gimbal_yaw_deg - yaw + 180) % 360 - 180) < 1e-6
    docs = augment.read_summaries(augment.summaries(done.status.withColumn("mission_id", F.crc32("mission_id")))).collect()
    assert sum(r.matched + r.unmatched for r in docs) == len(rows)


def test_fallbacks_and_rings(spark):
    """Clouds go to the next method until one finds enough; the last takes what it finds. Faces outside the ring go."""
    rng = np.random.default_rng(4)
    p = frame(spark, {"a": house(rng, n=2500), "b": rng.random((60, 3)) * [4, 4, 6]})
    face = lambda q, n: q.select("cloud_id").distinct().withColumn("facade_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("cloud_id", "facade_index", F.lit("l").alias("label"), F.lit("t").alias("component_tag"), *[F.lit(1.0).alias(c) for c in ("nx", "ny", "nz")], F.array(F.struct(*[F.col("facade_index").cast("double").alias(a) for a in "xyz"])).alias("vertices"))
    seen = []

    def method(n, only=None):
        def run(q, rings):
            seen.append(sorted(r.cloud_id for r in q.select("cloud_id").distinct().collect()))
            return face(q if only is None else q.where(F.col("cloud_id") == only), n)

        return run

    got = augment.extract_faces(p, methods={"one": method(2), "two": method(3, "a"), "three": method(1)}).groupBy("building_id", "method").count().collect()
    assert seen == [["a", "b"], ["a", "b"], ["b"]] and {tuple(r) for r in got} == {("a", "two", 3), ("b", "three", 1)}
    rings = spark.createDataFrame([("a", [(-1.0, -1.0), (0.4, -1.0), (0.4, 0.4), (-1.0, 0.4)])], "cloud_id string, ring array<struct<x:double,y:double>>")
    got = augment.extract_faces(p, rings, methods={"two": method(3)}, margin=0.3).collect()
    assert sorted((r.building_id, r.facade_index) for r in got) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]
    walls = augment.extract_faces(p.where("cloud_id = 'a'"), methods={"edges": augment.METHODS["edges"]}).collect()
    assert {r.component_tag for r in walls} == {"21.1", "27.1"} and len(walls) >= 5


def test_poses_move_scans(spark):
    p = frame(spark, {"a": [[1, 2, 3]], "b": [[1, 2, 3]]})
    m = [0.0, -1.0, 0.0, 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    got = {r.cloud_id: (r.x, r.y, r.z, r.point_id) for r in augment.apply_poses(p, spark.createDataFrame([("a", m)], "cloud_id string, m array<double>")).collect()}
    assert got == {"a": (8.0, 1.0, 2.0, 0), "b": (1.0, 2.0, 3.0, 0)}


def test_versions_newest_first(spark):
    rows = [(1, 1, 5), (1, 2, 9), (1, 3, 9), (2, 1, 7)]
    got = augment.ordered_versions(spark.createDataFrame(rows, "mission_id int, version_id int, ts int")).collect()
    assert [(r.mission_id, r.version_id, r.age) for r in got] == [(1, 3, 0), (1, 2, 1), (2, 1, 0), (1, 1, 2)]


def slow_edges(ring, pts):
    g, t = np.percentile(pts[:, 2], [5, 95])
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    ring = ring[::-1] if area < 0 else ring
    out = []
    for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
        a, b = np.array(a), np.array(b)
        length = np.linalg.norm(b - a)
        if length < 1.5:
            out.append((k, 0.0, None))
            continue
        d, n = (b - a) / length, max(2, round(length))
        inward, step, hit = np.array([-d[1], d[0]]), length / n, []
        for i in range(n):
            rel = pts[:, :2] - (a + (i + 0.5) * step * d)
            own = (rel @ inward > -0.5) & (rel @ inward < 5) & (abs(rel @ d) < 0.6 * step) & (pts[:, 2] > g + 0.2 * max(3.0, t - g)) & (pts[:, 2] < t + 1)
            if own.any():
                hit.append(np.median((rel @ inward)[own]))
        out.append((k, len(hit) / n, np.mean(hit) if hit else None))
    return out


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pts = house(rng, n=700)
    ring = [(-0.3, -0.2), (-0.3, 8.3), (12.2, 8.1), (12.4, 7.0), (30.0, 6.0), (12.1, -0.4)]
    r = spark.createDataFrame([("a", [*ring, ring[0]]), ("none", ring), ("thin", ring[:2])], "cloud_id string, ring array<struct<x:double,y:double>>")
    faces, found = edges.polygon_edge_facades(r, frame(spark, {"a": pts, "other": pts}))
    got = sorted(found.collect(), key=lambda x: x.edge)
    want = slow_edges(ring, pts)
    assert {x.cloud_id for x in got} == {"a"} and [x.edge for x in got] == [w[0] for w in want]
    for x, w in zip(got, want, strict=True):
        assert abs(x.hit_rate - w[1]) < 1e-12 and x.dropped == (w[1] < 0.4) and (w[2] is None) == (x.mean_inward_m is None) and (w[2] is None or abs(x.mean_inward_m - w[2]) < 1e-9)
    labels = [f.label for f in sorted(faces.collect(), key=lambda f: f.facade_index)]
    assert labels == [*(f"wall_{i:02d}" for i in range(sum(w[1] >= 0.4 for w in want))), "roof"] and any(w[1] < 0.4 for w in want)
