"""Faces and candidates from the regions of meshes; hulls of many keys in one call."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from scanloom.operators import clouds, graph, groups, meshes, surface

TRI = "mesh_id long, fid long, v0 long, v1 long, v2 long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def triangles(v, t, mesh=1, base=0, turned=()):
    """Rows of TRI; triangles whose number is in ``turned`` are wound the other way."""
    return [(mesh, base + i, *(base + k for k in x), *(float(c) for k in x for c in v[k])) for i, x in enumerate(tuple(x[::-1]) if i in turned else x for i, x in enumerate(t))]


def box(x, mesh=1, base=0, turned=()):
    v = [(x + sx, sy, z) for z in (0, 3) for sx, sy in ((-2, -2), (2, -2), (2, 2), (-2, 2))]
    return triangles(v, meshes.BOX, mesh, base, turned)


def test_faces_and_candidates_of_a_tent(spark):
    v = [(-4, -3, 0), (4, -3, 0), (4, 3, 0), (-4, 3, 0), (-4, -3, 3), (4, -3, 3), (4, 3, 3), (-4, 3, 3), (-4, 0, 5), (4, 0, 5)]
    t = [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7), (4, 5, 9), (4, 9, 8), (6, 7, 8), (6, 8, 9), (0, 2, 1), (0, 3, 2)]
    rows = triangles(v, t, turned=(0, 1, 8, 9))  # a wall and a slope are wound inwards
    rows += triangles([(-0.5, -0.4, 1), (0.5, -0.4, 1), (0.5, 0.4, 1)], [(0, 1, 2)], base=100)  # 0.4 square metres: a candidate
    rows += triangles([(-0.5, -0.2, 2), (0, -0.2, 2), (0, 0.3, 2)], [(0, 1, 2)], base=200)  # too small for one
    rows += triangles([(0, 0, 0), (9, 0, 0), (0, 9, 0)], [(0, 1, 2)], mesh=2)  # a mesh of one triangle
    got = {r.label: r for r in surface.region_facades(spark.createDataFrame(rows, TRI)).collect()}
    assert sorted(got) == ["candidate_roof_flat_0 (normal, 48.0m²)", "candidate_roof_flat_1 (area, 0.4m²)", "east_wall_1", "north_wall_2", "roof_N_34deg_5", "roof_S_34deg_4", "south_wall_0", "west_wall_3"]
    kept = sorted((r for r in got.values() if r.reject_reason is None), key=lambda r: r.facade_index)
    assert [r.facade_index for r in kept] == list(range(6)) and [r.component_tag for r in kept] == ["21.1"] * 4 + ["47.1"] * 2
    assert got["south_wall_0"].ny < -0.999 and got["roof_S_34deg_4"].ny < -0.5 and got["roof_S_34deg_4"].nz > 0.8
    assert all(len(r.vertices) == 4 for r in kept)
    assert {(round(p.x, 6), round(p.y, 6), round(p.z, 6)) for p in got["roof_S_34deg_4"].vertices} == {(-4, -3, 3), (4, -3, 3), (-4, 0, 5), (4, 0, 5)}


def test_walls_that_look_into_the_mesh_are_candidates(spark):
    """Two boxes a metre apart: the walls between them turn away from the middle of the mesh, into their box."""
    got = surface.region_facades(spark.createDataFrame(box(0) + box(5, base=100), TRI)).collect()
    inner = {(r.region, r.label) for r in got if r.reject_reason == "envelope"}
    assert inner == {(2, "candidate_interior_1 (envelope)"), (106, "candidate_interior_8 (envelope)")}
    assert sorted(r.facade_index for r in got if r.reject_reason is None) == list(range(8))
    assert sorted((r.region, r.facade_index) for r in got if r.reject_reason == "normal") == [(10, 0), (110, 1)]


def test_hidden_vertices_count_in_large_meshes(spark, monkeypatch):
    """A box in a box, with few triangles taken as many: the inner one's sides are hidden."""
    v = [(sx, sy, z) for z in (1, 2) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    monkeypatch.setattr(surface, "HIDDEN_FACES", 20)
    monkeypatch.setattr(surface.directions, "visible_vertices", lambda p: p.where("vid < 100").select("mesh_id", "vid"))
    got = surface.region_facades(spark.createDataFrame(box(0) + triangles(v, meshes.BOX, base=100), TRI)).collect()
    assert {r.region: r.reject_reason for r in got} == {0: None, 2: None, 4: None, 6: None, 8: None, 10: "normal", **dict.fromkeys((100, 102, 104, 106, 108), "occlusion"), 110: "normal"}


def test_the_query_has_the_whole_method(spark):
    sf = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()["mesh_regions"](spark, sf)
    assert {"label", "component_tag", "facade_index", "reject_reason", "corners"} <= set(got.columns)
    n = got.groupBy("mesh_id").agg(F.count_if(F.expr("reject_reason is null")).alias("k"), F.count_if(F.expr("reject_reason = 'normal'")).alias("c")).select("k", "c").distinct().collect()
    assert [tuple(r) for r in n] == [(5, 1)]


def test_groups_are_whole_in_every_call(spark):
    """Groups longer than a batch, shorter ones, and a null key come whole, and many at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(5000).selectExpr("case when id < 700 then 7 when id < 710 then null else id % 600 end as k", "id")
        out = groups.by_key(df, ["k"], lambda p: p.groupby("k", dropna=False).agg(n=("id", "size"), rows=("id", lambda s: len(p))).reset_index(), "k long, n long, rows long", ("id",)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert len(out) == len(want) and {None if r.k is None else r.k: r.n for r in out} == want and max(r.rows for r in out if r.k != 7) > 20


def test_hulls_of_many_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k in range(900) for x, y in np.round(rng.random((int(rng.integers(1, 12)), 2)), 1)]
    df = spark.createDataFrame(rows, "cloud_id long, x double, y double").repartition(5)
    got: dict = {}
    for r in clouds.convex_hulls(df).orderBy("cloud_id", "seq").collect():
        got.setdefault(r.cloud_id, []).append((r.x, r.y))
    for k in range(900):
        want = clouds.hull(np.array([r[1:] for r in rows if r[0] == k]))
        assert got.get(k, []) == ([tuple(p) for p in want.tolist()] if len(want) >= 3 else [])


def test_components_are_settled_where_they_lie(spark, monkeypatch):
    """Chains over the borders of groups, groups by themselves and loops; without a node of two groups nothing is contracted in rounds."""
    rng = np.random.default_rng(3)
    rows = [(int(a) // 50, int(a), int(a) + 1) for a in range(0, 900) if a % 90 < 80] + [(int(a) // 50, int(a), int(a)) for a in range(2000, 2100)]
    rows += [(int(a) // 50, int(a), int(b)) for a, b in rng.integers(3000, 3400, (150, 2))]
    df = spark.createDataFrame(rows, "near long, src long, dst long").repartition(6)
    want = {r.node: r.component for r in graph.connected_components(df).collect()}
    got = graph.near_components(df, ["near"]).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    monkeypatch.setattr(graph, "connected_components", lambda *a: 1 / 0)
    lone = df.where("src < 900 and src % 50 < 49")
    assert len(set(r.component for r in graph.near_components(lone, ["near"]).collect())) > 15
