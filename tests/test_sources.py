import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import clouds, paths
from scanloom.sources import missions, ply


def test_ply_formats(spark, tmp_path):
    xyz = np.array([[1, 2, 3], [-4, 5.5, 6]], float)
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.ply").write_bytes(ply.encode(xyz))
    ascii_ = "ply\nformat ascii 1.0\nelement vertex 2\nproperty uchar red\nproperty double x\nproperty double y\nproperty double z\nelement face 0\nend_header\n9 1 2 3\n9 -4 5.5 6\n"
    (tmp_path / "c1" / "b.ply").write_text(ascii_)
    (tmp_path / "c1" / "bad.ply").write_text("ply\nformat ascii 1.0\nend_header\n")
    points, bad = ply.read_ply(spark, str(tmp_path))
    assert sorted((r.cloud_id, r.x, r.y, r.z) for r in points.collect()) == sorted([("c1", *p) for p in xyz.tolist()] * 2)
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.ply"]
    df = spark.createDataFrame([(7, i, float(i), 2.0 * i, -1.0 * i) for i in range(50)], "cloud_id int, point_id long, x double, y double, z double")
    files = ply.export_ply(df, part_rows=20).collect()
    got = np.concatenate([ply.decode(bytes(r.content)) for r in files])
    assert len(files) > 1 and sorted(got[:, 0]) == list(map(float, range(50)))


def waypoints(spark):
    rows = [(1, i, 52.0 + i / 1e4, 5.0, float(i), 350.0, -100.0 + i, None if i == 2 else 10.0, 3.0, i == 1) for i in range(4)]
    return spark.createDataFrame(rows, "mission_id long, idx int, lat double, lon double, alt double, heading_deg double, gimbal_pitch_deg double, gimbal_yaw_deg double, speed_ms double, is_transition boolean")


def test_archives_nest_and_fail_softly(spark):
    good = missions.archives(missions.waylines_xml(waypoints(spark))).collect()[0].content
    outer, empty = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.KMZ", bytes(good))
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("readme.txt", "x")
    df = spark.createDataFrame([("a", bytes(good)), ("b", outer.getvalue()), ("c", empty.getvalue()), ("d", b"junk")], "archive_id string, content binary")
    members = missions.read_archives(df)
    assert {(r.archive_id, r.kind) for r in members.collect()} == {("a", "waylines"), ("b", "waylines"), ("c", "error"), ("d", "error")}
    rows = missions.parse_waylines(members).where("archive_id = 'b'").orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1, 2, 3] and rows[0].alt == 2.0 and rows[0].gimbal_pitch_deg == -90 and rows[0].heading_deg == -10
    assert rows[1].is_transition and rows[1].gimbal_pitch_deg == 0 and not rows[0].is_transition
    assert [(r.gimbal_yaw_base, r.gimbal_yaw_raw_deg) for r in rows] == [("north", 10), ("aircraft", 0), ("aircraft", 0), ("north", 10)]
    assert missions.waylines_xml(waypoints(spark), most=3).first().xml is None


STANDARD = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:wpml="urn:any"><Document><Folder>
<wpml:startActionGroup><wpml:action><wpml:actionId>0</wpml:actionId><wpml:actionActuatorFunc>gimbalRotate</wpml:actionActuatorFunc>
  <wpml:actionActuatorFuncParam><wpml:gimbalHeadingYawBase>{base}</wpml:gimbalHeadingYawBase></wpml:actionActuatorFuncParam></wpml:action></wpml:startActionGroup>
<Placemark><Point><coordinates>
   5.0,52.0,1
   5.1,52.0,1
</coordinates></Point></Placemark>
<Placemark><Point><coordinates>
   5.25,52.5
</coordinates></Point><wpml:index>7</wpml:index><wpml:executeHeight>30</wpml:executeHeight><wpml:ellipsoidHeight>71.5</wpml:ellipsoidHeight><wpml:waypointSpeed>4</wpml:waypointSpeed>
  <wpml:waypointHeadingParam><wpml:waypointHeadingAngle>90</wpml:waypointHeadingAngle></wpml:waypointHeadingParam>
  <wpml:waypointGimbalHeadingParam><wpml:waypointGimbalPitchAngle>-20</wpml:waypointGimbalPitchAngle><wpml:waypointGimbalYawAngle>15</wpml:waypointGimbalYawAngle><wpml:waypointGimbalHeadingMode> fixed </wpml:waypointGimbalHeadingMode></wpml:waypointGimbalHeadingParam></Placemark>
<Placemark><Point><coordinates>5.26,52.6,9</coordinates></Point><wpml:executeHeight>31</wpml:executeHeight><wpml:ellipsoidHeight>0</wpml:ellipsoidHeight><wpml:waypointSpeed>fast</wpml:waypointSpeed>
  <wpml:waypointHeadingParam><wpml:waypointHeadingAngle>90</wpml:waypointHeadingAngle></wpml:waypointHeadingParam>
  <wpml:waypointGimbalHeadingParam><wpml:waypointGimbalPitchAngle>-20</wpml:waypointGimbalPitchAngle></wpml:waypointGimbalHeadingParam>
  <wpml:actionGroup><wpml:action><wpml:actionActuatorFunc>rotateYaw</wpml:actionActuatorFunc><wpml:actionActuatorFuncParam><wpml:aircraftHeading>-45</wpml:aircraftHeading></wpml:actionActuatorFuncParam></wpml:action>
   <wpml:action><wpml:actionActuatorFunc>gimbalRotate</wpml:actionActuatorFunc><wpml:actionActuatorFuncParam><wpml:gimbalPitchRotateAngle>-30</wpml:gimbalPitchRotateAngle><wpml:gimbalHeadingYawBase>north</wpml:gimbalHeadingYawBase><wpml:gimbalYawRotateAngle>100</wpml:gimbalYawRotateAngle></wpml:actionActuatorFuncParam></wpml:action>
   <wpml:action><wpml:actionActuatorFunc>gimbalRotate</wpml:actionActuatorFunc><wpml:actionActuatorFuncParam><wpml:gimbalPitchRotateAngle>-35</wpml:gimbalPitchRotateAngle><wpml:gimbalYawRotateAngle>bad</wpml:gimbalYawRotateAngle></wpml:actionActuatorFuncParam></wpml:action></wpml:actionGroup></Placemark>
<Placemark><Point><coordinates>5.27,52.7</coordinates></Point></Placemark>
<Placemark><Point><coordinates>no place</coordinates></Point></Placemark><Placemark/>
</Folder></Document></kml>"""


def test_standard_layout_not_from_our_writer(spark):
    text = lambda base: STANDARD.format(base=base)
    members = spark.createDataFrame([("a", "waylines", text("aircraft")), ("b", "waylines", text(" north ")), ("c", "waylines", text("")), ("d", "waylines", "<kml/>"), ("e", "waylines", "junk")], "archive_id string, kind string, text string")
    rows = missions.parse_waylines(members).orderBy("archive_id", "alt").collect()
    by = {k: [tuple(r)[1:] for r in rows if r.archive_id == k] for k in "abcde"}
    want = lambda base: [(2, 52.7, 5.27, 0.0, 0.0, 0.0, 0.0, "smoothTransition", base, 2.0, True), (1, 52.6, 5.26, 31.0, -45.0, -35.0, 100.0, "smoothTransition", "north", 2.0, False), (7, 52.5, 5.25, 71.5, 90.0, -20.0, 15.0, "fixed", base, 4.0, False)]
    assert by["a"] == want("aircraft") and by["b"] == want("north")
    assert by["c"] == want("north")  # the first base with a text is the second row's
    assert by["d"] == by["e"] == []
    assert {r.archive_id for r in missions.unreadable_routes(members).collect()} == {"d", "e"}


def test_written_routes_have_the_standard_elements(spark):
    import xml.etree.ElementTree as ET

    w = waypoints(spark).withColumns({"x": F.col("idx") * 3.0, "y": F.lit(0.0), "z": F.col("alt"), "emit_gimbal": F.col("idx") != 3, "emit_heading": F.col("idx") == 3})
    root = ET.fromstring(missions.waylines_xml(w, speed_ms=2.0).first().xml)
    k, m = f"{{{missions.KML}}}", f"{{{missions.WPML}}}"
    folder = root.find(f"{k}Document/{k}Folder")
    length = 3 * math.sqrt(10)
    assert abs(float(folder.find(f"{m}distance").text) - length) < 1e-3 and abs(float(folder.find(f"{m}duration").text) - length / 2 - 2) < 1e-3
    assert [a.find(f"{m}actionActuatorFunc").text for a in folder.find(f"{m}startActionGroup")] == ["gimbalRotate", "hover", "setFocusType"]
    places = folder.findall(f"{k}Placemark")
    assert [p.find(f"{k}Point/{k}coordinates").text for p in places][1] == "5.00000000,52.00010000"
    assert [float(p.find(f"{m}executeHeight").text) for p in places] == [2, 2, 2, 3] and [float(p.find(f"{m}ellipsoidHeight").text) for p in places] == [2, 1, 2, 3]
    assert all(float(p.find(f"{m}waypointHeadingParam/{m}waypointHeadingAngle").text) == -10 for p in places)
    acts = [[(a.find(f"{m}actionId").text, a.find(f"{m}actionActuatorFunc").text) for a in p.iter(f"{m}action")] for p in places]
    assert acts == [[("0", "gimbalRotate"), ("1", "takePhoto")], [], [("0", "gimbalRotate"), ("1", "takePhoto")], [("0", "rotateYaw"), ("1", "takePhoto")]]
    assert [e.text for e in places[0].iter(f"{m}gimbalHeadingYawBase")] == ["north"] and [e.text for e in places[2].iter(f"{m}gimbalYawRotateEnable")] == ["0"]


def test_intents(spark):
    import json

    route = missions.parse_waylines(spark.createDataFrame([("a", "waylines", STANDARD.format(base="north"))], "archive_id string, kind string, text string"))
    ref = spark.createDataFrame([("a", 52.0, 5.0, 1.0)], "archive_id string, ref_lat double, ref_lon double, ref_alt double")
    ring = spark.createDataFrame([("a", [(5.0, 52.0, 1.0)])], "archive_id string, ring array<struct<lon:double,lat:double,alt:double>>")
    lines = missions.write_intents(route, ref, ring)
    doc = json.loads(lines.first().value)
    assert set(doc) == {"schema_version", "name", "ref", "mission_area_wgs84", "waypoints"} and doc["ref"] == {"lat": 52.0, "lon": 5.0, "alt": 1.0} and doc["mission_area_wgs84"] == [[5.0, 52.0, 1.0]]
    assert set(doc["waypoints"][0]) == {"index", "lon", "lat", "alt_egm96", "heading_deg", "gimbal_pitch_deg", "speed_ms", "gimbal_yaw_raw_deg", "gimbal_heading_mode", "gimbal_yaw_base", "smart_oblique_poses"}
    least = {"schema_version": 1, "ref": {"lat": 1, "lon": 2, "alt": 3}, "waypoints": [{"index": 0, "lon": 1, "lat": 2, "alt_egm96": 3, "heading_deg": 4, "gimbal_pitch_deg": 5, "smart_oblique_poses": [{"pitch_deg": 1, "yaw_offset_deg": 2}]}]}
    odd = [json.dumps(least | {"schema_version": 999}), "junk", json.dumps({k: v for k, v in least.items() if k != "ref"}), json.dumps(least | {"waypoints": [{"index": 1}]})]
    back, bad = missions.read_intents(lines.union(spark.createDataFrame([(json.dumps(least),), *((x,) for x in odd)], "value string")))
    assert bad.count() == len(odd)
    same = [c for c in route.columns if c not in ("archive_id", "is_transition")]
    assert sorted(map(tuple, back.where("name = 'a'").select(*same).collect())) == sorted(map(tuple, route.select(*same).collect()))
    b = back.where("name = ''").first()
    assert (b.speed_ms, b.gimbal_yaw_raw_deg, b.gimbal_heading_mode, b.gimbal_yaw_base, tuple(b.poses[0])) == (2.0, 0.0, "smoothTransition", "aircraft", (1.0, 2.0, 0.0))


def test_geojson(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,3],[0,0]]]}, "properties": {"height": 0}}, {"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,1],[0,0]]]}, "properties": {}}]}')
    rows = missions.read_geojson(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and len(rows[0].ring) == 3 and rows[0].height == 8.0


def test_log_lines(spark):
    lines = ["2026-06-12 10:00:00.5 \x1b[31mSTATE\x1b[0m state=32 wp=7\x00", "2026-06-12 10:00:01 ACTION group 1", "noise", "2026-06-12 10:00:02 HEARTBEAT"]
    got = missions.parse_log(spark.createDataFrame([(1, x) for x in lines], "flight_id long, value string")).orderBy("ts").collect()
    assert [(r.kind, r.mission_state, r.waypoint_index) for r in got] == [("STATE", 32, 7), ("ACTION", None, None)]


def test_planted_planes_and_hull(spark):
    rng = np.random.default_rng(0)
    u, v = rng.random((2, 3000)) * 4
    e = rng.normal(0, 0.005, 3000)
    rows = [(1, i, float(u[i]), float(v[i]), 5 + float(e[i])) for i in range(1500)] + [(1, i, float(u[i]), -3 + float(e[i]), float(v[i])) for i in range(1500, 3000)]
    df = spark.createDataFrame(rows, "cloud_id int, point_id long, x double, y double, z double")
    planes = clouds.grow_planes(df).collect()
    assert len(planes) == 2
    for p in planes:
        n = np.array([p.nx, p.ny, p.nz])
        assert max(abs(n)) > np.cos(np.radians(2)) and min(abs(p.d - 5), abs(p.d + 3)) < 0.02
    square = spark.createDataFrame([(1, float(x), float(y)) for x in range(5) for y in range(5)], "cloud_id int, x double, y double")
    assert sorted((r.x, r.y) for r in clouds.convex_hulls(square).collect()) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_voxel_case(spark):
    pts = [(0.1, 0.2, 0.3), (0.9, 0.8, 0.7), (5.5, 5.5, 5.5), (5.9, 5.1, 5.2), (-3.5, 7.1, 2.9)]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "cloud_id int, point_id long, x double, y double, z double")
    for mode in ("mean", "first"):
        assert {(r.ix, r.iy, r.iz) for r in clouds.voxel_downsample(df, 1.0, mode).collect()} == {(0, 0, 0), (5, 5, 5), (-4, 7, 2)}


def test_registration_recovers_a_shift(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, *map(float, p)) for k in (1, 2) for i, p in enumerate(rng.random((300, 3)) * 6)]
    target = spark.createDataFrame(rows, "cloud_id int, point_id long, x double, y double, z double")
    c, s = np.cos(0.01), np.sin(0.01)
    moved = clouds.apply_transform(target, [c, -s, 0, 0.05, s, c, 0, -0.04, 0, 0, 1, 0.03, 0, 0, 0, 1])
    for r in clouds.register(moved, target, 0.8).collect():
        assert r.rmse < 1e-3 and abs(r.m[0] - c) < 1e-3 and r.pairs == 300


@pytest.mark.parametrize("threshold,want", [(5.0, [0, 3, 5]), (-1.0, [0, 1, 2, 3, 4, 5])])
def test_pose_fold_uses_the_last_commanded(spark, threshold, want):
    rows = [(1, i, False, p, None, 180.0) for i, p in enumerate((0.0, 4.0, 4.5, 6.0, 11.0, 12.0))]
    df = spark.createDataFrame(rows, "mission_id int, idx int, is_transition boolean, gimbal_pitch_deg double, gimbal_yaw_deg double, heading_deg double")
    got = paths.dedupe_poses(df, threshold, 5.0).orderBy("idx").collect()
    assert [r.idx for r in got if r.emit_gimbal] == want and [r.idx for r in got if r.emit_heading] == [0]


def test_timeline_starts_at_zero(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, False), (1, 1, 3.0, 0.0, 0.0, False), (1, 2, 12.0, 0.0, 0.0, True)], "mission_id int, idx int, x double, y double, z double, is_transition boolean")
    assert [r.t_s for r in paths.timeline(df).orderBy("idx").collect()] == [0, 2, 3]
    assert paths.with_path(df).agg(F.max("cum_m")).first()[0] == 12


def box_mesh(spark):
    from scanloom.operators import meshes

    b = spark.createDataFrame([(1, 10.0, 6.0, 4.0, 0.0)], "building_id int, width double, depth double, height double, heading_deg double")
    return meshes, meshes.box_meshes(b)


def test_sight_through_a_box(spark):
    meshes, faces = box_mesh(spark)
    frame = dict(ux=1.0, uy=0.0, uz=0.0, vx=0.0, vy=0.0, vz=1.0)
    rows = [(1, 0, 0.0, -9.0, 2.0, 0.0, -3.0, 2.0), (1, 1, 0.0, 9.0, 2.0, 0.0, -3.0, 2.0), (1, 2, 0.0, -3.0, 2.0, 0.0, -3.0, 2.0)]
    df = spark.createDataFrame(rows, "mesh_id int, idx int, x double, y double, z double, tx double, ty double, tz double").withColumns({k: F.lit(v) for k, v in frame.items()})
    got = {r.idx: r.visible for r in meshes.visible_share(df, faces, ["idx"]).collect()}
    # The third look starts at its target: only its four side rays have a length.
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 1.0


def test_detour_round_a_box(spark):
    meshes, faces = box_mesh(spark)
    rows = [(1, 1, 0, 0.3, -9.0, 2.1, False, 0), (1, 1, 1, 0.3, 9.0, 2.1, False, 2), (1, 1, 2, 0.3, 12.0, 2.1, False, 2)]
    df = spark.createDataFrame(rows, "building_id int, mission_id int, idx int, x double, y double, z double, is_transition boolean, facade_index int")
    assert [r.idx for r in meshes.colliding_segments(df.withColumn("mesh_id", F.col("building_id")), faces).collect()] == [0]
    got = meshes.with_detours(df, faces).orderBy("idx").collect()
    assert [r.is_transition for r in got] == [False, True, False, False] and [r.idx for r in got] == [0, 1, 2, 3] and got[1].z == 4.1


def test_long_missions_are_several_files(spark):
    w = spark.range(25).selectExpr("7L as mission_id", "cast(id as int) as idx", "double(id) as x", "0D as y", "5D as z", "52D + id / 1e5 as lat", "5D as lon", "5D as alt", "double(id) as heading_deg", "-10D - id as gimbal_pitch_deg", "double(id) as gimbal_yaw_deg", "3D as speed_ms", "id = 0 as is_transition")
    parts = missions.waylines_xml(w, most=10, part_rows=10)
    assert sorted((r.part, r.n) for r in parts.collect()) == [(0, 10), (1, 10), (2, 5)] and all("<wpml:distance>24.000</" in r.xml for r in parts.collect())
    back = missions.parse_waylines(missions.read_archives(missions.archives(parts).withColumnRenamed("mission_id", "archive_id")))
    assert [(r.archive_id, r.idx, r.gimbal_pitch_deg) for r in back.orderBy("idx").collect()] == [(7, i, -10.0 - i if i else 0.0) for i in range(25)]
    lines = missions.write_intents(back, part_rows=10)
    assert lines.count() == 3 and sorted((r.name, r.idx) for r in missions.read_intents(lines)[0].collect()) == [("7", i) for i in range(25)]
