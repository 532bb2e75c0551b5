import math

from pyspark.sql import functions as F

from scanloom.operators import meshes, paths, reports, validate
from scanloom.sources import missions, templates
from scanloom.streaming import flights

TEMPLATE = """<?xml version="1.0"?><kml xmlns:wpml="w"><Document><wpml:missionConfig><wpml:finishAction> goHome </wpml:finishAction>
<wpml:droneInfo><wpml:droneEnumValue>91</wpml:droneEnumValue></wpml:droneInfo><wpml:height>1</wpml:height>
<wpml:takeOffRefPoint>52.5, 5.25,3</wpml:takeOffRefPoint></wpml:missionConfig>
<Folder><wpml:height>30</wpml:height><wpml:height> </wpml:height><Placemark><Point><coordinates>
5.0,52.0,7
5.1,52.0
bad
</coordinates></Point></Placemark></Folder></Document></kml>"""
GROUP = """<wpml:actionGroup><wpml:actionGroupStartIndex>{a}</wpml:actionGroupStartIndex><wpml:actionGroupEndIndex>3</wpml:actionGroupEndIndex><wpml:action>
<wpml:actionActuatorFunc>{f}</wpml:actionActuatorFunc>{p}</wpml:action></wpml:actionGroup>"""
POSE = "<wpml:smartObliquePoint><wpml:smartObliqueEulerPitch>{0}</wpml:smartObliqueEulerPitch><wpml:smartObliqueEulerYaw>{1}</wpml:smartObliqueEulerYaw><wpml:smartObliqueEulerRoll></wpml:smartObliqueEulerRoll></wpml:smartObliquePoint>"
MEMBER = "archive_id string, kind string, text string"


def test_template(spark):
    bare = "<kml><Document/></kml>"
    rows = {r.archive_id: r for r in templates.parse_template(spark.createDataFrame([("a", "template", TEMPLATE), ("b", "template", bare), ("c", "waylines", bare)], MEMBER)).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].config == {} and rows["b"].ring == [] and rows["b"].takeoff is None
    a = rows["a"]
    assert a.config["finishAction"] == "goHome" and a.config["height"] == "30" and a.config["droneInfo"] == "" and "droneEnumValue" not in a.config
    assert [tuple(p) for p in a.ring] == [(5.0, 52.0, 7.0), (5.1, 52.0, 0.0)] and tuple(a.takeoff) == (52.5, 5.25, 3.0)


def test_rosettes_and_reference(spark):
    text = "<kml>" + GROUP.format(a=1, f=" startSmartOblique ", p=POSE.format(-45, 90) + POSE.format("x", 0) + "<wpml:smartObliquePoint/>" + POSE.format(-90, "")) + GROUP.format(a=1, f="takePhoto", p=POSE.format(0, 0)) + GROUP.format(a="?", f="startSmartOblique", p=POSE.format(0, 0)) + "</kml>"
    members = spark.createDataFrame([("a", "waylines", text), ("b", "waylines", "<kml/>"), ("b", "geo_desc", '{"ref_GPS": {"latitude": 52, "longitude": 5}}'), ("c", "waylines", "<kml/>"), ("d", "waylines", "<kml/>"), ("d", "template", TEMPLATE)], MEMBER)
    groups = templates.parse_oblique_groups(members)
    assert [(r.archive_id, r.start_idx, r.end_idx, [tuple(p) for p in r.poses]) for r in groups.collect()] == [("a", 1, 3, [(-45.0, 90.0, 0.0)])]
    route = spark.createDataFrame([("a", i, 52.0 + i / 1000, 5.0, 10.0, 200.0, -10.0, 30.0 if i else None, "north" if i == 3 else "aircraft", 3.0) for i in range(4)], "archive_id string, idx int, lat double, lon double, alt double, heading_deg double, gimbal_pitch_deg double, gimbal_yaw_raw_deg double, gimbal_yaw_base string, speed_ms double")
    ref = templates.resolve_reference(members, route, templates.parse_template(members))
    assert {tuple(r) for r in ref.collect()} == {("a", 52.0, 5.0, 10.0), ("b", 52.0, 5.0, 0.0), ("c", 0.0, 0.0, 0.0), ("d", 52.5, 5.25, 3.0)}
    rows = templates.flown_waypoints(route, ref, groups).orderBy("idx").collect()
    assert [len(r.poses) for r in rows] == [0, 1, 1, 1] and rows[1].poses[0].yaw == -70.0
    assert rows[0].gimbal_yaw_deg == -160.0 and rows[1].gimbal_yaw_deg == -130.0 and rows[3].gimbal_yaw_deg == 30.0 and (rows[0].x, rows[0].y, rows[0].z) == (0, 0, 0) and 222 < rows[2].y < 223
    assert templates.flown_waypoints(route.limit(0), ref, groups).count() == 0


def test_archives_hold_scans(spark):
    import io
    import zipfile

    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("wpmz/waylines.wpml", "<kml/>")
        z.writestr("x/sfm_geo_desc.json", "{}")
        z.writestr("x/cloud.ply", b"\xff\x00")
    got = {r.kind: r for r in missions.read_archives(spark.createDataFrame([("a", sink.getvalue())], "archive_id string, content binary")).collect()}
    assert set(got) == {"waylines", "geo_desc", "cloud"} and bytes(got["cloud"].data) == b"\xff\x00" and got["geo_desc"].text == "{}"


W = "mission_id long, idx int, is_transition boolean, gimbal_pitch_deg double, gimbal_yaw_deg double, heading_deg double"


def test_pose_fold_as_a_stream(spark, tmp_path):
    rows = [(m, i, i % 5 == 3, -90.0 + (i * m * 7) % 40, None if i % 4 == 0 else (i * 11 * m) % 360.0, (i * m * 3) % 360.0) for m in (1, 2) for i in range(40)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 14 == k], W).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    batch = {tuple(r) for r in paths.dedupe_poses(spark.createDataFrame(rows, W)).collect()}
    stream = spark.readStream.schema(W).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    q = flights.pose_commands(stream).writeStream.format("memory").queryName("poses").option("checkpointLocation", f"{tmp_path}-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert {tuple(r) for r in spark.table("poses").collect()} == batch and len(batch) == 80
    assert not any(a or b for _, i, a, b in batch if i % 5 == 3) and all((m, 0, True, True) in batch for m in (1, 2))
    one = spark.createDataFrame([(1, 0, False, None, None, None), (1, 1, False, 5.0, 5.0, 5.0)], W)
    assert [tuple(r)[1:] for r in paths.dedupe_poses(one).orderBy("idx").collect()] == [(0, True, True), (1, True, True)]
    assert all(r.emit_gimbal and r.emit_heading for r in paths.dedupe_poses(one, -1, -1).collect()) and paths.dedupe_poses(one.limit(0)).count() == 0


def test_mesh_inputs(spark):
    b = spark.createDataFrame([(1, 4.0, 4.0, 100.0, 0.0), (2, 4.0, 4.0, 3.0, 0.0)], "building_id long, width double, depth double, height double, heading_deg double")
    faces = meshes.box_meshes(b)
    top = lambda f: {r.mesh_id: round(r.z, 9) for r in f.groupBy("mesh_id").agg(F.max(F.greatest("az", "bz", "cz")).alias("z")).collect()}
    assert top(meshes.auto_scale(faces)) == {1: 8.0, 2: 3.0}
    assert top(meshes.auto_scale(faces, spark.createDataFrame([(2, 12.0)], "mesh_id long, height double"))) == {1: 8.0, 2: 12.0}
    twice = meshes.axis_swap(meshes.axis_swap(faces)).select("mesh_id", "fid", "ay", "az").collect()
    same = {(r.mesh_id, r.fid): r for r in faces.collect()}
    assert all(r.ay == -same[r.mesh_id, r.fid].ay and r.az == -same[r.mesh_id, r.fid].az for r in twice)
    ring = spark.createDataFrame([(1, [(-9.0, -9.0), (0.0, -9.0), (0.0, 9.0), (-9.0, 9.0)])], "mesh_id long, ring array<struct<x:double,y:double>>")
    left = {r.mesh_id: r["count"] for r in meshes.clip_mesh(faces, ring, margin=0.0, least=1).groupBy("mesh_id").count().collect()}
    assert left[2] == 12 and 0 < left[1] < 12 and meshes.clip_mesh(faces, ring, margin=0.0).count() == 24
    f = spark.createDataFrame([(2, 0, 5.0, 0.0, 1.0, -1.0, 0.0, 0.0), (2, 1, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0), (2, 2, 2.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "building_id long, facade_index int, cx double, cy double, cz double, nx double, ny double, nz double")
    assert [(r.facade_index, r.nx) for r in meshes.envelope_filter(f, faces).orderBy("facade_index").collect()] == [(0, -1.0), (1, 1.0)]


def test_filter_issues(spark):
    rows = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 3)], "mission_id long, idx int")
    none = rows.limit(0)
    got = {(r.mission_id, r.code): (r.n, r.waypoint_indices) for r in validate.filter_issues(rows, none, none, rows.where("mission_id = 2"), rows.where("idx = 3").withColumnRenamed("idx", "facade_index")).collect()}
    assert got == {(1, "mapping_polygon_clipped"): (7, [0, 1, 2, 3, 4]), (2, "mapping_polygon_clipped"): (1, [3]), (2, "path_collision_resolved"): (1, [3]), (1, "facades_disabled"): (1, [3]), (2, "facades_disabled"): (1, [3])}


def test_aim_verification(spark):
    w = spark.createDataFrame([(1, 0, False, 0.0, 350.0, 0.0), (1, 1, True, 50.0, 0.0, 0.0), (1, 2, False, -88.0, None, 30.0), (2, 0, False, 0.0, None, 0.0)], W)
    t = spark.createDataFrame([(1, 0, 4.0)], "mission_id long, idx int, off_deg double")
    a, b = reports.aim_verification(w, t).orderBy("mission_id").collect()
    assert (a.n, a.no_hit, a.on_target, a.pitch_down, a.pitch_level, a.yaw_jumps) == (2, 1, 1, 1, 1, 1) and math.isclose(a.yaw_jump_median, 40) and a.no_hit_pct == 50
    assert (b.n, b.no_hit, b.aim_max, b.yaw_jumps_pct) == (1, 1, None, None)
