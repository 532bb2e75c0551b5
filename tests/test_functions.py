import math

from pyspark.sql import functions as F

from scanloom.functions import angles, camera, geo, polygon
from scanloom.operators import generate


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_camera_cases(spark):
    wide = camera.cameras(spark).where("camera = 'wide'")
    r = wide.select(camera.gsd_mm(F.lit(7.325)), *camera.footprint(F.lit(7.3))).first()
    assert abs(r[0] - 2) < 0.01 and abs(r[1] - 10.5) < 0.1 and abs(r[2] - 7.9) < 0.1
    tele = camera.cameras(spark).where("camera = 'medium_tele'").select(camera.distance_for_gsd(F.lit(1.0))).first()[0]
    assert abs(tele - 16) < 0.1


def test_enu_round_trip(spark):
    args = [F.lit(v) for v in (53.2, 5.8, 10.0)]
    lat, lon, alt = geo.enu_to_wgs84(F.lit(100.0), F.lit(100.0), F.lit(2.0), *args)
    x, y, z = geo.wgs84_to_enu(lat, lon, alt, *args)
    r = one(spark, lat, lon, alt, x, y, z)
    assert r[0] > 53.2 and r[1] > 5.8 and all(abs(a - b) < 1e-6 for a, b in zip(r[2:], (12, 100, 100, 2), strict=True))


def test_angles(spark):
    assert one(spark, angles.to_pm180(F.lit(180.0)), angles.heading_fold(F.lit(180.0)), angles.angle_delta(F.lit(350.0), F.lit(10.0))) == (-180, 180, 20)
    heading, pitch = angles.look_at(F.lit(0.0), F.lit(0.0), F.lit(-3.0), 5.0)
    assert one(spark, pitch)[0] == -85
    assert one(spark, angles.facade_direction(F.lit(0.0), F.lit(-1.0), F.lit(0.0)))[0] == "south"


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-5, -5), (5, -5), (5, 5), (-5, 5))])
    assert one(spark, polygon.contains(ring, F.lit(0.0), F.lit(0.0)), polygon.contains(ring, F.lit(6.0), F.lit(0.0)), polygon.signed_area(ring), polygon.signed_area(F.reverse(ring))) == (True, False, 100, -100)
    wide = polygon.expand(ring, F.lit(2.0))
    assert one(spark, polygon.contains(wide, F.lit(6.0), F.lit(0.0)), polygon.contains(wide, F.lit(7.0), F.lit(0.0))) == (True, False)


def test_overlap_names_and_keys(spark):
    assert one(spark, *[geo.overlap_fraction(F.lit(v)) for v in ("70", "0.6", "", "x", "250")]) == (0.7, 0.6, None, None, 0.99)
    assert one(spark, geo.html_escape(F.lit("<a&'b'>")), geo.safe_name(F.lit("a b/c"))) == ("&lt;a&amp;&#39;b&#39;&gt;", "a_b_c")
    keys = {one(spark, geo.packed_voxel(*geo.voxel_key(*map(F.lit, p), 1.0)))[0] for p in ((0.1, 0.2, 0.3), (0.9, 0.9, 0.9), (5.5, 5.5, 5.5), (-3.5, 7.1, 2.9))}
    assert len(keys) == 3


def box(spark, **over):
    row = {"building_id": 1, "lat": 53.2, "lon": 5.8, "width": 20.0, "depth": 10.0, "height": 8.0, "heading_deg": 0.0, "roof_type": "flat", "roof_pitch_deg": 0.0} | over
    return spark.createDataFrame([tuple(row.values())], "building_id int, lat double, lon double, width double, depth double, height double, heading_deg double, roof_type string, roof_pitch_deg double")


def test_box_faces(spark):
    flat = generate.rectangular_facades(box(spark)).collect()
    pitched = generate.rectangular_facades(box(spark, roof_type="pitched", roof_pitch_deg=30.0)).collect()
    assert len(flat) == 5 and len(pitched) == 6
    for r in flat + pitched:
        assert abs(math.sqrt(r.nx**2 + r.ny**2 + r.nz**2) - 1) < 1e-9
        assert r.nz > 0 if r.component_tag == "47.1" else abs(r.height_m - 8) < 1e-9 and r.nx * r.cx + r.ny * r.cy > 0


def test_waypoints_stay_up_and_get_denser(spark):
    low = generate.rectangular_facades(box(spark, height=3.0))
    assert generate.facade_waypoints(low).agg(F.min("z")).first()[0] >= 2
    f = generate.rectangular_facades(box(spark))
    assert generate.facade_waypoints(f, gsd=1.0).count() > generate.facade_waypoints(f, gsd=2.0).count()


def test_l_shape_drops_inner_walls(spark):
    rows = generate.l_shaped_facades(box(spark)).collect()
    assert [r.facade_index for r in sorted(rows, key=lambda r: r.facade_index)] == list(range(len(rows)))
    assert len(rows) < 10
