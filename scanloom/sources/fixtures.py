"""Inspection tables derived from the given Parquet tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.ordering import numbered
from scanloom.session import table

VIEWS: dict[str, str] = {
    "buildings": """
SELECT p_partkey AS building_id, 52e0 + (p_partkey % 100) * 1e-2 AS lat, 5e0 + (p_partkey % 50) * 1e-2 AS lon,
       CAST(p_partkey % 7 AS DOUBLE) AS ground_altitude, 5e0 + p_size AS width, 4e0 + (p_partkey % 17) AS depth, 3e0 + (p_partkey % 13) AS height,
       CAST((p_partkey * 7) % 360 AS DOUBLE) AS heading_deg, CASE WHEN p_partkey % 3 = 0 THEN 'pitched' ELSE 'flat' END AS roof_type,
       CASE WHEN p_partkey % 3 = 0 THEN 15e0 + (p_partkey % 30) ELSE 0e0 END AS roof_pitch_deg
FROM part""",
    "waypoints": """
SELECT o_custkey % 50 AS mission_id, o_custkey % 50 AS building_id,
       CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS INT) AS idx,
       ((o_orderkey * 37) % 400) / 10e0 - 20e0 AS x, ((o_orderkey * 53) % 300) / 10e0 - 15e0 AS y, 1e0 + (o_orderkey % 140) / 10e0 AS z,
       CAST((o_orderkey * 7) % 360 AS DOUBLE) AS heading_deg, CAST((o_orderkey * 13) % 130 AS DOUBLE) - 92e0 AS gimbal_pitch_deg,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey * 29) % 360 AS DOUBLE) - 180e0 END AS gimbal_yaw_deg,
       1e0 + (o_orderkey % 45) / 2e0 AS speed_ms,
       CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey % 5 END AS INT) AS facade_index, (o_orderkey % 11 = 0) AS is_transition
FROM orders""",
    "points": """
SELECT cloud_id, point_id, plane_id,
       CASE plane_id WHEN 1 THEN 5e0 + e WHEN 3 THEN -5e0 + e ELSE -5e0 + 10e0 * u END AS x,
       CASE plane_id WHEN 0 THEN -25e-1 + e WHEN 2 THEN 25e-1 + e WHEN 4 THEN -25e-1 + 5e0 * v ELSE -25e-1 + 5e0 * u END AS y,
       CASE plane_id WHEN 4 THEN 4e0 + e ELSE 4e0 * v END AS z
FROM (SELECT l_suppkey % 4 AS cloud_id,
             row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS point_id,
             l_partkey % 5 AS plane_id, (l_quantity - 1e0) / 49e0 AS u, (l_orderkey % 97) / 96e0 AS v, (l_discount - 5e-2) * 2e-1 AS e
      FROM lineitem) t""",
    "zones": """
SELECT s_suppkey AS zone_id, s_suppkey % 50 AS mission_id, CASE s_suppkey % 3 WHEN 0 THEN 'no_fly' WHEN 1 THEN 'no_inspect' ELSE 'inclusion' END AS zone_type,
       CAST(s_suppkey % 21 AS DOUBLE) - 10e0 AS center_x, CAST(s_suppkey % 15 AS DOUBLE) - 7e0 AS center_y,
       5e0 AS center_z, 4e0 + (s_suppkey % 9) AS size_x, 4e0 + (s_suppkey % 7) AS size_y, 12e0 AS size_z
FROM supplier""",
    "rings": """
SELECT n_nationkey AS mission_id, k AS seq, (8e0 + n_nationkey % 5) * cos(k * 1.0471975511965976e0) AS x, (6e0 + n_nationkey % 4) * sin(k * 1.0471975511965976e0) AS y
FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) h""",
    "flight_events": """
SELECT event_id, user_id AS flight_id, ts,
       CASE event_type WHEN 'signup' THEN 16 WHEN 'view' THEN 32 WHEN 'click' THEN 48 WHEN 'purchase' THEN 64 ELSE 0 END AS mission_state,
       CAST(floor(value) AS INT) AS waypoint_index, (event_type IN ('click', 'purchase')) AS is_action
FROM events""",
    "cameras": """
SELECT * FROM (VALUES ('wide', 12e0, 173e-1, 13e0, 5280, 3956, 84e0, 5e-1), ('medium_tele', 19e0, 96e-1, 72e-1, 8064, 6048, 35e0, 7e-1),
                      ('telephoto', 418e-1, 88e-1, 66e-1, 8192, 6144, 15e0, 7e-1))
  AS c(camera, focal_length_mm, sensor_width_mm, sensor_height_mm, image_width_px, image_height_px, fov_deg, min_interval_s)""",
}
NEEDS = {"buildings": "part", "waypoints": "orders", "points": "lineitem", "zones": "supplier", "rings": "nation", "flight_events": "events"}


#: Views with a running number: its text in the SQL, its key and its order.
NUMBERED = {
    "waypoints": ("row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)", "o_custkey % 50", ["o_orderkey"]),
    "points": (
        "row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)",
        "l_suppkey % 4", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"],
    ),
}
#: Buildings a task: each becomes faces, triangles and waypoints, which the size of its file doesn't show.
BUILDINGS_A_TASK = 5_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of sf_dir; buildings are dealt to tasks by their id, running numbers are made in many tasks."""
    if name not in NEEDS:
        return spark.sql(VIEWS[name])
    rows = table(spark, sf_dir, NEEDS[name])
    rows.createOrReplaceTempView(NEEDS[name])
    if name == "buildings":
        return spark.sql(VIEWS[name]).repartition(-(-rows.count() // BUILDINGS_A_TASK) or 1, "building_id")
    if name in NUMBERED:
        text, key, order = NUMBERED[name]
        numbered(rows, F.expr(key), order, "row_no").createOrReplaceTempView(f"{NEEDS[name]}_numbered")
        return spark.sql(VIEWS[name].replace(text, "row_no").replace(f"FROM {NEEDS[name]}", f"FROM {NEEDS[name]}_numbered"))
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """sql with VIEWS as common table expressions before it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if sql.lstrip()[:4].lower() == "with" else " ") + (sql.lstrip()[4:].lstrip() if sql.lstrip()[:4].lower() == "with" else sql)
