"""Camera optics; ``cameras(spark)`` is the three-row dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Camera, focal length, sensor width and height (mm), pixels across and down, field of view, least interval (s).
CAMERAS = (
    ("wide", 12.0, 17.3, 13.0, 5280, 3956, 84.0, 0.5),
    ("medium_tele", 19.0, 9.6, 7.2, 8064, 6048, 35.0, 0.7),
    ("telephoto", 41.8, 8.8, 6.6, 8192, 6144, 15.0, 0.7),
)
SCHEMA = "camera string, focal_length_mm double, sensor_width_mm double, sensor_height_mm double, image_width_px int, image_height_px int, fov_deg double, min_interval_s double"


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, SCHEMA)


def gsd_mm(distance: Column) -> Column:
    """Millimetres on the surface of one pixel, with the camera's columns in scope."""
    return distance * F.col("sensor_width_mm") / (F.col("focal_length_mm") * F.col("image_width_px")) * 1000


def distance_for_gsd(gsd: Column) -> Column:
    return F.col("focal_length_mm") * gsd * F.col("image_width_px") / (F.col("sensor_width_mm") * 1000)


def footprint(distance: Column) -> tuple[Column, Column]:
    """Width and height on the surface."""
    return distance * F.col("sensor_width_mm") / F.col("focal_length_mm"), distance * F.col("sensor_height_mm") / F.col("focal_length_mm")


def grid_spacing(width: Column, height: Column, front: Column, side: Column) -> tuple[Column, Column]:
    return (1 - side) * width, (1 - front) * height


def photo_interval_distance(speed: Column) -> Column:
    return F.col("min_interval_s") * speed


def fov_deg(sensor: Column, focal: Column) -> Column:
    return F.round(F.degrees(2 * F.atan(sensor / (2 * focal))), 1)
