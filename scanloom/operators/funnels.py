"""Row counts through the stages of generation and extraction, and weighted normals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def funnel(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """``key, stage_no, stage, rows`` of each stage's table; stages without rows of a key are omitted."""
    parts = [df.groupBy(key).agg(F.count("*").alias("rows")).select(key, F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), "rows") for i, (n, df) in enumerate(stages)]
    return reduce(DataFrame.unionByName, parts)


def extraction_funnel(regions: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Regions per key, how many fell to each reason, and walls and roofs among the kept."""
    kept = F.col("reject_reason").isNull()
    reasons = [F.count_if(F.col("reject_reason") == r).alias(f"lost_{r}") for r in ("area", "normal", "ground", "occlusion")]
    return regions.groupBy(key).agg(F.count("*").alias("regions"), *reasons, F.count_if(kept & (F.abs("nz") < 0.3)).alias("walls"), F.count_if(kept & (F.col("nz") >= 0.3)).alias("roofs"))


def weighted_mean_normal(faces: DataFrame, key: str, weight: str) -> DataFrame:
    """Unit mean normal by weight; keys whose sum has no length are left out."""
    g = faces.groupBy(key).agg(*[F.sum(F.col(f"n{a}") * F.col(weight)).alias(f"s{a}") for a in "xyz"])
    n = F.sqrt(F.expr("sx*sx + sy*sy + sz*sz"))
    return g.where(n >= 1e-9).select(key, *[(F.col(f"s{a}") / n).alias(f"n{a}") for a in "xyz"])


def archive_bounds(rings: DataFrame, clouds: DataFrame) -> DataFrame:
    """Width and depth of the mission area and height of the cloud (0 where either is missing)."""
    r = rings.groupBy("mission_id").agg((F.max("x") - F.min("x")).alias("width_m"), (F.max("y") - F.min("y")).alias("depth_m"))
    c = clouds.groupBy(F.col("cloud_id").alias("mission_id")).agg((F.max("z") - F.min("z")).alias("height_m"))
    return r.join(c, "mission_id", "full").na.fill(0.0)


def footprint_rings(facades: DataFrame, key: str = "building_id") -> DataFrame:
    """``key, ring``: the first corner of every wall in face order, closed; keys with fewer than three walls are left out."""
    walls = facades.where("abs(nz) < 0.01").select(key, "facade_index", F.col("vertices")[0].alias("p"))
    g = walls.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("facade_index", "p"))), lambda w: F.struct(w["p"]["x"].alias("x"), w["p"]["y"].alias("y"))).alias("ring"))
    return g.where(F.size("ring") >= 3).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))


def mission_json(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """``mission_id, value``: counts with nested gimbal figures as one JSON document."""
    g = stats.select("mission_id", F.struct("mean_pitch", "min_pitch", "max_pitch", "median", "p25", "p75").alias("gimbal"))
    rows = summary.join(g, "mission_id", "left")
    return rows.select("mission_id", F.to_json(F.struct("mission_id", "waypoints", "inspection", "transit", "gimbal")).alias("value"))
