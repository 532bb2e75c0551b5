"""Reports by face and mission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import angles, vec
from scanloom.operators import paths


def facade_coverage(facades: DataFrame, waypoints: DataFrame, key: str = "building_id") -> DataFrame:
    """Every face with its photo count, mean pitch, perpendicularity and stand-off; faces without photos too.

    Waypoints are summed by face first, so the join is one row per face.
    """
    n = vec.at("nx", "ny", "nz")
    on = [key, "facade_index"]
    rows = waypoints.where("not is_transition").join(facades.select(*on, "nx", "ny", "nz", "cx", "cy", "cz"), on)
    fwd = angles.camera_forward(F.col("heading_deg"), F.col("gimbal_yaw_deg"), F.col("gimbal_pitch_deg"))
    off = vec.dot(vec.sub(vec.at(), vec.at("cx", "cy", "cz")), n)
    sums = rows.groupBy(*on).agg(F.count("*").alias("n"), F.avg(F.abs("gimbal_pitch_deg")).alias("p"), F.avg(-vec.dot(fwd, n)).alias("q"), F.avg(F.abs(off)).alias("d"))
    out = facades.select(*on, "label", F.round("area_m2", 1).alias("area_m2")).join(sums, on, "left")
    return out.select(*on, "label", "area_m2", F.coalesce("n", F.lit(0)).alias("waypoint_count"), (F.round("p", 1) + 0.0).alias("mean_pitch_abs_deg"), (F.round("q", 3) + 0.0).alias("mean_perpendicularity"), (F.round("d", 1) + 0.0).alias("mean_distance_m"))


def direction_rollup(facades: DataFrame, waypoints: DataFrame, key: str = "building_id") -> DataFrame:
    """Faces and waypoints per side of the compass."""
    n = waypoints.groupBy(key, "facade_index").agg(F.count("*").alias("n"))
    side = angles.facade_direction(F.col("nx"), F.col("ny"), F.col("nz"))
    return facades.select(key, "facade_index", side.alias("direction")).join(n, [key, "facade_index"]).groupBy(key, "direction").agg(F.count("*").alias("facades"), F.sum("n").alias("waypoints"))


def mission_summary(waypoints: DataFrame, hover_s: float = 1.0) -> DataFrame:
    """Counts, path, flight time (by each leg's own speed and a hover after the first row), faces seen."""
    p = paths.with_path(waypoints)
    look = ~F.col("is_transition")
    leg = F.when((F.col("idx") > 0) & (F.col("speed_ms") > 0), F.col("seg_m") / F.col("speed_ms")) + F.when(look & (F.col("idx") > 0), hover_s).otherwise(0.0)
    return p.groupBy("mission_id").agg(F.count("*").alias("waypoints"), F.count_if(look).alias("inspection"), F.count_if("is_transition").alias("transit"), F.sum("seg_m").alias("path_m"), F.coalesce(F.sum(leg), F.lit(0.0)).alias("flight_s"), F.count_distinct(F.when(look & (F.col("facade_index") >= 0), F.col("facade_index"))).alias("facades"))


def flight_time(waypoints: DataFrame, speed: float = 3.0, yaw_rate: float = 60.0, hover_s: float = 1.0, overhead_s: float = 60.0) -> DataFrame:
    """Three models: path, hover and turns at one speed; each leg at its own; path at the mean with half a second a row."""
    p = paths.with_path(waypoints).withColumn("turn", angles.angle_delta(F.col("heading_deg"), F.lag("heading_deg").over(paths.path())))
    look = F.count_if(F.expr("not is_transition"))
    path = F.sum("seg_m")
    turns = F.coalesce(F.sum(F.when(F.col("turn") > 1, F.col("turn") / yaw_rate)), F.lit(0.0))
    leg = F.coalesce(F.sum(F.when((F.col("idx") > 0) & (F.col("speed_ms") > 0), F.col("seg_m") / F.col("speed_ms"))), F.lit(0.0))
    return p.groupBy("mission_id").agg((path / speed + look * hover_s + turns + overhead_s).alias("model_a_s"), (leg + F.count_if(F.expr("idx > 0 and not is_transition")) * hover_s).alias("model_b_s"), (path / F.greatest(F.lit(speed), F.lit(0.1)) + 0.5 * F.count("*")).alias("model_c_s"))


def rank_stat(values: Column, share: int, of: int) -> Column:
    """sorted[n * share // of] of a sorted array."""
    return F.element_at(values, F.floor(F.size(values) * share / of).cast("int") + 1)


def gimbal_stats(waypoints: DataFrame, up: float = 25.0, down: float = -85.0) -> DataFrame:
    """Pitch by rank without interpolation, distinct yaws to 0.1 degree, and the indexes of extreme rows."""
    look = waypoints.where("not is_transition")
    pitch = F.sort_array(F.collect_list("gimbal_pitch_deg"))
    g = look.groupBy("mission_id").agg(F.avg("gimbal_pitch_deg").alias("mean_pitch"), pitch.alias("v"), F.count_distinct(F.round("gimbal_yaw_deg", 1)).alias("distinct_yaw"), F.sort_array(F.collect_list(F.when(F.col("gimbal_pitch_deg") >= up, F.col("idx")))).alias("up_idx"), F.sort_array(F.collect_list(F.when(F.col("gimbal_pitch_deg") <= down, F.col("idx")))).alias("down_idx"))
    v = F.col("v")
    return g.select("mission_id", "mean_pitch", F.array_min(v).alias("min_pitch"), F.array_max(v).alias("max_pitch"), rank_stat(v, 1, 4).alias("p25"), rank_stat(v, 1, 2).alias("median"), rank_stat(v, 3, 4).alias("p75"), "distinct_yaw", F.size("up_idx").alias("n_up"), F.size("down_idx").alias("n_down"), F.slice("up_idx", 1, 10).alias("up_idx"), F.slice("down_idx", 1, 10).alias("down_idx"))


def five_number(df: DataFrame, key: str, value: str) -> DataFrame:
    """min, p25, median, p75, max with linear interpolation."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.groupBy(key).agg(q.alias("q")).select(key, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "max"))])


def path_totals(waypoints: DataFrame) -> DataFrame:
    """Metres in all, on transit (either end of a leg is one), and the share of inspection in percent."""
    p = paths.with_path(waypoints).withColumn("on_transit", F.col("is_transition") | F.coalesce(F.lag("is_transition").over(paths.path()), F.lit(False)))
    g = p.groupBy("mission_id").agg(F.sum("seg_m").alias("total_m"), F.coalesce(F.sum(F.when(F.col("on_transit"), F.col("seg_m"))), F.lit(0.0)).alias("transit_m"))
    return g.withColumn("efficiency_pct", F.when(F.col("total_m") > 0, (F.col("total_m") - F.col("transit_m")) / F.col("total_m") * 100).otherwise(0.0))


def orbit_radius(waypoints: DataFrame, default: float = 8.0) -> DataFrame:
    """Median level distance to the waypoints' mean; the default where it is 0.1 m or less."""
    mid = waypoints.groupBy("mission_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))
    return waypoints.join(mid, "mission_id").groupBy("mission_id").agg(F.median(d).alias("r")).select("mission_id", F.when(F.col("r") > 0.1, F.col("r")).otherwise(default).alias("radius_m"))


def cloud_stats(points: DataFrame) -> DataFrame:
    """Bounding box, height percentiles and points per square metre of footprint (1 m2 at least)."""
    g = points.groupBy("cloud_id").agg(F.count("*").alias("points"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.percentile("z", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    foot = F.greatest(F.lit(1.0), (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    return g.withColumns({"z_p5": F.col("q")[0], "z_p95": F.col("q")[1], "density": F.col("points") / foot}).drop("q")
