"""Fleet reports: seeds, aim quality, versions, comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import angles, geo, vec
from scanloom.operators import clouds, joins, ordering, paths
from scanloom.session import kept


def mission_seeds(waypoints: DataFrame, facades: DataFrame, key: str = "building_id") -> DataFrame:
    """Stand-off of flown missions: median of the lower nine tenths of the distances to the plane of the face nearest on the map, in 1..15 m."""
    f = facades.select(key, "facade_index", F.col("cx").alias("x"), F.col("cy").alias("y"), "nx", "ny", "nz", "cz")
    look = waypoints.where("not is_transition").withColumnRenamed("facade_index", "own_face")
    near = joins.nearest(look, f.select(key, "facade_index", "x", "y"), key, [key, "mission_id", "idx"], "facade_index", axes="xy").drop("distance")
    rows = look.select(key, "mission_id", "idx", "x", "y", "z").join(near, [key, "mission_id", "idx"]).join(joins.small(f.withColumnsRenamed({"x": "cx", "y": "cy"})), [key, "facade_index"])
    d = F.abs(vec.dot(vec.sub(vec.at(), vec.at("cx", "cy", "cz")), vec.at("nx", "ny", "nz")))
    w = Window.partitionBy("mission_id")
    rows = rows.withColumn("d", d).withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy("d", "idx"))})
    low = rows.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.9)))
    return low.groupBy("mission_id").agg(F.median("d").alias("m"), F.any_value("n").alias("waypoints")).select("mission_id", "waypoints", F.greatest(F.lit(1.0), F.least(F.lit(15.0), F.col("m"))).alias("standoff_m"))


def aim_quality(waypoints: DataFrame, facades: DataFrame, reaches: tuple[float, ...] = (20.0, 40.0, 60.0), key: str = "building_id") -> DataFrame:
    """Share of inspection rows with a face to aim at and the mean weight of the picks, per reach and mission.

    Every reach is judged on one join: its candidates are those of the widest that are near enough.
    """
    f = facades.select(key, F.col("facade_index").alias("f_index"), "label", "nx", "ny", "nz", "cx", "cy", "cz")
    look = waypoints.where("not is_transition").select(key, "mission_id", "idx", "x", "y", "z")
    off = vec.sub(vec.at(), vec.at("cx", "cy", "cz"))
    rows = look.join(joins.small(f), key).withColumns({"s": vec.dot(off, vec.at("nx", "ny", "nz")), "d": vec.norm(off)}).where((F.col("s") > 0) & (F.col("d") <= max(reaches)))
    rows = rows.withColumn("w", F.col("d") * F.when(F.col("label").endswith("_wall"), 0.5).otherwise(1.0)).withColumn("reach", F.explode(F.array(*[F.lit(r) for r in reaches]))).where("d <= reach")
    best = rows.groupBy("reach", "mission_id", "idx").agg(F.min("w").alias("w"))
    n = look.groupBy("mission_id").agg(F.count("*").alias("n"))
    g = best.groupBy("reach", "mission_id").agg(F.count("*").alias("aimed"), F.avg("w").alias("mean_weight"))
    return g.join(n, "mission_id").select("reach", "mission_id", "aimed", (F.col("aimed") / F.col("n") * 100).alias("aimed_pct"), "mean_weight")


#: Rows of a mission whose cameras are dealt together, and pairs that numpy looks at together.
CAMERAS, PAIRS = 65_536, 500_000


def _scores(cams: pd.DataFrame, to: np.ndarray, reach: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of cams, cosine to the view, distance, score) from cameras to places, PAIRS at a time; the score is -inf for what a camera doesn't see."""
    at, v = cams[["x", "y", "z"]].to_numpy(float), cams[["vx", "vy", "vz"]].to_numpy(float)
    step, least = max(1, PAIRS // max(1, len(to))), math.cos(math.radians(45.0))
    for i in range(0, len(at), step):
        rows = slice(i, i + step)
        x, y, z = (to[None, :, a] - at[rows, None, a] for a in range(3))
        d = np.sqrt(x * x + y * y + z * z)
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = (x * v[rows, None, 0] + y * v[rows, None, 1] + z * v[rows, None, 2]) / d
            score = np.where((d > 0.5) & (d <= reach) & (cos >= least), cos - 0.001 * d / reach, -np.inf)
        yield rows, cos, d, score


def _open_cells(reach: float, half: float, cells: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cameras with the cells whose sphere may hold a better place than the best of the places that stand for the cells."""
    least = math.cos(math.radians(45.0))

    def run(cams: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        who, which = [np.zeros(0, int)], [np.zeros(0, int)]
        own = _scores(cams, some[["px", "py", "pz"]].to_numpy(float), reach)
        for (rows, cos, far, _), (_, _, _, score) in zip(_scores(cams, some[["x", "y", "z"]].to_numpy(float), reach), own, strict=True):
            if not len(some):
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                sin = np.minimum(1.0, half / far)
                edge, cos = np.sqrt(1 - sin * sin), np.clip(cos, -1.0, 1.0)
                top = np.where((far <= half + 1e-6) | (cos >= edge), 1.0, cos * edge + np.sqrt(1 - cos * cos) * sin)
            bound = top - 0.001 * np.maximum(0.0, far - half) / reach
            a, b = np.nonzero((far <= reach + half) & (top >= least - 1e-9) & (bound >= score.max(axis=1)[:, None] - 1e-8))
            who.append(a + rows.start)
            which.append(b)
        found = cams.iloc[np.concatenate(who)].reset_index(drop=True)
        for c in cells:
            found[c] = some[c].to_numpy()[np.concatenate(which)]
        return found

    return run


def _best_places(reach: float, cells: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cameras with the places of their open cells that score best in their cell, and those that rounding may put beside them."""

    def run(cams: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        parts, held = [], places.groupby(cells, sort=False).indices
        xyz, ids = places[["x", "y", "z"]].to_numpy(float), places["point_id"].to_numpy()
        for cell, who in cams.groupby(cells, sort=False).indices.items():
            own, here = cams.iloc[who], held.get(cell, np.zeros(0, int))
            for rows, cos, d, score in _scores(own, xyz[here], reach) if len(here) else ():
                a, b = np.nonzero((score > -np.inf) & (score >= score.max(axis=1)[:, None] - 4e-9))
                of = who[a + rows.start]
                parts.append(pd.DataFrame({"mission_id": cams["mission_id"].to_numpy()[of], "idx": cams["idx"].to_numpy()[of], "point_id": ids[here[b]], "cos": cos[a, b], "d": d[a, b]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["mission_id", "idx", "point_id", "cos", "d"])

    return run


def cone_targets(waypoints: DataFrame, points: DataFrame, reach: float = 60.0, key: str = "building_id", cell: float = 0.5) -> DataFrame:
    """The cloud point each camera looks at best: within reach (over 0.5 m) and 45 degrees of the view, most central, a
    little nearer on ties, then the lower id: ``mission_id, idx, point_id, off_deg``.

    Points at one place count once, by their lowest id. Cameras, dealt by blocks of space and parts of their mission, meet the cells of the
    cloud first. A cell has a bound that none of its places can beat, from its sphere, and the score of one place of its own; only the places of
    cells that can still win are compared. Pairs stay inside a task: what leaves it is a row a camera and open cell.
    """
    fwd = angles.camera_forward(F.col("heading_deg"), F.col("gimbal_yaw_deg"), F.col("gimbal_pitch_deg"))
    cells, half = ["cx", "cy", "cz"], cell * math.sqrt(3) / 2
    part, block = ["mission_id", "part"], ["bx", "by", "bz"]
    at = [F.col(a).cast("double").alias(a) for a in "xyz"]
    w = waypoints.where("not is_transition").select(key, "mission_id", "idx", F.floor(F.col("idx") / CAMERAS).alias("part"), *at, fwd.alias("v"))
    w = w.select(key, "mission_id", "idx", "part", "x", "y", "z", *[F.col(f"v.{a}").alias(f"v{a}") for a in "xyz"]).withColumns({f"b{a}": F.floor(F.col(a) / reach) for a in "xyz"})
    places = points.select(key, "point_id", *at).groupBy(key, "x", "y", "z").agg(F.min("point_id").alias("point_id"))
    places = kept(places, "cone-places")
    w = kept(w.join(places.select(key).distinct(), key, "left_semi"), "cone-cameras")
    filed = places.withColumns({f"c{a}": F.floor(F.col(a) / cell) for a in "xyz"})
    some = filed.groupBy(key, *cells).agg(F.min_by(F.struct(*[F.col(a).alias(f"p{a}") for a in "xyz"]), "point_id").alias("one"))
    some = some.select(key, *cells, "one.*", *[((F.col(f"c{a}") + 0.5) * cell).alias(a) for a in "xyz"])
    for a in "xyz":
        some = some.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - reach - half) / reach), F.floor((F.col(a) + reach + half) / reach))))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides of a cogroup come from one table
    near = fresh(some.join(w.select(key, *part, *block).distinct(), [key, *block]))
    types = dict(w.dtypes) | dict(filed.dtypes)
    columns = lambda names: ", ".join(f"{c} {types[c]}" for c in names)
    dealt = [key, *part, *block]
    seen = [key, "mission_id", "idx", "part", "x", "y", "z", "vx", "vy", "vz", *cells]
    open_cells = _open_cells(reach, half, cells)
    # Cells go to a task by blocks of 4 x 4 x 4, as a group of one costs more than its pairs.
    wide = {f"g{a}": F.floor(F.col(f"c{a}") / 4) for a in "xyz"}
    # The reach of a camera is tested in the task, so a block may hold cells that none of its cameras sees.
    open_ = w.groupBy(*dealt).cogroup(near.groupBy(*dealt)).applyInPandas(lambda a, b: open_cells(a, b)[seen], columns(seen))
    open_ = kept(open_, "cone-cells").withColumns(wide)
    there = fresh(filed.join(open_.select(key, *cells, *part).distinct(), [key, *cells]).withColumns(wide))
    met = [key, *wide, *part]
    rows = open_.groupBy(*met).cogroup(there.groupBy(*met)).applyInPandas(_best_places(reach, cells), columns(["mission_id", "idx", "point_id"]) + ", cos double, d double")
    score = F.col("cos") - 0.001 * F.col("d") / reach
    best = rows.groupBy("mission_id", "idx").agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("point_id")).alias("p"), "cos")).alias("m"))
    return best.select("mission_id", "idx", (-F.col("m.p")).alias("point_id"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("m.cos"))))).alias("off_deg"))


def aim_verification(waypoints: DataFrame, targets: DataFrame, max_aim_deg: float = 15.0, jump_deg: float = 30.0) -> DataFrame:
    """One row a mission: inspection rows, those without a target, those within max_aim_deg of it, the spread of the
    aim error, of the pitch and of the changes of pitch and yaw between neighbours among the inspection rows.

    targets: :func:`cone_targets`. Shares are of all inspection rows, that of jumps of all neighbours; a mission of one row has no jumps.
    """
    look = waypoints.where("not is_transition").withColumn("yaw", F.coalesce("gimbal_yaw_deg", "heading_deg"))
    back = lambda c: F.lag(c).over(paths.path())
    look = look.withColumns({"dp": F.abs(F.col("gimbal_pitch_deg") - back("gimbal_pitch_deg")), "dy": angles.angle_delta(F.col("yaw"), back("yaw"))})
    rows = look.join(targets.select("mission_id", "idx", "off_deg"), ["mission_id", "idx"], "left")
    p = F.col("gimbal_pitch_deg")
    g = rows.groupBy("mission_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("off_deg").isNull()).alias("no_hit"), F.count_if(F.col("off_deg") <= max_aim_deg).alias("on_target"),
        F.median("off_deg").alias("aim_median"), F.avg("off_deg").alias("aim_mean"), F.percentile("off_deg", 0.9).alias("aim_p90"), F.max("off_deg").alias("aim_max"),
        F.count_if(p > 25).alias("pitch_up"), F.count_if(p < -85).alias("pitch_down"), F.count_if((p > -30) & (p < 10)).alias("pitch_level"),
        F.median("dp").alias("pitch_jump_median"), F.percentile("dp", 0.9).alias("pitch_jump_p90"), F.median("dy").alias("yaw_jump_median"), F.percentile("dy", 0.9).alias("yaw_jump_p90"),
        F.count_if(F.col("dy") > jump_deg).alias("yaw_jumps"),
    )
    share = lambda c: F.col(c) / F.col("n") * 100
    return g.withColumns({"no_hit_pct": share("no_hit"), "on_target_pct": share("on_target"), "yaw_jumps_pct": F.col("yaw_jumps") / F.nullif(F.col("n") - 1, F.lit(0)) * 100})


def latest(rows: DataFrame, key: list[str], when: str, tie: str) -> DataFrame:
    """The last written row of every key."""
    w = Window.partitionBy(*key).orderBy(F.desc(when), F.desc(tie))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def worst(rows: DataFrame, key: str, by: Column, n: int, tie: str) -> DataFrame:
    """The n rows of every key with the largest value."""
    w = Window.partitionBy(key).orderBy(by.desc(), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unseen(rows: DataFrame, processed: DataFrame, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint isn't among the processed ones."""
    return rows.join(processed.select(fingerprint).distinct(), fingerprint, "left_anti")


def version_diff(a: DataFrame, b: DataFrame, key: str = "building_id") -> DataFrame:
    """Faces and sizes of two versions of every building: counts and changes."""
    s = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"faces_{n}"), F.round(F.sum("area_m2"), 2).alias(f"area_{n}"))
    both = s(a, "a").join(s(b, "b"), key, "full").na.fill(0)
    return both.withColumns({"faces_change": F.col("faces_b") - F.col("faces_a"), "area_change": F.round(F.col("area_b") - F.col("area_a"), 2)})


def transit_m(groups: DataFrame, order: DataFrame, key: str = "mission_id") -> DataFrame:
    """Metres from the last waypoint of each face to the first of the next in an order ``key, position, facade_index``."""
    ends = groups.select(key, F.explode("groups").alias("g")).select(key, F.col("g.g").alias("facade_index"), "g.*").drop("g")
    rows = order.join(ends, [key, "facade_index"])
    w = Window.partitionBy(key).orderBy("position")
    d = F.sqrt(sum((F.pow(F.col(f"f{a}") - F.lag(f"l{a}").over(w), 2) for a in "yz"), F.pow(F.col("fx") - F.lag("lx").over(w), 2)))
    return rows.withColumn("d", d).groupBy(key).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("transit_m"))


def order_benchmark(waypoints: DataFrame) -> DataFrame:
    """Transit of every mission under each ordering, and what it saves against the face order."""
    g = ordering.face_groups(waypoints)
    plain = transit_m(g, g.select("mission_id", F.posexplode(F.transform("groups", lambda x: x["g"])).alias("position", "facade_index")))
    tour = transit_m(g, ordering.nearest_neighbour_tour(g))
    rows = plain.withColumn("method", F.lit("faces")).unionByName(tour.withColumn("method", F.lit("nearest_neighbour")))
    return rows.join(plain.withColumnRenamed("transit_m", "before"), "mission_id").select("mission_id", "method", "transit_m", (F.col("before") - F.col("transit_m")).alias("saved_m"))


def prepare_scan(points: DataFrame, above: float = 1.0, size: float = 0.10) -> DataFrame:
    """Points strictly ``above`` their cloud's fifth height percentile (all where that leaves none), one mean per cell."""
    q = points.groupBy("cloud_id").agg(F.percentile("z", 0.05).alias("q"), F.max("z").alias("top"))
    kept = points.join(joins.small(q), "cloud_id").where((F.col("z") > F.col("q") + above) | (F.col("top") <= F.col("q") + above))
    return clouds.voxel_downsample(kept, size)


def frustum(waypoints: DataFrame, fov_deg: float = 84.0, aspect: float = 0.75, length: float = 1.0) -> DataFrame:
    """Apex and four far corners of each camera's view as ``corners``."""
    fwd = angles.camera_forward(F.col("heading_deg"), F.col("gimbal_yaw_deg"), F.col("gimbal_pitch_deg"))
    h = F.radians(F.coalesce("gimbal_yaw_deg", "heading_deg"))
    rows = waypoints.withColumns({"v": fwd, "r": F.struct(F.cos(h).alias("x"), (-F.sin(h)).alias("y"), F.lit(0.0).alias("z"))})
    rows = rows.withColumn("u", vec.cross(F.col("r"), F.col("v")))
    half = F.tan(F.radians(F.lit(fov_deg / 2)))
    corner = lambda sx, sy: vec.add(vec.at(), vec.scale(vec.add(F.col("v"), vec.add(vec.scale(F.col("r"), half * sx), vec.scale(F.col("u"), half * aspect * sy))), F.lit(length)))
    return rows.withColumn("corners", F.array(vec.at(), corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).drop("v", "r", "u")


def sample_capped(points: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points of each cloud: one per cell of the size that would hold them evenly, then the first by a hash of the id."""
    box = points.groupBy("cloud_id").agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"])
    size = F.greatest(F.lit(0.01), F.cbrt(F.col("dx") * F.col("dy") * F.col("dz") / most))
    rows = points.join(joins.small(box.select("cloud_id", size.alias("s"))), "cloud_id")
    cells = [F.floor(F.col(a) / F.col("s")).cast("long").alias(f"i{a}") for a in "xyz"]
    first = rows.groupBy("cloud_id", *cells).agg(F.min_by(F.struct("point_id", "x", "y", "z"), "point_id").alias("p")).select("cloud_id", "p.*")
    w = Window.partitionBy("cloud_id").orderBy(F.md5(F.concat_ws("|", "cloud_id", "point_id")), "point_id")
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def viewer_payload(facades: DataFrame, key: str = "building_id") -> DataFrame:
    """``key, payload``: faces of a building as JSON, coordinates to 2 decimals, labels escaped."""
    corner = F.transform("vertices", lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"), F.round(p["z"], 2).alias("z")))
    item = F.struct("facade_index", geo.html_escape(F.col("label")).alias("label"), corner.alias("vertices"))
    return facades.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def transform_delta(a: list[float], b: list[float]) -> tuple[Column, Column]:
    """(degrees, metres) between two row-major 4x4 rigid transforms."""
    trace = sum(a[4 * i + k] * b[4 * i + k] for i in range(3) for k in range(3))
    shift = sum((a[4 * i + 3] - b[4 * i + 3]) ** 2 for i in range(3))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit((trace - 1) / 2))))), F.sqrt(F.lit(shift))


def worst_turns(waypoints: DataFrame, n: int = 10) -> DataFrame:
    return worst(paths.adjacent_deltas(waypoints), "mission_id", F.col("yaw_jump"), n, "idx")
