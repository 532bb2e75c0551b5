"""Spatial joins: grid-cell equi-joins followed by the exact test."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import angles, vec

#: Rows of the smaller side up to which a join may broadcast it; beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows (counted first), else for a shuffle."""
    return marker(df)(df)


def marker(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks df, and tables made from its rows, for their joins: see :func:`small`."""
    return F.broadcast if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled


def shuffled(df: DataFrame) -> DataFrame:
    """df, marked for a sort-merge join: what is exploded from a small file looks as small as that file, and would be broadcast at any size."""
    return df.hint("merge")


def _cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / F.lit(size)).cast("long")


def within(a: DataFrame, b: DataFrame, r: float, key: str, axes: str = "xyz") -> DataFrame:
    """All pairs of a row of a and a row of b with equal key at most r apart, as structs ``a, b`` and ``distance``.

    b is filed in cells of size r; each row of a looks into its own cell and the
    neighbours (27 in space). Both sides shuffle by (key, cell), so one crowded
    key is many cells and a skewed cell can be split by AQE.
    """
    cells = [f"c{i}" for i in range(len(axes))]
    left = a.select(F.struct("*").alias("a"), F.col(key).alias("k"), *[_cell(x, r).alias(c) for x, c in zip(axes, cells, strict=True)])
    for c in cells:
        left = left.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    right = b.select(F.struct("*").alias("b"), F.col(key).alias("k"), *[_cell(x, r).alias(c) for x, c in zip(axes, cells, strict=True)])
    d = F.sqrt(sum((F.pow(F.col("a")[x] - F.col("b")[x], 2) for x in axes[1:]), F.pow(F.col("a")[axes[0]] - F.col("b")[axes[0]], 2)))
    return left.join(right, ["k", *cells]).select("a", "b", d.alias("distance")).where(F.col("distance") <= r)


def nearest(a: DataFrame, b: DataFrame, key: str, a_id: list[str], b_id: str, axes: str = "xyz") -> DataFrame:
    """The nearest row of b with the same key for each row of a (ties: least b_id): ``a_id, b_id, distance``.

    For a b side with few rows a key, such as faces of a building: an equi-join on the key and an argmin.
    """
    left = a.select(key, *[c for c in a_id if c != key], *[F.col(x).alias(f"a_{x}") for x in axes])
    right = b.select(key, F.col(b_id).alias("b_id"), *[F.col(x).alias(f"b_{x}") for x in axes])
    d = F.sqrt(sum((F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) for x in axes[1:]), F.pow(F.col(f"a_{axes[0]}") - F.col(f"b_{axes[0]}"), 2)))
    ids = [key, *[c for c in a_id if c != key]]
    best = left.join(small(right), key).withColumn("d", d).groupBy(*ids).agg(F.min(F.struct("d", "b_id")).alias("m"))
    return best.select(*ids, F.col("m.b_id").alias(b_id), F.col("m.d").alias("distance"))


def pick_facade(waypoints: DataFrame, facades: DataFrame, key: str = "building_id", reach: float = 60.0) -> DataFrame:
    """The face each waypoint should look at: in front of it, within reach, the least weighted
    distance (walls count half), first index on ties. Adds ``picked, weight`` (null without one)."""
    f = facades.select(key, F.col("facade_index").alias("f_index"), F.col("label").alias("f_label"), "nx", "ny", "nz", "cx", "cy", "cz")
    rows = waypoints.where("not is_transition").select(key, "mission_id", "idx", "x", "y", "z").join(small(f), key)
    off = vec.sub(vec.at(), vec.at("cx", "cy", "cz"))
    rows = rows.withColumns({"signed": vec.dot(off, vec.at("nx", "ny", "nz")), "d": vec.norm(off)})
    weight = F.col("d") * F.when(F.col("f_label").startswith("wall_") | F.col("f_label").endswith("_wall"), 0.5).otherwise(1.0)
    best = rows.where((F.col("signed") > 0) & (F.col("d") <= reach)).groupBy("mission_id", "idx").agg(F.min(F.struct(weight.alias("w"), "f_index", "cx", "cy", "cz")).alias("m"))
    out = waypoints.join(best, ["mission_id", "idx"], "left")
    return out.withColumns({"picked": F.col("m.f_index"), "weight": F.col("m.w"), "tx": F.col("m.cx"), "ty": F.col("m.cy"), "tz": F.col("m.cz")}).drop("m")


def reaim(waypoints: DataFrame, facades: DataFrame, key: str = "building_id", margin: float = 2.0) -> DataFrame:
    """Gimbal yaw and pitch towards the centre of the picked face; rows without one stay as they are."""
    rows = pick_facade(waypoints, facades, key)
    yaw, pitch = angles.look_at(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("tz") - F.col("z"), margin)
    hit = F.col("picked").isNotNull()
    return rows.withColumns({
        "gimbal_yaw_deg": F.when(hit, angles.heading_fold(yaw)).otherwise(F.col("gimbal_yaw_deg")),
        "gimbal_pitch_deg": F.when(hit, pitch).otherwise(F.col("gimbal_pitch_deg")),
        "facade_index": F.coalesce("picked", F.lit(-1)),
    }).drop("picked", "weight", "tx", "ty", "tz")


def interval_groups(waypoints: DataFrame, groups: DataFrame) -> DataFrame:
    """First group (by its order) whose [start_idx, end_idx] holds the waypoint: ``mission_id, idx, group_no`` (null without one).

    Groups are exploded into the indexes they cover (65,535 a mission at most), so the join is on equal keys.
    """
    spans = groups.select("mission_id", "group_no", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    first = spans.groupBy("mission_id", "idx").agg(F.min("group_no").alias("group_no"))
    return waypoints.select("mission_id", "idx").join(first, ["mission_id", "idx"], "left")


def cross_facade_duplicates(waypoints: DataFrame, radius: float = 1.5, max_deg: float = 20.0) -> DataFrame:
    """Rows to drop: near a row of a lower face of the mission with like pitch and yaw (a missing yaw is 0).

    Equal poses of a mission are judged once. Poses are dealt to blocks of space with a margin; what leaves a block is a row a pose
    with the lowest face near it, never a pair.
    """
    from scanloom.operators.neighbours import blocks, pairs_in

    pose = ["mission_id", "x", "y", "z", "pitch", "yaw"]
    w = waypoints.select("mission_id", "idx", "facade_index", *[(F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"], (F.col("gimbal_pitch_deg").cast("double") + 0.0).alias("pitch"), (F.coalesce("gimbal_yaw_deg", F.lit(0.0)).cast("double") + 0.0).alias("yaw"))
    w = w.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in pose[1:]) + " and facade_index is not null")
    poses = w.groupBy(*pose).agg(F.min("facade_index").alias("low"), F.max("facade_index").alias("high"))
    reach = radius + 1e-6

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, pitch, yaw = pdf[["x", "y", "z"]].to_numpy(), pdf["pitch"].to_numpy(), pdf["yaw"].to_numpy()
        low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        near, mine = low.copy(), np.flatnonzero(pdf["own"].to_numpy() & (high > low.min()))
        for face in np.unique(low):  # a pose is done with the first face that is near it
            ask = mine[(high[mine] > face) & (near[mine] > face)]
            for _, who, b, _ in pairs_in(xyz, ask, reach, np.flatnonzero(low == face)) if len(ask) else ():
                a = ask[who]
                turn, off = np.abs(yaw[a] - yaw[b]), xyz[a] - xyz[b]
                off = off * off
                like = (np.abs(pitch[a] - pitch[b]) <= max_deg) & (np.where(turn > 180, 360 - turn, turn) <= max_deg)
                near[a[like & (np.sqrt(off[:, 0] + off[:, 1] + off[:, 2]) <= radius)]] = face
        return pdf.assign(near=near)[[*pose, "near"]].iloc[mine]

    kinds = dict(w.dtypes)
    shape = f"mission_id {kinds['mission_id']}, " + ", ".join(f"{c} double" for c in pose[1:]) + f", near {kinds['facade_index']}"
    found = blocks(poses, 8 * reach, reach).groupBy("mission_id", "bx", "by", "bz").applyInPandas(run, shape)
    found = found.select(*[F.col(c).alias(c) for c in found.columns])
    return w.join(found, pose).where("facade_index > near").select("mission_id", "idx").distinct()


def drop_cross_facade_duplicates(waypoints: DataFrame, radius: float = 1.5, max_deg: float = 20.0) -> DataFrame:
    return waypoints.join(cross_facade_duplicates(waypoints, radius, max_deg), ["mission_id", "idx"], "left_anti")


def pose_at(timeline: DataFrame, times: DataFrame) -> DataFrame:
    """As-of join: the pose at each time ``mission_id, at_s`` on a timeline with ``t_s``.

    Both are put in one ordered stream per mission, and each time takes the last
    waypoint before it and the first at or after it (of equal times by idx); the place between them
    is eased on transit. Both windows run on from row to row, forwards and backwards: a frame of all rows to come would be gone through again by every row.
    """
    keep = F.struct("idx", "t_s", "x", "y", "z", "is_transition")
    p = timeline.select("mission_id", F.col("t_s").alias("at"), F.lit(1).alias("kind"), keep.alias("w"))
    q = times.select("mission_id", F.col("at_s").cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(p.schema["w"].dataType).alias("w"))
    order, so_far = ("at", "kind", "w.idx"), (Window.unboundedPreceding, -1)
    ahead, back = (Window.partitionBy("mission_id").orderBy(*[turn(c) for c in order]).rowsBetween(*so_far) for turn in (F.asc, F.desc))
    both = p.unionByName(q).withColumns({"a": F.last("w", ignorenulls=True).over(ahead), "b": F.last("w", ignorenulls=True).over(back)})
    rows = both.where("kind = 0").withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")})
    span = F.col("b.t_s") - F.col("a.t_s")
    f = F.when(span > 0, (F.col("at") - F.col("a.t_s")) / span).otherwise(0.0)
    f = F.when(F.col("b.is_transition"), f * f * (3 - 2 * f)).otherwise(f)
    return rows.select("mission_id", F.col("at").alias("at_s"), F.col("a.idx").alias("from_idx"), *[(F.col(f"a.{x}") + (F.col(f"b.{x}") - F.col(f"a.{x}")) * f).alias(x) for x in "xyz"])


def before_after(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes of pitch and yaw by position, per mission: counts over 0.5, 1 and 5 degrees."""
    on = ["mission_id", "idx"]
    rows = a.select(*on, F.col("gimbal_pitch_deg").alias("p0"), F.col("gimbal_yaw_deg").alias("y0")).join(b.select(*on, F.col("gimbal_pitch_deg").alias("p1"), F.col("gimbal_yaw_deg").alias("y1")), on).where("p0 is not null and p1 is not null and y0 is not null and y1 is not null")
    rows = rows.withColumns({"dp": F.abs(F.col("p1") - F.col("p0")), "dy": angles.angle_delta(F.col("y1"), F.col("y0"))})
    change = F.greatest("dp", "dy")
    return rows.groupBy("mission_id").agg(F.count("*").alias("compared"), F.avg("dp").alias("mean_pitch"), F.max("dy").alias("max_yaw"), *[F.count_if(change >= t).alias(f"over_{n}") for n, t in (("half", 0.5), ("one", 1.0), ("five", 5.0))])


def uncovered(facades: DataFrame, waypoints: DataFrame, key: str = "building_id", least_m2: float = 2.0) -> DataFrame:
    """Faces of at least least_m2 that no inspection row looks at."""
    seen = waypoints.where("not is_transition").select(key, "facade_index").distinct()
    return facades.where(F.col("area_m2") >= least_m2).join(seen, [key, "facade_index"], "left_anti")


def ray_hits(looks: DataFrame, points: DataFrame, key: str, reach: float = 0.5, every: float = 0.5, share: float = 0.95, more_than: int = 5) -> DataFrame:
    """Looks (``key, id, x, y, z, tx, ty, tz``) along which some sample has more than ``more_than`` points within reach: ``key, id, hits``."""
    # Looks that are taken again and points at one place are counted once; a place counts as often as points lie there.
    look = [key, "x", "y", "z", "tx", "ty", "tz"]
    looks = looks.select(key, "id", *[(F.col(c).cast("double") + 0.0).alias(c) for c in look[1:]])
    once = looks.groupBy(*look).agg(F.min("id").alias("id"))
    places = points.groupBy(key, "x", "y", "z").agg(F.count("*").alias("points"))
    n = F.greatest(F.lit(2), F.ceil(F.sqrt(F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2) + F.pow(F.col("tz") - F.col("z"), 2)) * share / every).cast("int"))
    s = once.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    f = F.col("k") / F.col("n") * share
    s = s.select(key, "id", "k", *[(F.col(a) + (F.col(f"t{a}") - F.col(a)) * f).alias(a) for a in "xyz"])
    found = within(s, places, reach, key)
    hits = found.groupBy(F.col(f"a.{key}").alias(key), F.col("a.id").alias("id"), F.col("a.k").alias("k")).agg(F.sum("b.points").alias("n")).where(F.col("n") > more_than).groupBy(key, "id").agg(F.max("n").alias("hits"))
    return looks.join(once.join(hits, [key, "id"]).drop("id"), look).select(key, "id", "hits")
