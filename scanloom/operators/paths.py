"""Windows over each mission's waypoints in index order."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scanloom.functions import angles


def path() -> WindowSpec:
    """A mission's rows in order."""
    return Window.partitionBy("mission_id").orderBy("idx")


def before() -> WindowSpec:
    return path().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return path().rowsBetween(Window.unboundedPreceding, 0)


def step(axis: str, back: int = 1) -> Column:
    return F.col(axis) - F.lag(axis, back).over(path())


def length(*axes: str) -> Column:
    return F.sqrt(sum((step(a) * step(a) for a in axes[1:]), step(axes[0]) * step(axes[0])))


#: Sums of multiples of 1 / GRAIN are exact up to 2 ** 53 / GRAIN.
GRAIN = float(1 << 20)


def running(c: Column) -> Column:
    """Sum of c so far, off by its last digit however many rows a mission has: the multiples of 1 / GRAIN add up without an error, what is left of them is small."""
    whole = F.rint(c * GRAIN) / GRAIN
    return F.sum(whole).over(so_far()) + F.sum(F.nanvl(c - whole, F.lit(0.0))).over(so_far())


def with_path(waypoints: DataFrame) -> DataFrame:
    """Add ``seg_m`` (0 at the start) and ``cum_m``."""
    seg = waypoints.withColumn("seg_m", F.coalesce(length("x", "y", "z"), F.lit(0.0)))
    return seg.withColumn("cum_m", running(F.col("seg_m")))


def timeline(waypoints: DataFrame, inspect_ms: float = 3.0, transit_ms: float = 9.0, dwell_s: float = 1.0) -> DataFrame:
    """Add ``t_s``: when each waypoint is left; inspection rows dwell, the first is at 0."""
    p = with_path(waypoints)
    gap = F.when(F.col("idx") == 0, 0.0).otherwise(F.col("seg_m") / F.when(F.col("is_transition"), transit_ms).otherwise(inspect_ms) + F.when(F.col("is_transition"), 0.0).otherwise(dwell_s))
    return p.withColumn("t_s", running(gap))


def adjacent_deltas(waypoints: DataFrame) -> DataFrame:
    """Pitch and (circular) heading change from the row before; the first row has none."""
    back = F.lag("gimbal_pitch_deg").over(path())
    return waypoints.withColumns({"pitch_jump": F.abs(F.col("gimbal_pitch_deg") - back), "yaw_jump": angles.angle_delta(F.col("heading_deg"), F.lag("heading_deg").over(path()))}).where("pitch_jump is not null")


def facade_transitions(waypoints: DataFrame) -> DataFrame:
    """Rows where inspection reaches another face than the last inspected one, with the turn from the row before."""
    inspected = F.when(~F.col("is_transition") & (F.col("facade_index") >= 0), F.col("facade_index"))
    rows = waypoints.withColumns({"from_facade": F.last(inspected, ignorenulls=True).over(before()), "turn_deg": angles.angle_delta(F.col("heading_deg"), F.lag("heading_deg").over(path()))})
    return rows.where("not is_transition and facade_index >= 0 and from_facade <> facade_index").select("mission_id", "idx", "from_facade", F.col("facade_index").alias("to_facade"), "turn_deg")


def near_duplicates(waypoints: DataFrame, within: float = 0.5, ahead: int = 4) -> DataFrame:
    """Inspection pairs under ``within`` metres among the next ``ahead`` rows."""
    pairs = None
    for k in range(1, ahead + 1):
        nxt = lambda c, k=k: F.lead(c, k).over(path())
        d = F.sqrt(sum(((F.col(a) - nxt(a)) * (F.col(a) - nxt(a)) for a in "yz"), (F.col("x") - nxt("x")) * (F.col("x") - nxt("x"))))
        hit = waypoints.withColumns({"other_idx": nxt("idx"), "distance_m": d, "other_transition": nxt("is_transition")})
        hit = hit.where(f"distance_m < {within} and not is_transition and not other_transition").select("mission_id", "idx", "other_idx", "distance_m")
        pairs = hit if pairs is None else pairs.unionByName(hit)
    return pairs


def reversals(waypoints: DataFrame, over_deg: float = 150.0, least: float = 0.1) -> DataFrame:
    """Rows where the level path turns by more than over_deg, both segments long enough and no transit among the three."""
    rows = waypoints.withColumns({
        "ax": step("x"), "ay": step("y"), "bx": F.lead("x").over(path()) - F.col("x"), "by": F.lead("y").over(path()) - F.col("y"),
        "calm": ~(F.col("is_transition") | F.lag("is_transition").over(path()) | F.lead("is_transition").over(path())),
    })
    la, lb = F.sqrt(F.expr("ax * ax + ay * ay")), F.sqrt(F.expr("bx * bx + by * by"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("ax * bx + ay * by") / (la * lb)))
    return rows.where((la >= least) & (lb >= least) & F.col("calm")).withColumn("turn_deg", F.degrees(F.acos(cos))).where(F.col("turn_deg") > over_deg).select("mission_id", "idx", "turn_deg")


def photo_interval(waypoints: DataFrame, speed: float = 3.0, interval_s: float = 0.5, least_m: float = 1.5) -> DataFrame:
    """Consecutive inspection rows of one face that come too soon and too close."""
    rows = waypoints.where("not is_transition").withColumns({"d": length("x", "y", "z"), "same": F.lag("facade_index").over(path()) == F.col("facade_index")})
    return rows.where(F.col("same") & (F.col("d") / speed < interval_s) & (F.col("d") < least_m)).select("mission_id", "idx", F.col("d").alias("distance_m"))


POSE = ("is_transition", "gimbal_pitch_deg", "gimbal_yaw_deg", "heading_deg")


def fold_poses(rows: Iterable[tuple], state: tuple, pitch_deg: float, heading_deg: float) -> tuple[list[bool], list[bool], tuple]:
    """(emit_gimbal, emit_heading, state) of POSE rows in order; state: the last commanded pitch, yaw and heading (null: none)."""
    none = lambda v: v is None or v != v
    turn = lambda a, b: abs((a - b + 180) % 360 - 180)
    pitch, yaw, heading = state
    gimbal, nose = [], []
    for transit, p, y, h in rows:
        a = b = False
        if not transit:
            a = none(pitch) or pitch_deg < 0 or (not none(p) and abs(p - pitch) > pitch_deg) or (not none(y) and not none(yaw) and turn(y, yaw) > pitch_deg)
            b = none(heading) or heading_deg < 0 or (not none(h) and turn(h, heading) > heading_deg)
            if a:
                pitch, yaw = p, yaw if none(y) else y
            if b:
                heading = h
        gimbal.append(a)
        nose.append(b)
    return gimbal, nose, (pitch, yaw, heading)


def dedupe_poses(waypoints: DataFrame, pitch_deg: float = 5.0, heading_deg: float = 5.0) -> DataFrame:
    """Which rows command the gimbal and the heading anew: ``mission_id, idx, emit_gimbal, emit_heading``.

    Each is compared with the last *commanded* value, so it is one ordered pass over
    a mission's rows (65,535 at most by the hardware limit). A missing yaw, pitch or heading counts as
    unchanged; a negative threshold switches folding off. Transit rows command nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        a, b, _ = fold_poses(zip(*(pdf[c].tolist() for c in POSE), strict=True), (None, None, None), pitch_deg, heading_deg)
        return pd.DataFrame({"mission_id": pdf["mission_id"], "idx": pdf["idx"], "emit_gimbal": a, "emit_heading": b})

    kind = dict(waypoints.dtypes)
    shape = f"mission_id {kind['mission_id']}, idx {kind['idx']}, emit_gimbal boolean, emit_heading boolean"
    return waypoints.select("mission_id", "idx", *POSE).groupBy("mission_id").applyInPandas(run, shape)
