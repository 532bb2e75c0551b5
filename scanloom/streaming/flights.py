"""Flight events as streams. Every function takes and returns a DataFrame, so the batch twin is the same code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators import paths

WATERMARK = "10 minutes"


def action_rate(events: DataFrame, width: str = "1 second", slide: str | None = None) -> DataFrame:
    """Actions per window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", WATERMARK).where("is_action").groupBy(w.alias("w")).agg(F.count("*").alias("actions"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "actions")


def rate_report(rates: DataFrame) -> DataFrame:
    """Mean and peak of finished windows."""
    return rates.agg(F.avg("actions").alias("sustained"), F.max("actions").alias("peak"), F.count("*").alias("windows"))


def sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Runs of a flight, split where it is silent for longer than the gap."""
    g = events.withWatermark("ts", WATERMARK).groupBy("flight_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.max("waypoint_index").alias("max_waypoint"), F.max("ts").alias("last_ts"))
    return g.select("flight_id", F.col("s.start").alias("started"), "last_ts", "events", "max_waypoint")


def planned_actual(events: DataFrame, planned: DataFrame) -> DataFrame:
    """Events with the planned pose of their waypoint: a stream-static join."""
    p = planned.select(F.col("mission_id").alias("flight_id"), F.col("idx").alias("waypoint_index"), "x", "y", "z", "heading_deg")
    return events.join(p, ["flight_id", "waypoint_index"])


STATE_OUT = "flight_id long, mission_state int, entered timestamp, left timestamp, events long"


def state_intervals(events: DataFrame) -> DataFrame:
    """How long a flight stays in each mission state, as a stream: a row when the state changes or the flight falls silent for ten minutes.

    Events of one trigger are taken in time order; an event before the state's last
    one is counted but moves nothing.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.getOption
        out = []
        if state.hasTimedOut:
            out.append((key[0], current[0], pd.Timestamp(current[1], unit="us"), pd.Timestamp(current[2], unit="us"), current[3]))
            state.remove()
        else:
            rows = sorted((int(t.value // 1000), int(s)) for pdf in batches for t, s in zip(pdf["ts"], pdf["mission_state"], strict=True))
            for t, s in rows:
                if current is None:
                    current = (s, t, t, 1)
                elif s == current[0] or t < current[2]:
                    current = (current[0], current[1], max(current[2], t), current[3] + 1)
                else:
                    out.append((key[0], current[0], pd.Timestamp(current[1], unit="us"), pd.Timestamp(t, unit="us"), current[3]))
                    current = (s, t, t, 1)
            state.update(current)
            state.setTimeoutTimestamp(max(current[2] // 1000, state.getCurrentWatermarkMs()) + 600_000)
        yield pd.DataFrame(out, columns=["flight_id", "mission_state", "entered", "left", "events"])

    return events.withWatermark("ts", WATERMARK).select("flight_id", "ts", "mission_state").groupBy("flight_id").applyInPandasWithState(run, STATE_OUT, "s int, a long, b long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def state_intervals_batch(events: DataFrame) -> DataFrame:
    """The same intervals of a finished table by windows; the last of each flight ends with its last event."""
    w = Window.partitionBy("flight_id").orderBy("ts", "mission_state")
    change = F.coalesce((F.col("mission_state") != F.lag("mission_state").over(w)).cast("int"), F.lit(0))
    rows = events.withColumn("run", change)
    rows = rows.withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("flight_id", "run", "mission_state").agg(F.min("ts").alias("entered"), F.max("ts").alias("last"), F.count("*").alias("events"))
    nxt = F.lead("entered").over(Window.partitionBy("flight_id").orderBy("run"))
    return g.select("flight_id", "mission_state", "entered", F.coalesce(nxt, "last").alias("left"), "events")


POSES_OUT = "mission_id long, idx int, emit_gimbal boolean, emit_heading boolean"


def pose_commands(waypoints: DataFrame, pitch_deg: float = 5.0, heading_deg: float = 5.0) -> DataFrame:
    """:func:`scanloom.operators.paths.dedupe_poses` of a stream: a mission's state is its last commanded pitch, yaw and heading.

    Rows of one trigger are taken in index order; a row that comes after a later one was taken is folded when it comes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("idx", kind="stable")
        gimbal, nose, last = paths.fold_poses(zip(*(pdf[c].tolist() for c in paths.POSE), strict=True), state.getOption or (None, None, None), pitch_deg, heading_deg)
        state.update(tuple(None if v is None or v != v else float(v) for v in last))
        yield pd.DataFrame({"mission_id": key[0], "idx": pdf["idx"], "emit_gimbal": gimbal, "emit_heading": nose})

    return waypoints.select("mission_id", "idx", *paths.POSE).groupBy("mission_id").applyInPandasWithState(run, POSES_OUT, "p double, y double, h double", "append", GroupStateTimeout.NoTimeout)


def voxel_accumulation(points: DataFrame, size: float) -> DataFrame:
    """Running mean of each cell, for update mode."""
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"i{a}") for a in "xyz"]
    return points.groupBy("cloud_id", *cells).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"))
