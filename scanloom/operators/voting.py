"""Planes and wall lines of scan clouds by hypothesis voting, all clouds at once.

A round draws a bounded sample of every cloud's open points by a hash, lets random planes (or lines) collect votes in it, one winner after the other,
and then tests the winners on all open points of all clouds. Inliers leave; rounds end when no cloud finds
another plane. A task holds one cloud's sample, never its points. Draws come from hashes, so results are repeatable.

Clouds without enough points give no rows; points without a place are left out; repeated points count as often as they come.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import polygon, vec
from scanloom.operators import clouds
from scanloom.operators.joins import small
from scanloom.operators.quantiles import group_quantiles
from scanloom.session import cut, kept

#: Points of a cloud that vote, hypotheses of a winner, and tries of a round to find winners.
VOTERS, HYPOTHESES = 20_000, 500


def _winners(axes: tuple[str, ...], threshold: float, least: int, most: int, seed: int):
    """Of one cloud's voters: normal and offset of each winner, in order, each refitted on its votes."""
    dims = len(axes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf[list(axes)].to_numpy()
        middle = xyz.mean(axis=0)
        xyz = xyz - middle
        rng = np.random.default_rng(seed)
        share = max(dims + 1, 0.8 * least * len(pdf) / float(pdf["open"].iloc[0]))
        found = []
        while len(xyz) >= share and len(found) < most:
            pick = xyz[rng.integers(0, len(xyz), (HYPOTHESES, dims))]
            n = np.cross(pick[:, 1] - pick[:, 0], pick[:, 2] - pick[:, 0]) if dims == 3 else (pick[:, 1] - pick[:, 0])[:, ::-1] * [1, -1]
            size = np.linalg.norm(n, axis=1)
            ok = size > 1e-9
            if not ok.any():
                break
            n = n[ok] / size[ok, None]
            d = (n * pick[ok, 0]).sum(axis=1)
            votes = np.zeros(len(n), np.int64)
            for lo in range(0, len(xyz), 2000):
                votes += (np.abs(xyz[lo : lo + 2000] @ n.T - d) <= threshold).sum(axis=0)
            best = int(votes.argmax())
            near = np.abs(xyz @ n[best] - d[best]) <= threshold
            for _ in range(2):  # refit on the votes
                own = xyz[near]
                if len(own) < dims:
                    break
                value, vector = np.linalg.eigh(np.cov((own - own.mean(axis=0)).T))
                v, at = vector[:, 0], vector[:, 0] @ own.mean(axis=0)
                near = np.abs(xyz @ v - at) <= threshold
            if near.sum() < share:
                break
            found.append((*v, at + v @ middle))
            xyz = xyz[~near]
        out = pd.DataFrame(found, columns=[*(f"n{a}" for a in axes), "d"])
        out.insert(0, "cloud_id", pdf["cloud_id"].iloc[0])
        out.insert(1, "turn", np.arange(len(out)))
        return out

    return run


def vote(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), threshold: float = 0.10, least: int = 150, most: int = 40, voters: int = VOTERS) -> tuple[DataFrame, DataFrame]:
    """(planes ``cloud_id, plane_id, points, n*, d``, inliers: points with ``plane_id``), planes in the order in which they were found.

    A plane has ``least`` inliers within threshold, a cloud at most ``most`` planes; a point belongs to the
    first plane that takes it. axes: two of them give lines. Points have ``cloud_id, point_id``.
    """
    ok = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in axes)
    kinds = dict(points.dtypes)
    live = kept(points.where(ok), "voting-open")
    names = [f"n{a}" for a in axes]
    planes, inliers, before = [], [], None
    for turn in range(most):
        open_ = live.groupBy("cloud_id").agg(F.count("*").alias("open")).where(F.col("open") >= least)
        if before is not None:  # a cloud that found nothing is done, and so is one with all its planes
            open_ = open_.join(small(before.where(f"new > 0 and had < {most}").select("cloud_id")), "cloud_id")
        if not open_.head(1):
            break
        mark = F.xxhash64(F.lit(turn), "cloud_id", "point_id")
        low = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30) <= (2.0 * voters + 64) / F.col("open")
        some = live.join(small(open_), "cloud_id").where(low).withColumn("rn", F.row_number().over(Window.partitionBy("cloud_id").orderBy(mark, "point_id"))).where(F.col("rn") <= voters)
        shape = f"cloud_id {kinds['cloud_id']}, turn int, " + ", ".join(f"{c} double" for c in [*names, "d"])
        tried = cut(some.select("cloud_id", "open", *axes).groupBy("cloud_id").applyInPandas(_winners(axes, threshold, least, most, turn), shape))
        lists = tried.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("turn", *names, "d"))).alias("ps"))
        off = lambda p: F.abs(sum((p[n] * F.col(a) for n, a in zip(names[1:], axes[1:], strict=True)), p[names[0]] * F.col(axes[0])) - p["d"])
        rows = live.join(small(lists), "cloud_id", "left").withColumn("hit", F.try_element_at(F.filter("ps", lambda p: off(p) <= threshold), F.lit(1)))
        rows = kept(rows.withColumn("turn", F.col("hit.turn")).drop("hit", "ps"), "voting-hits")
        sizes = rows.where("turn is not null").groupBy("cloud_id", "turn").agg(F.count("*").alias("points")).where(F.col("points") >= least)
        had = before.select("cloud_id", "had") if before is not None else live.select("cloud_id", F.lit(0).alias("had")).limit(0)
        sizes = sizes.join(small(had), "cloud_id", "left").withColumn("plane_id", F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("cloud_id").orderBy("turn")) - 1).where(F.col("plane_id") < most)
        sizes = cut(sizes.select("cloud_id", "turn", F.col("plane_id").cast("int").alias("plane_id"), "points"))
        planes.append(tried.join(sizes, ["cloud_id", "turn"]).select("cloud_id", "plane_id", "points", *names, "d"))
        own = rows.join(small(sizes.select("cloud_id", "turn", "plane_id")), ["cloud_id", "turn"], "left")
        inliers.append(own.where("plane_id is not null").select(*points.columns, "plane_id"))
        new = open_.select("cloud_id").join(sizes.groupBy("cloud_id").agg(F.count("*").cast("int").alias("new")), "cloud_id", "left").join(had, "cloud_id", "left")
        before = cut(new.select("cloud_id", F.coalesce("new", F.lit(0)).alias("new"), (F.coalesce("had", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("had")))
        live = kept(own.where("plane_id is null").select(*points.columns), "voting-open")
    if not planes:
        return points.select("cloud_id", F.lit(0).alias("plane_id"), F.lit(0).cast("long").alias("points"), *[F.lit(0.0).alias(n) for n in [*names, "d"]]).limit(0), points.withColumn("plane_id", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, planes), reduce(DataFrame.unionByName, inliers)


def ransac_plane_faces(points: DataFrame, voxel: float = 0.15, threshold: float = 0.10, least: int = 150, most: int = 40, eps: float = 0.6, min_points: int = 20, max_nz: float = 0.85, min_area: float = 1.0) -> DataFrame:
    """``cloud_id, facade_index, label, component_tag, nx, ny, nz, area, points, vertices`` of steep planes, one face for each cluster of their inliers.

    Points are thinned to cell means; flat planes take their inliers away and give no face; a face is the hull of a
    cluster, its normal away from the middle of the points that no plane had taken by then (of all points, if none was left).
    """
    work = clouds.voxel_downsample(points, voxel).select("cloud_id", F.xxhash64("ix", "iy", "iz").alias("point_id"), "x", "y", "z")
    work = kept(work, "voting-cells")
    planes, inliers = vote(work, ("x", "y", "z"), threshold, least, most)
    planes, inliers = kept(planes, "voting-planes"), kept(inliers, "voting-inliers")
    # Middle of what is open after each plane: all points less those of the planes so far.
    sums = [F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"]]
    taken = inliers.groupBy("cloud_id", "plane_id").agg(*sums)
    w = Window.partitionBy("cloud_id").orderBy("plane_id")
    left = taken.select("cloud_id", "plane_id", *[F.sum(c).over(w).alias(f"t{c}") for c in ("n", "sx", "sy", "sz")]).join(work.groupBy("cloud_id").agg(*sums), "cloud_id")
    rest = F.col("n") - F.col("tn")
    left = left.select("cloud_id", "plane_id", *[F.when(rest > 0, (F.col(f"s{a}") - F.col(f"ts{a}")) / rest).otherwise(F.col(f"s{a}") / F.col("n")).alias(f"o{a}") for a in "xyz"])
    steep = planes.where(F.abs("nz") <= max_nz)
    key = F.concat_ws("#", "cloud_id", "plane_id")
    some = kept(inliers.join(small(steep.select("cloud_id", "plane_id")), ["cloud_id", "plane_id"]).withColumn("part", key), "voting-steep")
    labels = clouds.dbscan(some.select(F.col("part").alias("cloud_id"), "point_id", "x", "y", "z"), eps, min_points).where("label <> -1").withColumnRenamed("cloud_id", "part")
    rows = some.join(labels, ["part", "point_id"]).withColumn("face", F.concat_ws("#", "part", F.col("label").cast("string")))
    mid = rows.groupBy("cloud_id", "plane_id", "label", "face").agg(F.count("*").alias("points"), *[F.avg(a).alias(f"c{a}") for a in "xyz"]).where(F.col("points") >= min_points)
    f = mid.join(steep.drop("points", "d"), ["cloud_id", "plane_id"])
    up = F.when(F.abs("nz") < 0.9, vec.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(vec.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    f = f.withColumn("n", vec.at("nx", "ny", "nz")).withColumn("up", up).withColumn("u", vec.cross(F.col("n"), F.col("up"))).withColumn("u", vec.unit(F.col("u"))).withColumn("v", vec.cross(F.col("n"), F.col("u")))
    f = kept(f.drop("up", "nx", "ny", "nz"), "voting-faces")
    flat = rows.select("face", "x", "y", "z").join(small(f.select("face", "u", "v", "cx", "cy", "cz")), "face").withColumn("off", vec.sub(vec.at(), vec.at("cx", "cy", "cz")))
    hulls = clouds.convex_hulls(flat.select("face", vec.dot(F.col("off"), F.col("u")).alias("x"), vec.dot(F.col("off"), F.col("v")).alias("y")), "face")
    ring = hulls.groupBy("face").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    out = f.join(ring, "face").withColumn("area", F.abs(polygon.signed_area(F.col("ring")))).where(F.col("area") >= min_area).join(small(left), ["cloud_id", "plane_id"])
    side = F.when(F.col("n.x") * (F.col("cx") - F.col("ox")) + F.col("n.y") * (F.col("cy") - F.col("oy")) + F.col("n.z") * (F.col("cz") - F.col("oz")) < 0, -1.0).otherwise(1.0)
    corners = F.transform("ring", lambda p: F.struct(*[(F.col(f"c{a}") + F.col(f"u.{a}") * p["x"] + F.col(f"v.{a}") * p["y"]).alias(a) for a in "xyz"]))
    order = F.row_number().over(Window.partitionBy("cloud_id").orderBy("plane_id", "label")) - 1
    out = out.withColumns({"side": side, "vertices": corners, "facade_index": order})
    tag = F.when(F.abs("n.z") < 0.5, "21.1").otherwise("27.0")
    return out.select("cloud_id", "facade_index", F.concat(F.lit("pc_facade_"), F.col("facade_index").cast("string")).alias("label"), tag.alias("component_tag"), *[(F.col(f"n.{a}") * F.col("side")).alias(f"n{a}") for a in "xyz"], "area", "points", "vertices")


def ransac_wall_faces(points: DataFrame, walls: tuple[float, int, int] = (0.25, 300, 20), roof: tuple[float, int] = (0.30, 500), slice_: tuple[float, float] = (0.25, 0.90), skip: float = 1.0, min_length: float = 2.0, min_wall: float = 6.0, min_roof: float = 8.0, roof_nz: float = 0.85) -> DataFrame:
    """``cloud_id, facade_index, label, component_tag, nx, ny, nz, vertices``: walls from lines in the plan of a height slice, extruded, and one flat roof from the top slice.

    walls: threshold, least inliers, most lines; roof: threshold, least inliers. Heights run from the 5th to the 98th percentile; points less than
    ``skip`` above the lower one are ground. A wall reaches from the 2nd to the 98th percentile along its line and looks away from the slice's middle.
    """
    ok = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in "xyz")
    p = points.where(ok).select("cloud_id", "point_id", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    ends = p.select("cloud_id").distinct().withColumn("shares", F.array(F.lit(0.05), F.lit(0.98)))
    z = group_quantiles(p, ["cloud_id"], "z", ends).select("cloud_id", F.col("quantiles")[0].alias("ground"), F.col("quantiles")[1].alias("top"))
    z = kept(z.withColumn("high", F.greatest(F.lit(1.0), F.col("top") - F.col("ground"))), "walls-heights")
    above = p.join(small(z), "cloud_id").where(F.col("z") >= F.col("ground") + skip)
    enough = above.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * walls[1]).select("cloud_id")
    above = kept(above.join(small(enough), "cloud_id"), "walls-above")
    slab = above.where(F.col("z").between(F.col("ground") + slice_[0] * F.col("high"), F.col("ground") + slice_[1] * F.col("high"))).select("cloud_id", "point_id", "x", "y")
    lines, on = vote(slab, ("x", "y"), *walls)
    on = kept(on, "walls-inliers")
    lines = lines.join(on.groupBy("cloud_id", "plane_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), ["cloud_id", "plane_id"]).join(small(slab.groupBy("cloud_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))), "cloud_id")
    lines = kept(lines, "walls-lines")
    along = on.join(small(lines.select("cloud_id", "plane_id", "nx", "ny", "cx", "cy")), ["cloud_id", "plane_id"]).select("cloud_id", "plane_id", F.expr("-ny * (x - cx) + nx * (y - cy)").alias("t"))
    span = group_quantiles(along, ["cloud_id", "plane_id"], "t", lines.select("cloud_id", "plane_id", F.array(F.lit(0.02), F.lit(0.98)).alias("shares")))
    w = lines.join(span, ["cloud_id", "plane_id"]).join(small(z), "cloud_id").withColumns({"a": F.col("quantiles")[0], "b": F.col("quantiles")[1]})
    w = w.where((F.col("b") - F.col("a") >= min_length) & ((F.col("b") - F.col("a")) * (F.col("top") - F.col("ground")) >= min_wall))
    side = F.when(F.expr("nx * (cx - mx) + ny * (cy - my)") < 0, -1.0).otherwise(1.0)
    corner = lambda t, h: vec.vec(F.col("cx") - F.col("ny") * F.col(t), F.col("cy") + F.col("nx") * F.col(t), F.col(h))
    w = w.select("cloud_id", F.lit("wall").alias("kind"), "plane_id", (F.col("nx") * side).alias("nx"), (F.col("ny") * side).alias("ny"), F.lit(0.0).alias("nz"), F.array(corner("a", "ground"), corner("b", "ground"), corner("b", "top"), corner("a", "top")).alias("vertices"))
    upper = above.where(F.col("z") >= F.col("ground") + slice_[1] * F.col("high")).select("cloud_id", "point_id", "x", "y", "z")
    flat, on = vote(upper, ("x", "y", "z"), *roof, most=1)
    on = kept(on.join(small(flat.where(F.abs("nz") >= roof_nz).select("cloud_id")), "cloud_id"), "walls-roofs")
    two = on.select("cloud_id").distinct().withColumn("shares", F.array(F.lit(0.02), F.lit(0.98)))
    q = lambda a: group_quantiles(on, ["cloud_id"], a, two).withColumnRenamed("quantiles", f"q{a}")
    r = on.groupBy("cloud_id").agg(F.avg("z").alias("z")).join(q("x"), "cloud_id").join(q("y"), "cloud_id")
    r = r.where((F.col("qx")[1] - F.col("qx")[0]) * (F.col("qy")[1] - F.col("qy")[0]) >= min_roof)
    at = lambda i, j: vec.vec(F.col("qx")[i], F.col("qy")[j], F.col("z"))
    r = r.select("cloud_id", F.lit("roof").alias("kind"), F.lit(0).alias("plane_id"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("vertices"))
    # Walls come first, then the roof.
    order = F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.desc("kind"), "plane_id")) - 1
    each = F.row_number().over(Window.partitionBy("cloud_id", "kind").orderBy("plane_id")) - 1
    return w.unionByName(r).select("cloud_id", order.alias("facade_index"), F.concat_ws("_", "kind", each.cast("string")).alias("label"), F.when(F.col("kind") == "wall", "21.1").otherwise("27.1").alias("component_tag"), "nx", "ny", "nz", "vertices")
