"""The k nearest points of every point, by blocks of space with a margin.

A block holds its points and those within a margin around it, so a point's neighbours no farther than the
margin are all there; points whose k-th is farther ask again with a margin twice as wide. The margin comes from the
cloud's density, so a block holds about the same number of points in any cloud. Inside a block numpy looks
through cells of the margin's size, a bounded number of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.joins import small
from scanloom.session import cut

#: Margins along a block's edge, and pairs that are looked at together.
EDGE, PAIRS = 16, 2_000_000
#: The size of the cells that density is counted in, metres.
COUNT_CELL = 0.5


def _cells(xyz: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    c = np.floor((xyz - xyz.min(axis=0)) / size).astype(np.int64) + 1
    return c, c.max(axis=0) + 2


def pairs_in(xyz: np.ndarray, ask: np.ndarray, reach: float, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(asking places in ``ask`` of one part, who of them, the other row (one of ``among``, if given), squared distance) of all pairs within reach, itself not; PAIRS candidates at a time."""
    cell, span = _cells(xyz, reach)
    code = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(code, kind="stable") if among is None else among[np.argsort(code[among], kind="stable")]
    sorted_code = code[order]
    steps = np.array([(i * span[1] + j) * span[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    lo = np.searchsorted(sorted_code, code[ask][:, None] + steps - 1, "left")
    hi = np.searchsorted(sorted_code, code[ask][:, None] + steps + 1, "right")
    size = (hi - lo).sum(axis=1)
    part = np.cumsum(size) // PAIRS
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        n = (hi[rows] - lo[rows]).ravel()
        first = np.repeat(lo[rows].ravel() - np.cumsum(n) + n, n)
        other = order[first + np.arange(n.sum())]
        who = np.repeat(rows, size[rows])
        d = xyz[other] - xyz[ask[who]]
        d = np.einsum("ij,ij->i", d, d)
        ok = (d <= reach * reach) & (other != ask[who])
        yield rows, who[ok], other[ok], d[ok]


def nearest_in(xyz: np.ndarray, ids: np.ndarray, ask: np.ndarray, k: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking rows, their k nearest other rows, distances) of those with k others within reach; ties by id."""
    for rows, who, other, d in pairs_in(xyz, ask, reach):
        by = np.lexsort((ids[other], d, who))
        who, other, d = who[by], other[by], d[by]
        start = np.searchsorted(who, rows)
        full = np.searchsorted(who, rows, "right") - start >= k
        take = start[full][:, None] + np.arange(k)
        yield ask[rows[full]], other[take], np.sqrt(d[take])


def nearest(points: DataFrame, k: int, found: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], shape: str, reach: float | None = None) -> DataFrame:
    """``cloud_id, point_id`` and the columns of ``shape`` that ``found(xyz, rows, others, distances)`` makes of the k nearest other points of each point.

    Ids are unique in their cloud. In a cloud of fewer than k + 1 points all others count; a lone point gives no row, nor does one
    without a place. Ties in distance go to the lower id. reach: the first margin, instead of one from the density; it changes time alone.

    ``found`` sees places, not ids: points at one place have the same neighbourhood, so the first of them asks for all, and no more than k + 1
    of them can be among anyone's nearest. A place of more than k points holds its own neighbours.
    """
    ok = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in "xyz")
    # Adding zero makes the negative zero positive, as the grouping by place takes them for equal.
    whole = points.where(ok).select("cloud_id", "point_id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"])
    place = Window.partitionBy("cloud_id", "x", "y", "z").orderBy("point_id")
    p = cut(whole.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k + 1))
    cells = p.groupBy("cloud_id", *[F.floor(F.col(a) / COUNT_CELL).alias(a) for a in "xyz"]).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("cloud_id").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).where("n > 1")
    # A disc of the margin's radius on a surface of the cloud's density holds one and a half times k points.
    margin = F.sqrt(1.5 * F.least(F.lit(k), F.col("n") - 1) / (3.14159 * F.col("n") / F.col("cells"))) * COUNT_CELL
    margin = F.lit(float(reach)) if reach else margin
    sizes = sizes.select("cloud_id", F.least(F.lit(k), F.col("n") - 1).cast("int").alias("want"), margin.alias("margin"))
    kinds = dict(p.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["point_id"].to_numpy()
        ask, full = pdf["ask"].to_numpy(), pdf["full"].to_numpy()
        parts, own = [], np.flatnonzero(ask & full)
        if len(own):
            n = int(pdf["want"].iloc[0])
            parts.append(pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "point_id": ids[own], **found(xyz, own, np.repeat(own[:, None], n, axis=1), np.zeros((len(own), n)))}))
        ask = np.flatnonzero(ask & ~full)
        for rows, others, d in nearest_in(xyz, ids, ask, int(pdf["want"].iloc[0]), float(pdf["margin"].iloc[0])) if len(ask) else ():
            parts.append(pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "point_id": ids[rows], **found(xyz, rows, others, d)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["cloud_id", "point_id", *[c.split()[0] for c in shape.split(", ")]])

    crowded = p.where(F.col("nth") == k + 1).select("cloud_id", "x", "y", "z", F.lit(True).alias("full"))
    every = p.join(small(sizes), "cloud_id").join(crowded, ["cloud_id", "x", "y", "z"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    every = cut(every)
    done, todo = [], every.where("nth = 1").select("cloud_id", "point_id", F.lit(True).alias("ask"))
    wide = 1.0
    while todo.head(1):
        m, edge = F.col("margin") * wide, F.col("margin") * wide * EDGE
        here = every.join(todo.select("cloud_id", "point_id", "ask"), ["cloud_id", "point_id"], "left") if done else every.withColumn("ask", F.col("nth") == 1)
        rows = here.withColumns({"home": F.struct(*[F.floor(F.col(a) / edge).alias(a) for a in "xyz"])})
        for a in "xyz":
            rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - m) / edge), F.floor((F.col(a) + m) / edge))))
        own = F.expr("home.x = bx and home.y = by and home.z = bz")
        rows = rows.select("cloud_id", "point_id", "x", "y", "z", "want", m.alias("margin"), "full", (own & F.coalesce("ask", F.lit(False))).alias("ask"), "bx", "by", "bz")
        if done:  # blocks without a question are left out
            rows = rows.join(rows.where("ask").select("cloud_id", "bx", "by", "bz").distinct(), ["cloud_id", "bx", "by", "bz"], "left_semi")
        got = cut(rows.groupBy("cloud_id", "bx", "by", "bz").applyInPandas(run, f"cloud_id {kinds['cloud_id']}, point_id {kinds['point_id']}, {shape}"))
        done.append(got)
        todo = cut(todo.join(got.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_anti"))
        wide *= 2
    empty = p.select("cloud_id", "point_id", *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in shape.split(", ")]).limit(0)
    if not done:
        return empty
    firsts = reduce(DataFrame.unionByName, done).join(every.where("nth = 1").select("cloud_id", "point_id", "x", "y", "z"), ["cloud_id", "point_id"])
    return whole.join(firsts.drop("point_id"), ["cloud_id", "x", "y", "z"]).select(*empty.columns)


def blocks(points: DataFrame, edge: float, margin: float) -> DataFrame:
    """points with ``own`` and block ``bx, by, bz`` of that edge: each row in its own block and in those it lies within margin of."""
    rows = points.withColumn("home", F.struct(*[F.floor(F.col(a) / edge).alias(a) for a in "xyz"]))
    for a in "xyz":
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - margin) / edge), F.floor((F.col(a) + margin) / edge))))
    return rows.withColumn("own", F.expr("home.x = bx and home.y = by and home.z = bz")).drop("home")


def mean_distances(points: DataFrame, k: int, reach: float | None = None) -> DataFrame:
    """``cloud_id, point_id, mean_d`` over the k nearest others, or all others of a smaller cloud."""
    return nearest(points, k, lambda xyz, rows, others, d: {"mean_d": d.mean(axis=1)}, "mean_d double", reach)


def _normals(xyz: np.ndarray, rows: np.ndarray, others: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    near = np.concatenate([xyz[rows][:, None], xyz[others]], axis=1)
    near = near - near.mean(axis=1, keepdims=True)
    value, vector = np.linalg.eigh(np.einsum("nki,nkj->nij", near, near) / near.shape[1])
    v = vector[:, :, 0]
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    v = v * np.where(lead < 0, -1, 1)
    return {"nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "rms": np.sqrt(np.maximum(value[:, 0], 0))}


def estimate_normals(points: DataFrame, k: int = 18) -> DataFrame:
    """``cloud_id, point_id, nx, ny, nz, rms``: the plane of each point and its k nearest others; of the two unit normals the one whose largest part is positive."""
    return nearest(points, k, _normals, "nx double, ny double, nz double, rms double")
