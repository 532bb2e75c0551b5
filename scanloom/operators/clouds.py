"""Point-cloud operators. Points are shuffled by (cloud, cell); by cloud alone go only sums, bounded samples and planes."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geo
from scanloom.operators.graph import connected_components
from scanloom.operators.groups import by_key
from scanloom.operators.joins import small, within
from scanloom.operators.neighbours import blocks, mean_distances, pairs_in
from scanloom.session import cut, kept

#: Rows and pairs that the dedup of poses looks at together.
THIN_ROWS, THIN_PAIRS = 4_096, 500_000


def voxel_downsample(points: DataFrame, size: float, mode: str = "mean") -> DataFrame:
    """One point per cell: the mean, or the first by ``point_id``. Cells are counted from 0."""
    ix, iy, iz = geo.voxel_key(F.col("x"), F.col("y"), F.col("z"), size)
    g = points.withColumns({"ix": ix, "iy": iy, "iz": iz}).groupBy("cloud_id", "ix", "iy", "iz")
    if mode == "mean":
        return g.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))
    f = F.min_by(F.struct("x", "y", "z", "point_id"), "point_id")
    return g.agg(f.alias("f"), F.count("*").alias("n")).select("cloud_id", "ix", "iy", "iz", "f.x", "f.y", "f.z", "f.point_id", "n")


def spacing_sample(points: DataFrame, most: int = 5000) -> DataFrame:
    """At most ``most`` points a cloud, the first by a hash of their id.

    A threshold on the hash, four times what is needed, leaves a bounded number of points to order.
    """
    mark = F.md5(F.concat_ws("|", "cloud_id", "point_id"))
    n = points.groupBy("cloud_id").agg(F.count("*").alias("size"))
    low = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / float(1 << 32) <= (4.0 * most + 64) / F.col("size")
    some = points.withColumn("mark", mark).join(small(n), "cloud_id").where(low)
    w = Window.partitionBy("cloud_id").orderBy("mark", "point_id")
    return some.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn", "mark", "size")


def nn_spacing(points: DataFrame, reach: float = 0.5, most: int = 5000) -> DataFrame:
    """``cloud_id, nn_m``: median distance of sampled points to their nearest other point, in 0.01..reach; the reach where there is none."""
    s = cut(spacing_sample(points, most).select("cloud_id", "point_id", "x", "y", "z"))
    # Points at one place go together: of more than one, another lies at distance 0.
    places = points.groupBy("cloud_id", "x", "y", "z").agg(F.count("*").alias("n"), F.min("point_id").alias("point_id"))
    near = within(s, places, reach, "cloud_id").where("b.n > 1 or a.point_id <> b.point_id")
    best = near.groupBy(F.col("a.cloud_id").alias("cloud_id"), F.col("a.point_id").alias("point_id")).agg(F.min("distance").alias("d"))
    rows = s.select("cloud_id", "point_id").join(best, ["cloud_id", "point_id"], "left")
    return rows.groupBy("cloud_id").agg(F.median(F.greatest(F.lit(0.01), F.least(F.lit(reach), F.coalesce("d", F.lit(reach))))).alias("nn_m"))


def detection_defaults(spacing: DataFrame) -> DataFrame:
    """Plane-search parameters from the spacing."""
    nn = F.col("nn_m")
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return spacing.withColumns({"epsilon_m": clip(nn * 0.5, 0.015, 0.05), "cluster_m": clip(nn * 4, 0.1, 0.5), "min_points": clip(F.round(0.3 / (nn * nn)), 25.0, 250.0).cast("int"), "mesh_voxel_m": clip(nn * 1.5, 0.03, 0.15)})


def knn_mean_distance(points: DataFrame, k: int, reach: float | None = None) -> DataFrame:
    """``cloud_id, point_id, mean_d`` over the k nearest others, however far, or all others of a smaller cloud."""
    return mean_distances(points, k, reach)


def remove_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, reach: float | None = None) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + ratio * standard deviation of their cloud; the only point of a cloud goes."""
    d = cut(knn_mean_distance(points, k, reach))
    limit = d.groupBy("cloud_id").agg((F.avg("mean_d") + ratio * F.stddev_samp("mean_d")).alias("limit"))
    ok = d.join(small(limit), "cloud_id").where("mean_d <= limit").select("cloud_id", "point_id")
    return points.join(ok, ["cloud_id", "point_id"], "left_semi")


def apply_transform(points: DataFrame, m: list[float]) -> DataFrame:
    """Row-major 4x4 transform of every point."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    row = lambda r: m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3]
    return points.withColumns({"x": row(0), "y": row(1), "z": row(2)})


MOMENTS = ("n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz")


def moments(points: DataFrame, *by: str) -> DataFrame:
    """One-pass sums from which a plane is fitted; they add up across groups."""
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    return points.groupBy(*by).agg(F.count("*").alias("n"), s("x", "sx"), s("y", "sy"), s("z", "sz"), s("x*x", "sxx"), s("y*y", "syy"), s("z*z", "szz"), s("x*y", "sxy"), s("x*z", "sxz"), s("y*z", "syz"))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", "d", "rms")]))
def _plane(n: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series, sxx: pd.Series, syy: pd.Series, szz: pd.Series, sxy: pd.Series, sxz: pd.Series, syz: pd.Series) -> pd.DataFrame:
    m = np.stack([sx / n, sy / n, sz / n], axis=1)
    c = np.empty((len(n), 3, 3))
    for (i, j), s in {(0, 0): sxx, (1, 1): syy, (2, 2): szz, (0, 1): sxy, (0, 2): sxz, (1, 2): syz}.items():
        c[:, i, j] = c[:, j, i] = s / n - m[:, i] * m[:, j]
    value, vector = np.linalg.eigh(c)
    v = vector[:, :, 0]
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    v = v * np.where(lead < 0, -1, 1)
    return pd.DataFrame({"nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "d": (v * m).sum(axis=1), "rms": np.sqrt(np.maximum(value[:, 0], 0))})


def fit_planes(sums: DataFrame) -> DataFrame:
    """Add the plane of each row of sums: unit normal with its largest part positive, offset, rms. Python sees one row a group."""
    return sums.withColumn("plane", _plane(*MOMENTS)).select("*", "plane.*").drop("plane")


def cloud_origins(points: DataFrame) -> DataFrame:
    """``cloud_id, ox, oy, oz``: whole metres near each cloud's middle, from which moments are taken: far from zero their differences would cancel."""
    return points.groupBy("cloud_id").agg(*[F.floor(F.avg(a)).cast("double").alias(f"o{a}") for a in "xyz"])


def plane_regions(points: DataFrame, cell: float = 0.5, cos: float = 0.95, epsilon: float = 0.05) -> DataFrame:
    """Flat cells ``cloud_id, ix, iy, iz, region`` with their moments about the cloud's origin ``ox, oy, oz``.

    Points are summed by cell, flat cells are fitted, neighbours whose planes agree
    are linked and components become regions, so points are shuffled once and everything later is one row a cell.
    """
    ix, iy, iz = geo.voxel_key(F.col("x"), F.col("y"), F.col("z"), cell)
    near = points.join(small(cloud_origins(points)), "cloud_id").withColumns({"ix": ix, "iy": iy, "iz": iz})
    near = near.withColumns({a: F.col(a) - F.col(f"o{a}") for a in "xyz"})
    cells = fit_planes(moments(near, "cloud_id", "ox", "oy", "oz", "ix", "iy", "iz").where("n >= 5"))
    cells = cut(cells.where(F.col("rms") <= epsilon).withColumn("cell_id", F.xxhash64("cloud_id", "ix", "iy", "iz")))
    side = cells.select("cloud_id", "ix", "iy", "iz", "cell_id", "nx", "ny", "nz", "d", "n", "sx", "sy", "sz")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]))
    a = side.withColumn("s", step).select("cloud_id", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), (F.col("iz") + F.col("s.k")).alias("iz"), *[F.col(c).alias(f"a_{c}") for c in ("cell_id", "nx", "ny", "nz", "d", "n", "sx", "sy", "sz")])
    pairs = a.join(side, ["cloud_id", "ix", "iy", "iz"])
    agree = F.abs(F.expr("a_nx*nx + a_ny*ny + a_nz*nz")) >= cos
    off_b = F.abs(F.expr("(a_nx*sx + a_ny*sy + a_nz*sz) / n - a_d")) <= 2 * epsilon
    off_a = F.abs(F.expr("(nx*a_sx + ny*a_sy + nz*a_sz) / a_n - d")) <= 2 * epsilon
    links = pairs.where(agree & off_a & off_b).select(F.col("a_cell_id").alias("src"), F.col("cell_id").alias("dst"))
    own = links.unionByName(cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst")))
    parts = connected_components(own).withColumnRenamed("node", "cell_id").withColumnRenamed("component", "region")
    return cut(cells.join(parts, "cell_id").select("cloud_id", "ix", "iy", "iz", "region", "ox", "oy", "oz", *MOMENTS))


def planes_of(regions: DataFrame, min_points: int = 60) -> DataFrame:
    """``cloud_id, plane_id, region, points, nx, ny, nz, d, rms, cx, cy, cz``: regions of at least min_points refitted, largest first."""
    sums = regions.groupBy("cloud_id", "ox", "oy", "oz", "region").agg(*[F.sum(m).alias(m) for m in MOMENTS]).where(F.col("n") >= min_points)
    order = Window.partitionBy("cloud_id").orderBy(F.desc("n"), "region")
    planes = fit_planes(sums).withColumn("plane_id", F.row_number().over(order) - 1)
    d = F.expr("d + nx*ox + ny*oy + nz*oz")
    return planes.select("cloud_id", "plane_id", "region", F.col("n").alias("points"), "nx", "ny", "nz", d.alias("d"), "rms", *[(F.col(f"s{a}") / F.col("n") + F.col(f"o{a}")).alias(f"c{a}") for a in "xyz"])


def plane_inliers(points: DataFrame, planes: DataFrame, regions: DataFrame, cell: float = 0.5, epsilon: float = 0.05) -> DataFrame:
    """Points within twice epsilon of the plane of their cell's region, or of a neighbouring cell's where their own has none in reach
    (the nearest, then the lowest ``plane_id``), with that id: cells on edges aren't flat, their points still belong to the faces that meet there."""
    ix, iy, iz = geo.voxel_key(F.col("x"), F.col("y"), F.col("z"), cell)
    of = regions.select("cloud_id", "ix", "iy", "iz", "region").join(small(planes.select("cloud_id", "region", "plane_id", "nx", "ny", "nz", "d")), ["cloud_id", "region"])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = of.withColumn("s", F.explode(steps)).withColumn("beside", (F.abs("s.i") + F.abs("s.j") + F.abs("s.k") > 0).cast("int"))
    near = near.groupBy("cloud_id", *[(F.col(c) + F.col(f"s.{i}")).alias(c) for c, i in (("ix", "i"), ("iy", "j"), ("iz", "k"))], "plane_id", "nx", "ny", "nz", "d").agg(F.min("beside").alias("beside"))
    near = near.groupBy("cloud_id", "ix", "iy", "iz").agg(F.collect_list(F.struct("beside", "plane_id", "nx", "ny", "nz", "d")).alias("near"))
    rows = points.withColumns({"ix": ix, "iy": iy, "iz": iz}).join(near, ["cloud_id", "ix", "iy", "iz"])
    off = lambda p: F.abs(p["nx"] * F.col("x") + p["ny"] * F.col("y") + p["nz"] * F.col("z") - p["d"])
    best = F.array_min(F.transform(F.filter("near", lambda p: off(p) <= 2 * epsilon), lambda p: F.struct(p["beside"].alias("beside"), off(p).alias("off"), p["plane_id"].alias("plane_id"))))
    return rows.withColumn("best", best).where("best is not null").select(*points.columns, F.col("best.plane_id").alias("plane_id"))


def grow_planes(points: DataFrame, cell: float = 0.5, cos: float = 0.95, epsilon: float = 0.05, min_points: int = 60) -> DataFrame:
    """Connected planar regions: ``cloud_id, plane_id, points, nx, ny, nz, d, rms``, see :func:`plane_regions`."""
    return planes_of(plane_regions(points, cell, cos, epsilon), min_points).select("cloud_id", "plane_id", "points", "nx", "ny", "nz", "d", "rms")


def _dbscan_block(eps: float, min_points: int):
    """What a block says of its own points: core points and their cell (kind 0), cells whose cores are linked (1), points at a core's cell (2)."""
    side = eps / np.sqrt(3)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, ids, own, n = pdf[["x", "y", "z"]].to_numpy(), pdf["point_id"].to_numpy(), pdf["own"].to_numpy(), pdf["n"].to_numpy()
        cell = np.floor(xyz / side).astype(np.int64)
        at, of = np.unique(cell, axis=0, return_inverse=True)
        of = of.ravel()
        # Points of one cell lie within eps of one another: a full cell needs no counting.
        core = np.bincount(of, weights=n)[of] >= min_points
        ask = np.flatnonzero(~core)
        for rows, who, other, _ in pairs_in(xyz, ask, eps) if len(ask) else ():
            core[ask[rows]] = np.bincount(who, weights=n[other], minlength=len(ask))[rows] + n[ask[rows]] >= min_points
        links, touch = [], []
        mine = np.flatnonzero(own)
        for _, who, other, _ in pairs_in(xyz, mine, eps) if len(mine) else ():
            a, ok = mine[who], core[other]
            a, b = a[ok], other[ok]
            links.append(np.unique(np.column_stack([of[a], of[b]])[core[a] & (of[a] != of[b])], axis=0))
            touch.append(np.unique(np.column_stack([a, of[b]])[~core[a]], axis=0))
        links = np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 2), int)
        touch = np.unique(np.concatenate(touch), axis=0) if touch else np.empty((0, 2), int)
        cores = mine[core[mine]]
        none = lambda n: [None] * n
        kind = np.repeat([0, 1, 2], [len(cores), len(links), len(touch)])
        places = np.concatenate([at[of[cores]], at[links[:, 0]], at[touch[:, 1]]]) if len(kind) else np.empty((0, 3), np.int64)
        seconds = at[links[:, 1]]
        out = {"cloud_id": pdf["cloud_id"].iloc[0], "kind": kind, "point_id": pd.Series([*ids[cores].tolist(), *none(len(links)), *ids[touch[:, 0]].tolist()], dtype=object)}
        out |= {f"c{a}": places[:, i] for i, a in enumerate("xyz")}
        out |= {f"d{a}": pd.array([*none(len(cores)), *seconds[:, i].tolist(), *none(len(touch))], "Int64") for i, a in enumerate("xyz")}
        found = pd.DataFrame(out)
        return found if len(found) else found.iloc[:0]

    return run


def dbscan(points: DataFrame, eps: float, min_points: int, edge: float = 12.0) -> DataFrame:
    """``cloud_id, point_id, label``: clusters of core points within eps of one another (label: least core id of the
    cluster), border points with the least core label they touch, -1 for noise. A point counts as its own neighbour.

    Points at one place share a label, so a place is met once, by its least id and with the number of its points. Places
    are dealt to blocks of ``edge`` times eps with a margin of twice eps; what leaves a block is one row a core place, the links of
    cells in which all places are within eps, and the cells that border places touch: no pairs of points. Keys and
    ids may be of any type; ids are unique in their cloud. Rows without a place are noise.
    """
    kinds = dict(points.dtypes)
    number = kinds["point_id"] in ("tinyint", "smallint", "int", "bigint")
    # Adding zero makes the negative zero positive, as the grouping by place takes them for equal.
    whole = points.select("cloud_id", "point_id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"])
    ok = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in "xyz")
    places = cut(whole.where(ok).groupBy("cloud_id", "x", "y", "z").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")))
    dealt = blocks(places, edge * eps, 2 * eps)
    shape = f"cloud_id {kinds['cloud_id']}, kind int, point_id {kinds['point_id']}, " + ", ".join(f"{p}{a} long" for p in "cd" for a in "xyz")
    found = cut(dealt.groupBy("cloud_id", "bx", "by", "bz").applyInPandas(_dbscan_block(eps, min_points), shape))
    node = lambda p: F.xxhash64("cloud_id", *[f"{p}{a}" for a in "xyz"])
    cores = found.where("kind = 0").select("cloud_id", "point_id", node("c").alias("node"))
    edges = found.where("kind = 1").select(node("c").alias("src"), node("d").alias("dst")).unionByName(cores.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    parts = connected_components(edges)
    cores = cut(cores.join(parts, "node").select("cloud_id", "point_id", "node", "component"))
    least = cores.groupBy("cloud_id", "component").agg(F.min("point_id").alias("label"))
    touched = found.where("kind = 2").select("cloud_id", "point_id", node("c").alias("node")).join(cores.select("cloud_id", "node", "component").distinct(), ["cloud_id", "node"]).select("cloud_id", "point_id", "component")
    labels = cores.select("cloud_id", "point_id", "component").unionByName(touched).join(least, ["cloud_id", "component"]).groupBy("cloud_id", "point_id").agg(F.min("label").alias("label"))
    labels = places.select("cloud_id", "point_id", "x", "y", "z").join(labels, ["cloud_id", "point_id"]).drop("point_id")
    return whole.join(labels, ["cloud_id", "x", "y", "z"], "left").select("cloud_id", "point_id", "label").withColumn("label", F.coalesce("label", F.lit(-1 if number else "-1").cast(kinds["point_id"])))


def _scan_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's share of the ordered scan: ``cloud_id, i, j, gone`` of the pairs that are settled (gone: the point that goes, if any).

    A pair waits, and with it every later pair of its points, while a point of it has its home in another block.
    """
    gone: set = set()
    waits: set = set()
    out = []
    cloud = pdf["cloud_id"].iloc[0]
    pdf = pdf.sort_values(["i", "j"], kind="stable")
    for i, j, loser, home_i, home_j in zip(*(pdf[c].tolist() for c in ("i", "j", "loser", "home_i", "home_j")), strict=True):
        if i in gone or j in gone:
            out.append((cloud, i, j, None))
        elif home_i and home_j and i not in waits and j not in waits:
            gone.add(loser)
            out.append((cloud, i, j, loser))
        else:
            waits.update((i, j))
    return pd.DataFrame(out, columns=["cloud_id", "i", "j", "gone"], dtype=object)  # ids with nulls, of any type


def scan_pairs(pairs: DataFrame, edge: float) -> DataFrame:
    """``cloud_id, point_id`` of the points that go when pairs ``cloud_id, i, j, loser`` are taken in order of (i, j): the
    loser of a pair goes unless one of its points went before. ``a, b`` are the points' places (x, y, z).

    Pairs are settled by blocks of space, as far as each block knows all pairs of their points. Blocks grow 32-fold from round to
    round and their borders move to other places, so a chain of any length ends after a round for every five doublings
    of its extent, wherever the origin lies; what a task holds are the pairs of its block that are still open.
    """
    live = cut(pairs.select("cloud_id", "i", "j", "loser", "a", "b"))
    kind = dict(live.dtypes)
    shape = f"cloud_id {kind['cloud_id']}, i {kind['i']}, j {kind['j']}, gone {kind['i']}"
    lost, turn = [], 0
    while live.head(1):
        # Fractions of multiples of irrational numbers: no place stays near a border.
        shift = [edge * ((turn + 1) * f % 1) for f in (0.6180339887, 0.4142135624, 0.7320508076)]
        block = lambda p: F.struct(*[F.floor((F.col(p)[x] + s) / edge).alias(x) for x, s in zip("xyz", shift, strict=True)])  # noqa: B023, E731
        rows = live.withColumns({"ba": block("a"), "bb": block("b")}).withColumn("at", F.explode(F.array_distinct(F.array("ba", "bb"))))
        rows = rows.select("cloud_id", "i", "j", "loser", (F.col("at") == F.col("ba")).alias("home_i"), (F.col("at") == F.col("bb")).alias("home_j"), "at.x", "at.y", "at.z")
        found = cut(rows.groupBy("cloud_id", "x", "y", "z").applyInPandas(_scan_pairs, shape))
        out = found.where("gone is not null").select("cloud_id", F.col("gone").alias("point_id")).distinct()
        lost.append(out)
        live = live.join(found.select("cloud_id", "i", "j").distinct(), ["cloud_id", "i", "j"], "left_anti")
        for end in ("i", "j"):
            live = live.join(out.withColumnRenamed("point_id", end), ["cloud_id", end], "left_anti")
        live = cut(live.select("cloud_id", "i", "j", "loser", "a", "b"))
        edge, turn = edge * 32, turn + 1
    return reduce(DataFrame.unionByName, lost).distinct() if lost else pairs.select("cloud_id", F.col("i").alias("point_id")).limit(0)


def _close_pairs(points: DataFrame, r: float) -> DataFrame:
    near = within(points, points, r, "cloud_id").where("a.point_id < b.point_id")
    return near.select("a.cloud_id", F.col("a.point_id").alias("i"), F.col("b.point_id").alias("j"), "a", "b")


def greedy_dedupe(points: DataFrame, r: float) -> DataFrame:
    """Keep a point unless a kept point with a lower id of its cloud lies within r, as in id order. Ids are unique in their cloud; rows without an id or place stay.

    Of points at one place only the lowest id can stay, and what it meets the others meet too: pairs are made of places, however often each is taken.
    """
    at = ["cloud_id", "x", "y", "z"]
    placed = F.expr(" and ".join(f"{c} is not null" for c in [*at, "point_id"]) + " and not isnan(x) and not isnan(y) and not isnan(z)")
    firsts = cut(points.where(placed).groupBy(*at).agg(F.min("point_id").alias("point_id")))
    pairs = _close_pairs(firsts, r).withColumn("loser", F.col("j"))
    stay = firsts.select("cloud_id", "point_id").join(scan_pairs(pairs, 8 * r), ["cloud_id", "point_id"], "left_anti")
    return points.where(placed).join(stay, ["cloud_id", "point_id"], "left_semi").unionByName(points.where(~placed))


def _thin(pdf: pd.DataFrame, r: float, max_deg: float) -> pd.DataFrame:
    """Whole blocks, each in order of ids: own rows that go (``gone``) or that wait for what another block knows."""
    key = pdf[["cloud_id", "bx", "by", "bz"]]
    block = np.r_[False, (key.iloc[1:].to_numpy() != key.iloc[:-1].to_numpy()).any(axis=1)].cumsum()
    ids = pdf["point_id"]
    xyz, heading = pdf[["x", "y", "z"]].to_numpy(), pdf["heading_deg"].to_numpy(float)
    steep, own = pdf["steep"].to_numpy(float), pdf["own"].to_numpy(bool)
    # Equal ids of a block are one point.
    point = np.r_[False, (ids.iloc[1:].to_numpy() != ids.iloc[:-1].to_numpy()) | (block[1:] != block[:-1])].cumsum()
    gone, waits, mine, slope = bytearray(len(pdf)), bytearray(len(pdf)), own.tolist(), steep.tolist()
    lo = pd.DataFrame(xyz).groupby(block).transform("min").to_numpy()
    cell = np.floor((xyz - lo) / (r + 1e-6)).astype(np.int64) + 1
    span = cell.max(axis=0) + 2
    code = ((block * span[0] + cell[:, 0]) * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    steps = np.array([(i * span[1] + j) * span[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    state = lambda flags: np.frombuffer(flags, np.uint8)[point] > 0
    at, pools = 0, None
    while at < len(pdf):
        dead, held = state(gone), state(waits)
        # Rows that wait already need to tell those alone that don't wait yet.
        if pools is None or any((dead[rows] | (idle & held[rows])).mean() > 0.1 for idle, rows, _ in pools if len(rows)):
            rest = np.flatnonzero(~dead[at:]) + at
            pools = [(idle, rows := rest[~held[rest]] if idle else rest, rows[np.argsort(code[rows], kind="stable")]) for idle in (False, True)]
        ask = pools[0][1][np.searchsorted(pools[0][1], at) :][:THIN_ROWS]
        if not len(ask):
            break
        found, size = [], np.zeros(len(ask), np.int64)
        for idle, _, by in pools:
            own_pool = held[ask] == idle
            around = code[ask][:, None] + steps
            first = np.searchsorted(code[by], around - 1, "left")
            n = (np.searchsorted(code[by], around + 1, "right") - first) * (own_pool & ~dead[ask])[:, None]
            found.append((by, first, n))
            size += n.sum(axis=1)
        fit = max(1, int(np.searchsorted(size.cumsum(), THIN_PAIRS)))
        ask = ask[:fit]
        pairs = []
        for by, first, n in found:
            m = n[:fit].ravel()
            pairs.append((np.repeat(ask, n[:fit].sum(axis=1)), by[np.repeat(first[:fit].ravel() - np.cumsum(m) + m, m) + np.arange(m.sum())]))
        i, j = (np.concatenate(v) for v in zip(*pairs, strict=True))
        ok = (point[j] > point[i]) & ~dead[j] & (own[i] | own[j]) & ~(held[i] & held[j])
        i, j = i[ok], j[ok]
        off, turn = xyz[i] - xyz[j], np.abs(heading[i] - heading[j])
        off = off * off
        ok = (np.sqrt(off[:, 0] + off[:, 1] + off[:, 2]) <= r) & (np.where(turn > 180, 360 - turn, turn) < max_deg)
        i, j = i[ok], j[ok]
        order = np.lexsort((j, i))
        for a, b, p, q in zip(*(v[order].tolist() for v in (i, j, point[i], point[j])), strict=True):
            if gone[p] or gone[q]:
                continue
            if mine[a] and mine[b] and not waits[p] and not waits[q]:
                gone[q if slope[a] <= slope[b] else p] = 1
            else:
                waits[p] = waits[q] = 1
        at = int(ask[-1]) + 1
    lost = state(gone)
    return pdf[["cloud_id", "point_id", "x", "y", "z", "heading_deg", "steep"]].assign(gone=lost)[own & (lost | state(waits))]


def dedupe_poses_within(points: DataFrame, r: float = 0.5, max_deg: float = 30.0) -> DataFrame:
    """Of two points within r that look less than ``max_deg`` of heading apart, the one with the steeper pitch goes (of equals the later).

    Pairs are taken in order of their ids (lower, then higher), and a point that went takes no other with it. Points carry ``heading_deg`` and ``gimbal_pitch_deg``;
    ids are unique in their cloud, rows without an id or place stay.

    Blocks of space with a margin settle what they know all pairs of, and what waits goes to blocks 32 times as large, at other borders, until nothing waits.
    What leaves a block is a row a point, never a pair; each settled pair takes a point away, so that crowded places end soon.
    """
    pitch = F.abs(F.col("gimbal_pitch_deg").cast("double"))
    placed = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in "xyz") + " and cloud_id is not null and point_id is not null"
    live = points.where(placed).select("cloud_id", "point_id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"], F.col("heading_deg").cast("double").alias("heading_deg"), F.when(F.isnan(pitch), float("inf")).otherwise(pitch).alias("steep"))
    kinds = dict(live.dtypes)
    shape = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", gone boolean"
    edge, turn, lost = 8 * r, 0, []
    while True:
        # Fractions of multiples of irrational numbers: no place stays near a border.
        shift = dict(zip("xyz", [edge * ((turn + 1) * f % 1) for f in (0.6180339887, 0.4142135624, 0.7320508076)], strict=True))
        block = lambda a, off=0.0: F.floor((F.col(a) + (shift[a] + off)) / edge)  # noqa: B023, E731
        rows = live.withColumn("home", F.struct(*[block(a).alias(a) for a in "xyz"]))
        for a in "xyz":
            rows = rows.withColumn(f"b{a}", F.explode(F.sequence(block(a, -r - 1e-6), block(a, r + 1e-6))))
        rows = rows.withColumn("own", F.expr("home.x = bx and home.y = by and home.z = bz")).drop("home")
        found = kept(by_key(rows, ["cloud_id", "bx", "by", "bz"], partial(_thin, r=r, max_deg=max_deg), shape, ("point_id",)), "thinned")
        lost.append(found.where("gone").select("cloud_id", "point_id"))
        live = found.where("not gone").drop("gone")
        if live.isEmpty():
            return points.join(reduce(DataFrame.unionByName, lost), ["cloud_id", "point_id"], "left_anti")
        edge, turn = edge * 32, turn + 1


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest left, collinear points dropped."""
    rows, _ = hulls_of(np.zeros(len(xy), np.int64), xy[:, 0], xy[:, 1])
    return xy[rows]


def hulls_of(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the corners of each group's hull, group by group, as :func:`hull` orders them; of fewer than three points all."""
    order = np.lexsort((y, x, group))
    g, xs, ys = group[order], x[order], y[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])
    order, g, xs, ys = order[new], g[new], xs[new].tolist(), ys[new].tolist()
    ends = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]

    def half(places: range) -> list[int]:
        out: list[int] = []
        for q in places:
            while len(out) > 1:
                o, p = out[-2], out[-1]
                if (xs[p] - xs[o]) * (ys[q] - ys[o]) - (ys[p] - ys[o]) * (xs[q] - xs[o]) > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    rows: list[int] = []
    seq: list[int] = []
    for lo, hi in zip(ends, ends[1:], strict=False):
        h = list(range(lo, hi)) if hi - lo < 3 else half(range(lo, hi)) + half(range(hi - 1, lo - 1, -1))
        rows += h
        seq += range(len(h))
    return order[rows], np.array(seq, np.int64)


def hull_rings(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """``key, ring``: the corners ``x, y`` of each key's hull in the plane, in order (none under three points).

    Partial hulls are taken where the points lie, so only corners are shuffled; the hull of hulls is exact. Python sees many keys at once.
    """
    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["k"].notna().to_numpy()]
        rows, seq = hulls_of(pd.factorize(pdf["k"])[0], pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        return pdf.iloc[rows].assign(seq=seq)

    def some_corners(batches):
        for pdf in batches:
            yield corners(pdf)[["k", "x", "y"]]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = corners(pdf)
        x, y, first = h["x"].tolist(), h["y"].tolist(), np.flatnonzero(h["seq"].to_numpy() == 0)
        spans = [(lo, hi) for lo, hi in zip(first.tolist(), [*first.tolist()[1:], len(h)], strict=False) if hi - lo >= 3]
        return pd.DataFrame({"k": h["k"].iloc[[lo for lo, _ in spans]].to_numpy(), **{n: pd.Series([v[lo:hi] for lo, hi in spans], dtype=object) for n, v in (("xs", x), ("ys", y))}})

    kind = dict(points.dtypes)[key]
    some = points.select(F.col(key).alias("k"), "x", "y").mapInPandas(some_corners, f"k {kind}, x double, y double")
    rings = by_key(some, ["k"], final, f"k {kind}, xs array<double>, ys array<double>")
    return rings.select(F.col("k").alias(key), F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("ring"))


def convex_hulls(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """``key, seq, x, y``: :func:`hull_rings`, a row a corner."""
    return hull_rings(points, key).select(key, F.posexplode("ring").alias("seq", "p")).select(key, "seq", "p.x", "p.y")


def register_scales(source: DataFrame, target: DataFrame, voxels: tuple[float, ...] = (0.5, 0.25), yaws: tuple[float, ...] = (0.0, 90.0, 180.0, 270.0), rounds: int = 20) -> DataFrame:
    """Alignment from coarse to fine: ``cloud_id, m, yaw_deg, per_scale (voxel_m, fitness, rmse)``.

    Each source starts once for every yaw, its centre on the target's; the start with the best fitness (share of
    points with a partner within three voxels), then the least error, at the coarsest scale goes on. Both clouds are thinned to cell means at
    every scale.
    """
    centre = lambda p, n: p.groupBy("cloud_id").agg(*[F.avg(a).alias(f"{n}{a}") for a in "xyz"])
    seeds = centre(source, "s").join(centre(target, "t"), "cloud_id").withColumn("seed", F.explode(F.array(*[F.lit(float(y)) for y in yaws])))
    c, s = F.cos(F.radians("seed")), F.sin(F.radians("seed"))
    at = [F.col("tx") - (c * F.col("sx") - s * F.col("sy")), F.col("ty") - (s * F.col("sx") + c * F.col("sy")), F.col("tz") - F.col("sz")]
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = cut(seeds.select("cloud_id", "seed", F.array(c, -s, zero, at[0], s, c, zero, at[1], zero, zero, one, at[2], zero, zero, zero, one).alias("m"), F.array().cast("array<struct<voxel_m:double,fitness:double,rmse:double>>").alias("per_scale")))
    pick = Window.partitionBy("cloud_id").orderBy(F.desc("fitness"), "rmse", "seed")
    for voxel in voxels:
        thin = lambda p: voxel_downsample(p, voxel).select("cloud_id", F.xxhash64("ix", "iy", "iz").alias("point_id"), "x", "y", "z")  # noqa: B023, E731
        fine = cut(thin(source))
        size = fine.groupBy("cloud_id").agg(F.count("*").alias("all"))
        key = F.struct("cloud_id", "seed")
        both = pose.select("cloud_id", "seed")
        found = register(fine.join(small(both), "cloud_id").withColumn("cloud_id", key), cut(thin(target)).join(small(both), "cloud_id").withColumn("cloud_id", key), 3 * voxel, rounds, start=pose.select(key.alias("cloud_id"), "m"))
        found = found.select("cloud_id.*", "m", "rmse", "pairs").join(pose.select("cloud_id", "seed", "per_scale"), ["cloud_id", "seed"]).join(size, "cloud_id")
        found = found.withColumn("fitness", F.col("pairs") / F.col("all"))
        found = found.withColumn("per_scale", F.concat("per_scale", F.array(F.struct(F.lit(float(voxel)).alias("voxel_m"), "fitness", "rmse"))))
        pose = cut(found.withColumn("rn", F.row_number().over(pick)).where("rn = 1").select("cloud_id", "seed", "m", "per_scale"))
    return pose.select("cloud_id", "m", F.degrees(F.atan2(F.col("m")[4], F.col("m")[0])).alias("yaw_deg"), "per_scale")


def register(source: DataFrame, target: DataFrame, reach: float, rounds: int = 20, tolerance: float = 1e-5, start: DataFrame | None = None) -> DataFrame:
    """Rigid alignment of each source cloud to the target with its id: ``cloud_id, m (4x4), rmse, pairs``.

    start: ``cloud_id, m`` to begin with, the identity if it isn't given.

    Each round matches points to their nearest target within reach, sums the 3x3
    cross-covariance per cloud on the executors and solves it on one row a cloud.
    """
    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, p: pd.Series, q: pd.Series, h: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for k, sp, sq, sh, old in zip(n, p, q, h, m, strict=True):
            old = np.array(old, float).reshape(4, 4)
            if not k or k < 3:
                out.append(old.ravel())
                continue
            sp, sq = np.array(sp, float) / k, np.array(sq, float) / k
            c = np.array(sh, float).reshape(3, 3) / k - np.outer(sp, sq)
            u, _, vt = np.linalg.svd(c)
            d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
            r = vt.T @ d @ u.T
            step = np.eye(4)
            step[:3, :3], step[:3, 3] = r, sq - r @ sp
            out.append((step @ old).ravel())
        return pd.Series(out)

    identity = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    pose = cut(source.select("cloud_id").distinct().withColumn("m", identity) if start is None else start)
    last: float | None = None
    for _ in range(rounds):
        m = F.col("m")
        moved = source.select("cloud_id", "point_id", "x", "y", "z").join(small(pose), "cloud_id")
        at = [sum((m[4 * r + c] * F.col(a) for c, a in enumerate("xyz")), m[4 * r + 3]) for r in range(3)]
        moved = moved.select("cloud_id", "point_id", *[e.alias(a) for e, a in zip(at, "xyz", strict=True)])
        near = within(moved, target.select("cloud_id", "point_id", "x", "y", "z"), reach, "cloud_id")
        best = near.groupBy(F.col("a.cloud_id").alias("cloud_id"), F.col("a.point_id").alias("point_id")).agg(F.min(F.struct("distance", "b.point_id", "a", "b")).alias("t")).select("cloud_id", "t.distance", "t.a", "t.b")
        sums = best.groupBy("cloud_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow("distance", 2))).alias("rmse"), F.array(*[F.sum(f"a.{i}") for i in "xyz"]).alias("p"), F.array(*[F.sum(f"b.{i}") for i in "xyz"]).alias("q"), F.array(*[F.sum(F.col(f"a.{i}") * F.col(f"b.{j}")) for i in "xyz" for j in "xyz"]).alias("h"))
        pose = cut(pose.select("cloud_id", "m").join(sums, "cloud_id", "left").select("cloud_id", solve("n", "p", "q", "h", "m").alias("m"), "rmse", F.coalesce("n", F.lit(0)).alias("pairs")))
        now = pose.agg(F.sum("rmse")).first()[0] or 0.0
        if last is not None and abs(last - now) <= tolerance:
            break
        last = now
    return pose
