"""Planes of scan clouds as faces: parallel planes share a normal, like offsets merge, inliers become rectangles.

Rows without a cloud or plane id belong to no plane; points with a missing or non-finite coordinate are left
out; repeated points count as often as they come; other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import vec
from scanloom.operators.joins import small
from scanloom.operators.quantiles import group_quantiles
from scanloom.session import kept

#: Classes by the vertical part of the normal, least sizes in metres and square metres, points a square metre, percent trimmed.
WALL_NZ, ROOF_NZ = 0.35, 0.70
MIN_LENGTH, MIN_SIDE, MIN_WALL, MIN_ROOF, MIN_TILTED = 0.6, 0.4, 0.5, 0.5, 0.4
MIN_DENSITY, TRIM = 25.0, 5.0
TAGS = {"wall": "21.1", "roof": "27.1", "tilted": "27.2"}


def _finite(*axes: str) -> Column:
    ok = F.lit(True)
    for a in axes:
        ok &= F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
    return ok


def inlier_centres(inliers: DataFrame) -> DataFrame:
    """``cloud_id, plane_id, points, cx, cy, cz`` of labelled points."""
    return inliers.where(_finite("x", "y", "z")).groupBy("cloud_id", "plane_id").agg(F.count("*").alias("points"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])


def snap_parallel(planes: DataFrame, degrees: float = 5.0) -> DataFrame:
    """Planes ``cloud_id, plane_id, points, nx, ny, nz, cx, cy, cz`` with the common normal of their group, ``group_id`` and offset ``d``.

    In plane_id order a plane joins the first group whose first plane looks the same or the opposite way within
    ``degrees``, else it opens one. The common normal is the mean of the group's normals, turned to the first one's
    side and weighted by points; d is the centre's distance along it. A group's first planes lie degrees apart, so the
    fold's state has a bound (some 1,000 for 5 degrees); what it walks are a cloud's planes, no points.
    """
    own = F.struct("plane_id", "nx", "ny", "nz")
    per = planes.where(F.col("cloud_id").isNotNull() & F.col("plane_id").isNotNull()).groupBy("cloud_id").agg(F.array_sort(F.collect_list(own)).alias("ps"))
    cos = F.cos(F.radians(F.lit(float(degrees))))
    dot = lambda a, b: a["nx"] * b["nx"] + a["ny"] * b["ny"] + a["nz"] * b["nz"]
    none = F.slice("ps", 1, 0)
    first = per.select("cloud_id", F.aggregate("ps", none, lambda acc, p: F.when(F.exists(acc, lambda g: F.abs(dot(g, p)) >= cos), acc).otherwise(F.concat(acc, F.array(p)))).alias("leads"))
    rows = planes.join(small(first), "cloud_id").withColumn("lead", F.try_element_at(F.filter("leads", lambda g: F.abs(dot(g, own)) >= cos), F.lit(1)))
    side = F.when(dot(F.col("lead"), own) < 0, -1.0).otherwise(1.0)
    w = Window.partitionBy("cloud_id", F.col("lead.plane_id"))
    for a in "xyz":
        rows = rows.withColumn(f"m{a}", F.sum(F.col(f"n{a}") * side * F.col("points")).over(w))
    size = F.sqrt(F.expr("mx*mx + my*my + mz*mz"))
    n = [F.when(size > 1e-9, F.col(f"m{a}") / size).otherwise(F.col(f"lead.n{a}")) for a in "xyz"]
    rows = rows.select("cloud_id", "plane_id", F.col("lead.plane_id").alias("group_id"), "points", *[e.alias(f"n{a}") for e, a in zip(n, "xyz", strict=True)], "cx", "cy", "cz")
    return rows.withColumn("d", F.expr("nx*cx + ny*cy + nz*cz"))


def merge_coplanar(snapped: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """``cloud_id, plane_id, group_id, points, nx, ny, nz, d, members``: planes of a group whose offsets, in ascending order,
    come within tolerance of the running mean (weighted by points) become one, named after its largest member (of equals the first)."""
    own = F.struct("d", "plane_id", "points", "nx", "ny", "nz")
    per = snapped.groupBy("cloud_id", "group_id").agg(F.array_sort(F.collect_list(own)).alias("ps"))
    opened = lambda p: F.struct(p["d"].alias("d"), p["points"].alias("points"), F.array(p).alias("ps"))
    none = F.slice(F.array(opened(F.col("ps")[0])), 1, 0)

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        total = last["points"] + p["points"]
        mean = (last["d"] * last["points"] + p["d"] * p["points"]) / total
        wide = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(mean.alias("d"), total.alias("points"), F.concat(last["ps"], F.array(p)).alias("ps"))))
        return F.when(F.size(acc) == 0, F.array(opened(p))).otherwise(F.when(F.abs(last["d"] - p["d"]) <= tolerance, wide).otherwise(F.concat(acc, F.array(opened(p)))))

    rows = per.select("cloud_id", "group_id", F.explode(F.aggregate("ps", none, step)).alias("g"))
    most = F.array_max(F.transform("g.ps", lambda p: p["points"]))
    lead = F.filter("g.ps", lambda p: p["points"] == most)[0]
    members = F.transform("g.ps", lambda p: p["plane_id"])
    return rows.select("cloud_id", lead["plane_id"].alias("plane_id"), "group_id", "g.points", lead["nx"].alias("nx"), lead["ny"].alias("ny"), lead["nz"].alias("nz"), "g.d", members.alias("members"))


def relabel(inliers: DataFrame, merged: DataFrame) -> DataFrame:
    """Inliers under the ids of the merged planes."""
    of = merged.select("cloud_id", F.col("plane_id").alias("to"), F.explode("members").alias("plane_id"))
    return inliers.join(small(of), ["cloud_id", "plane_id"]).withColumn("plane_id", F.col("to")).drop("to")


def _larger_positive(v: Column) -> Column:
    """v or its opposite: the largest part, the first of equals, is positive."""
    ax, ay, az = F.abs(v["x"]), F.abs(v["y"]), F.abs(v["z"])
    lead = F.when((ax >= ay) & (ax >= az), v["x"]).when(ay >= az, v["y"]).otherwise(v["z"])
    return vec.scale(v, F.when(lead < 0, -1.0).otherwise(1.0))


def frames(planes: DataFrame, inliers: DataFrame, centres: DataFrame) -> DataFrame:
    """``cloud_id, plane_id, points, n, u, v, c``: outward normal (away from the cloud's centre), two directions in the plane, centre of the inliers.

    A wall's u is level; otherwise u is the direction in which the inliers spread most, its largest part positive, from
    second moments about the centre in a basis of the plane.
    """
    inliers = inliers.select("cloud_id", "plane_id", "x", "y", "z")
    own = planes.select("cloud_id", "plane_id", "nx", "ny", "nz").join(inlier_centres(inliers), ["cloud_id", "plane_id"]).join(small(centres), "cloud_id")
    out = F.when(F.expr("nx*(cx-ox) + ny*(cy-oy) + nz*(cz-oz)") < 0, -1.0).otherwise(1.0) / F.sqrt(F.expr("nx*nx + ny*ny + nz*nz"))
    rows = own.withColumn("out", out).select("cloud_id", "plane_id", "points", vec.scale(vec.at("nx", "ny", "nz"), F.col("out")).alias("n"), vec.at("cx", "cy", "cz").alias("c"))
    up = F.when(F.abs(F.col("n.z")) < 0.9, vec.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(vec.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    rows = rows.withColumn("up", up).withColumn("a", vec.cross(F.col("n"), F.col("up"))).withColumn("a", vec.unit(F.col("a"))).withColumn("b", vec.cross(F.col("n"), F.col("a")))
    at = inliers.where(_finite("x", "y", "z")).join(small(rows.select("cloud_id", "plane_id", "a", "b", "c")), ["cloud_id", "plane_id"])
    at = at.withColumn("off", vec.sub(vec.at(), F.col("c"))).select("cloud_id", "plane_id", vec.dot(F.col("off"), F.col("a")).alias("p"), vec.dot(F.col("off"), F.col("b")).alias("q"))
    spread = at.groupBy("cloud_id", "plane_id").agg(F.sum(F.expr("p*p")).alias("pp"), F.sum(F.expr("p*q")).alias("pq"), F.sum(F.expr("q*q")).alias("qq"))
    turn = 0.5 * F.atan2(2 * F.col("pq"), F.col("pp") - F.col("qq"))
    most = [F.col(f"a.{i}") * F.cos("turn") + F.col(f"b.{i}") * F.sin("turn") for i in "xyz"]
    flat = F.sqrt(F.col("n.x") * F.col("n.x") + F.col("n.y") * F.col("n.y"))
    level = vec.vec(F.col("n.y") / F.col("flat"), -F.col("n.x") / F.col("flat"), F.lit(0.0))
    rows = rows.join(spread, ["cloud_id", "plane_id"]).withColumn("turn", turn).withColumn("flat", flat).withColumn("most", vec.vec(*most))
    rows = rows.withColumn("u", F.when((F.abs(F.col("n.z")) <= WALL_NZ) & (F.col("flat") > 1e-6), level).otherwise(_larger_positive(F.col("most"))))
    return rows.select("cloud_id", "plane_id", "points", "n", "u", vec.cross(F.col("n"), F.col("u")).alias("v"), "c")


def oriented_rectangles(planes: DataFrame, inliers: DataFrame, centres: DataFrame | None = None, trim: float = TRIM, density: float = MIN_DENSITY) -> DataFrame:
    """Faces ``cloud_id, plane_id, points, width, height, area, kind, nx, ny, nz, vertices`` of planes with a normal and their labelled points.

    Extents are the inliers' least and largest under 2 square metres, else trimmed by 40 % of ``trim`` percent at either end, rising to all of it
    from 20 square metres on. Planes with too few points a square metre, too short or too small for their class
    go. centres: ``cloud_id, ox, oy, oz``, the middle of each cloud (of the inliers, if not given).
    """
    key = ["cloud_id", "plane_id"]
    inliers = inliers.select(*key, "x", "y", "z")
    if centres is None:
        centres = inliers.where(_finite("x", "y", "z")).groupBy("cloud_id").agg(*[F.avg(a).alias(f"o{a}") for a in "xyz"])
    f = kept(frames(planes, inliers, centres), "plane-frames")
    at = inliers.where(_finite("x", "y", "z")).join(small(f.select(*key, "u", "v", "c")), key).withColumn("off", vec.sub(vec.at(), F.col("c")))
    at = at.select(*key, vec.dot(F.col("off"), F.col("u")).alias("pu"), vec.dot(F.col("off"), F.col("v")).alias("pv"))
    at = kept(at, "plane-places")
    size = at.groupBy(*key).agg(F.min("pu").alias("u0"), F.max("pu").alias("u1"), F.min("pv").alias("v0"), F.max("pv").alias("v1"))
    raw = F.greatest((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")), F.lit(1e-6))
    cut = F.when(raw < 2.0, 0.0).otherwise(trim * (0.4 + 0.6 * F.least(F.lit(1.0), raw / 20.0)) / 100.0)
    shares = size.select(*key, F.array(cut, 1.0 - cut).alias("shares"))
    q = lambda c: group_quantiles(at, key, c, shares).withColumnRenamed("quantiles", f"q{c}")
    r = f.join(q("pu"), key).join(q("pv"), key)
    r = r.withColumns({"width": F.col("qpu")[1] - F.col("qpu")[0], "height": F.col("qpv")[1] - F.col("qpv")[0]})
    r = r.withColumn("area", F.greatest(F.col("width") * F.col("height"), F.lit(1e-6)))
    nz, least, most = F.abs(F.col("n.z")), F.least("width", "height"), F.greatest("width", "height")
    kind = F.when(nz <= WALL_NZ, "wall").when(nz >= ROOF_NZ, "roof").otherwise("tilted")
    big = F.when(F.col("kind") == "wall", (least >= MIN_SIDE) & (most >= MIN_LENGTH) & (F.col("area") >= MIN_WALL)).otherwise(F.col("area") >= F.when(F.col("kind") == "roof", MIN_ROOF).otherwise(MIN_TILTED))
    r = r.withColumn("kind", kind).where((F.col("points") / F.col("area") >= density) & big)
    corner = lambda i, j: vec.vec(*[F.col(f"c.{a}") + F.col(f"u.{a}") * F.col("qpu")[i] + F.col(f"v.{a}") * F.col("qpv")[j] for a in "xyz"])
    corners = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return r.select(*key, "points", "width", "height", "area", "kind", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.z").alias("nz"), corners.alias("vertices"))


def as_facades(rectangles: DataFrame) -> DataFrame:
    """``building_id`` (the cloud's), ``facade_index, label, component_tag`` and centre added to rectangles, counted in plane order, per class and over all."""
    by = Window.partitionBy("cloud_id").orderBy("plane_id")
    each = Window.partitionBy("cloud_id", "kind").orderBy("plane_id")
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.col("kind"))
    centre = lambda a: F.aggregate("vertices", F.lit(0.0), lambda s, p: s + p[a]) / F.size("vertices")
    return rectangles.select(F.col("cloud_id").alias("building_id"), (F.row_number().over(by) - 1).alias("facade_index"), F.concat_ws("_", "kind", (F.row_number().over(each) - 1).cast("string")).alias("label"), tag.alias("component_tag"), "nx", "ny", "nz", *[centre(a).alias(f"c{a}") for a in "xyz"], "vertices", "width", "height", "area", "points")
