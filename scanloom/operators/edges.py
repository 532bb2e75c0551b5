"""Faces from the edges of an area, kept where a cloud has points behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import polygon, vec
from scanloom.operators.joins import small
from scanloom.operators.quantiles import group_quantiles
from scanloom.session import kept

#: Edge of the cells in which samples look for points, metres.
CELL = 2.0


def edge_samples(rings: DataFrame, step: float = 1.0, least_edge: float = 1.5) -> DataFrame:
    """``cloud_id, edge, length, ax, ay, bx, by, dx, dy, sample, pitch, sx, sy`` of edges in counter-clockwise order; edges that are too short have one row without a sample.

    An edge has as many samples as steps (rounded to even), two at least, each in the middle of its share, ``pitch`` long.
    """
    ring = F.col("ring")
    closed = (F.element_at(ring, 1)["x"] == F.element_at(ring, -1)["x"]) & (F.element_at(ring, 1)["y"] == F.element_at(ring, -1)["y"])
    r = rings.where(F.size("ring") >= 3).select("cloud_id", F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring).alias("ring")).where(F.size("ring") >= 3)
    r = r.withColumn("ring", polygon.ensure_ccw(F.col("ring")))
    e = r.select("cloud_id", F.size("ring").alias("n"), "ring", F.posexplode("ring").alias("edge", "a")).withColumn("b", F.element_at("ring", (F.col("edge") + 1) % F.col("n") + 1))
    e = e.select("cloud_id", "edge", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    e = e.withColumn("length", F.sqrt(F.expr("(bx-ax)*(bx-ax) + (by-ay)*(by-ay)")))
    e = e.withColumns({"dx": F.try_divide(F.col("bx") - F.col("ax"), "length"), "dy": F.try_divide(F.col("by") - F.col("ay"), "length")})
    n = F.when(F.col("length") >= least_edge, F.greatest(F.lit(2), F.bround(F.col("length") / step).cast("int"))).otherwise(0)
    e = e.withColumn("samples", n).withColumn("pitch", F.try_divide("length", "samples"))
    s = e.withColumn("sample", F.explode_outer(F.when(F.col("samples") > 0, F.sequence(F.lit(0), F.col("samples") - 1))))
    along = (F.col("sample") + 0.5) * F.col("pitch")
    return s.withColumns({"sx": F.col("ax") + along * F.col("dx"), "sy": F.col("ay") + along * F.col("dy")})


def edge_hits(samples: DataFrame, points: DataFrame, heights: DataFrame, slab: float = 5.0) -> DataFrame:
    """``cloud_id, edge, sample, inward`` of all points inside a sample's slab: 0.5 m outside to ``slab`` inside the edge, 0.6 of
    its pitch to either side, above a fifth of the cloud's height and at most 1 m over its top. Samples file the cells that their slabs touch; points look into their own."""
    reach = F.lit(slab) + 0.6 * F.col("pitch") + 0.5
    lo, hi = lambda c: F.floor((F.col(c) - reach) / CELL), lambda c: F.floor((F.col(c) + reach) / CELL)
    near = samples.where("sample is not null").select("cloud_id", "edge", "sample", "pitch", "dx", "dy", "sx", "sy", F.explode(F.sequence(lo("sx"), hi("sx"))).alias("ix"), lo("sy").alias("y0"), hi("sy").alias("y1")).withColumn("iy", F.explode(F.sequence("y0", "y1"))).drop("y0", "y1")
    above = points.join(small(heights), "cloud_id").where((F.col("z") > F.col("ground") + 0.2 * F.col("height")) & (F.col("z") < F.col("top") + 1.0))
    p = above.select("cloud_id", "x", "y", F.floor(F.col("x") / CELL).alias("ix"), F.floor(F.col("y") / CELL).alias("iy"))
    rows = p.join(near, ["cloud_id", "ix", "iy"]).withColumns({"inward": F.expr("(x-sx)*(-dy) + (y-sy)*dx"), "along": F.expr("(x-sx)*dx + (y-sy)*dy")})
    return rows.where((F.col("inward") > -0.5) & (F.col("inward") < slab) & (F.abs("along") < 0.6 * F.col("pitch"))).select("cloud_id", "edge", "sample", "inward")


def polygon_edge_facades(rings: DataFrame, points: DataFrame, slab: float = 5.0, step: float = 1.0, least_hits: float = 0.40, least_edge: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(faces ``cloud_id, facade_index, label, component_tag, nx, ny, nz, vertices``, edges ``cloud_id, edge, length, samples, hit_rate, mean_inward_m, dropped``).

    rings: ``cloud_id, ring`` of (x, y). A wall stands on every edge of which enough samples have points behind them, from the 5th to the 95th
    percentile of height; one flat roof closes the ring. mean_inward_m: mean over hit samples of the median depth of
    their points. Clouds without points or a ring of three corners give no rows; points without a place are left out.
    """
    ok = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in "xyz")
    p = points.where(ok)
    shares = rings.where(F.size("ring") >= 3).select("cloud_id", F.array(F.lit(0.05), F.lit(0.95)).alias("shares"))
    z = group_quantiles(p, ["cloud_id"], "z", shares).select("cloud_id", F.col("quantiles")[0].alias("ground"), F.col("quantiles")[1].alias("top"))
    z = kept(z.withColumn("height", F.greatest(F.lit(3.0), F.col("top") - F.col("ground"))), "edge-heights")
    s = kept(edge_samples(rings, step, least_edge).join(z.select("cloud_id"), "cloud_id", "left_semi"), "edge-samples")
    hits = kept(edge_hits(s, p, z, slab), "edge-hits")
    key = ["cloud_id", "edge", "sample"]
    half = hits.select(*key).distinct().withColumn("shares", F.array(F.lit(0.5)))
    mid = group_quantiles(hits, key, "inward", half).select("cloud_id", "edge", F.col("quantiles")[0].alias("m"))
    found = mid.groupBy("cloud_id", "edge").agg(F.count("*").alias("hits"), F.avg("m").alias("mean_inward_m"))
    e = s.select("cloud_id", "edge", "length", "samples", "ax", "ay", "bx", "by", "dx", "dy").distinct().join(found, ["cloud_id", "edge"], "left")
    rate = F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), "samples"), F.lit(0.0))
    e = kept(e.withColumn("hit_rate", rate).withColumn("dropped", F.col("hit_rate") < least_hits), "edge-rates")
    w = e.where("not dropped").join(small(z), "cloud_id").withColumn("wall", F.row_number().over(Window.partitionBy("cloud_id").orderBy("edge")) - 1)
    at = lambda x, y, h: vec.vec(F.col(x), F.col(y), F.col(h))
    corners = F.array(at("ax", "ay", "ground"), at("bx", "by", "ground"), at("bx", "by", "top"), at("ax", "ay", "top"))
    walls = w.select("cloud_id", F.col("wall").alias("facade_index"), F.format_string("wall_%02d", "wall").alias("label"), F.lit("21.1").alias("component_tag"), F.col("dy").alias("nx"), (-F.col("dx")).alias("ny"), F.lit(0.0).alias("nz"), corners.alias("vertices"))
    n = walls.groupBy("cloud_id").agg(F.count("*").cast("int").alias("walls"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("edge", "ax", "ay"))), lambda c: F.struct(c["ax"].alias("x"), c["ay"].alias("y")))
    roofs = e.groupBy("cloud_id").agg(ring.alias("ring")).join(small(z), "cloud_id").join(n, "cloud_id", "left")
    roofs = roofs.select("cloud_id", F.coalesce("walls", F.lit(0)).alias("facade_index"), F.lit("roof").alias("label"), F.lit("27.1").alias("component_tag"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.transform("ring", lambda c: vec.vec(c["x"], c["y"], F.col("top"))).alias("vertices"))
    return walls.unionByName(roofs), e.select("cloud_id", "edge", "length", "samples", "hit_rate", "mean_inward_m", "dropped")
