"""Exact quantiles whose share differs from group to group, without sorting a whole group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.joins import small

#: Buckets between a group's least and largest value: only those that hold a wanted rank are sorted.
BUCKETS = 1024


def group_quantiles(values: DataFrame, keys: list[str], value: str, shares: DataFrame, share: str = "shares") -> DataFrame:
    """``keys, quantiles``: the linearly interpolated quantiles of ``value`` at the shares (array, 0 to 1) of its group in ``shares``.

    A count per bucket tells where a rank lies; ranks at a bucket's ends are its extremes, the others are looked
    up in the bucket, which holds about a BUCKETS-th of the group. Null values don't count; groups without
    values or shares give no row.
    """
    names, keys = keys, [f"key_{i}" for i in range(len(keys))]  # so that no key clashes with the columns made here
    shares = shares.select(*[F.col(k).alias(i) for k, i in zip(names, keys, strict=True)], F.col(share).alias("shares"))
    v = values.select(*[F.col(k).alias(i) for k, i in zip(names, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null")
    base = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int"))).otherwise(0)
    filed = v.join(small(base), keys).select(*keys, "v", bucket.alias("b"))
    w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = filed.groupBy(*keys, "b").agg(F.count("*").alias("m"), F.min("v").alias("first"), F.max("v").alias("last")).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    at = base.select(*keys, "n").join(shares.select(*keys, F.posexplode("shares").alias("pos", "q")), keys)
    rank = F.col("q") * (F.col("n") - 1)
    at = at.select(*keys, "pos", F.floor(rank).alias("k"), (rank - F.floor(rank)).alias("w"), (F.col("n") - 1).alias("top"))
    at = at.select(*keys, "pos", "w", F.posexplode(F.array(F.col("k"), F.least(F.col("k") + 1, F.col("top")))).alias("side", "k"))
    hit = at.join(counts, keys).where("before <= k and k < before + m").withColumn("r", F.col("k") - F.col("before"))
    end = (F.col("first") == F.col("last")) | (F.col("r") == 0) | (F.col("r") == F.col("m") - 1)
    easy = hit.where(end).select(*keys, "pos", "side", "w", F.when(F.col("r") == 0, F.col("first")).otherwise(F.col("last")).alias("v"))
    deep = hit.where(~end).select(*keys, "pos", "side", "w", "b", "r")
    inside = filed.join(small(deep.select(*keys, "b").distinct()), [*keys, "b"], "left_semi")
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "b").orderBy("v")) - 1)
    found = easy.unionByName(ranked.join(deep, [*keys, "b", "r"]).select(*keys, "pos", "side", "w", "v"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    each = found.groupBy(*keys, "pos", "w").agg(pick(0).alias("a"), pick(1).alias("z"))
    whole = each.select(*keys, F.struct("pos", (F.col("a") + (F.col("z") - F.col("a")) * F.col("w")).alias("v")).alias("s"))
    return whole.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("quantiles")).withColumnsRenamed(dict(zip(keys, names, strict=True)))
