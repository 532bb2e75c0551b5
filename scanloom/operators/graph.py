"""Graph operators on edge-list DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.groups import by_key
from scanloom.session import cut, kept


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of the edges a, b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        lu, lv, new = low[u], low[v], low.copy()
        least = np.minimum(lu, lv)
        np.minimum.at(new, lu, least)
        np.minimum.at(new, lv, least)
        while (far := new[new]).tobytes() != new.tobytes():
            new = far
        if (new == low).all():
            return ids, ids[low]
        low = new


def near_components(edges: DataFrame, near: list[str]) -> DataFrame:
    """:func:`connected_components` of edges ``src, dst`` (long) most of which stay within one group of ``near``; a group should be some thousands of edges at most.

    A group is settled where it lies and gives every node its least node there; only nodes of several groups link those, and what they link is contracted in rounds.
    """
    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("node", "root"), forest(pdf["src"].to_numpy(), pdf["dst"].to_numpy()), strict=True)))

    local = kept(by_key(edges.where("src is not null and dst is not null"), near, stars, "node long, root long"), "stars")
    shared = kept(local.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("node", "low"), "shared-nodes")
    if shared.isEmpty():
        return local.select("node", F.col("root").alias("component"))
    links = local.join(shared, "node").select(F.col("root").alias("src"), F.col("low").alias("dst"))
    whole = cut(connected_components(links).withColumnRenamed("node", "root"))
    return local.join(whole, "root", "left").select("node", F.coalesce("component", "root").alias("component")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node id of every node that has an edge.

    Alternates large-star and small-star contractions (each two shuffles on the
    node key, with map-side minima), so long chains shrink in O(log n) rounds and
    a hot node only ever costs partial aggregates and a splittable join. Every
    round is checkpointed; rounds end when the edges stay the same, told by their number and two
    64-bit sums. Returns ``node, component``; self loops give single
    nodes; null ends are ignored.
    """
    pairs = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"))
    loops = pairs.where("a = b").select("a", "b")
    e = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = cut(e.select("u").union(e.select("v")).union(loops.select("a")).distinct().toDF("node"))
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low).distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
