"""Visiting order of a mission's faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a part of a running number, about.
PART_ROWS = 200_000
GROUP = "struct<g:int,fx:double,fy:double,fz:double,lx:double,ly:double,lz:double>"


def numbered(df: DataFrame, key: Column, order: list[str], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df with ``name``: the place of a row within its key, from 1, by the columns order, the first of which is a number.

    Rows are cut into parts of equal width of that number; each part is numbered by itself and what the parts before it hold is
    added, so that a key with many rows is many tasks.
    """
    lead = F.col(order[0])
    n, lo, hi = df.agg(F.count("*"), F.min(lead), F.max(lead)).first()
    parts = -(-n // part_rows)
    if parts <= 1 or lo is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    part = F.coalesce(F.floor((lead - lo) / ((hi - lo) / parts or 1.0)), F.lit(-1)).cast("long")  # nulls come first
    rows = df.withColumns({"_key": key, "_part": part})
    sizes = rows.groupBy("_key", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_key").alias("_of"), F.col("_part").alias("_at"), before.alias("_before"))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)))
    rows = rows.join(F.broadcast(sizes), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    return rows.select(*df.columns, (F.col("_row") + F.col("_before")).cast("int").alias(name))


def face_groups(waypoints: DataFrame, key: str = "mission_id") -> DataFrame:
    """``key, groups``: first and last waypoint of every face, by face; at most one row a face."""
    p = F.struct("idx", "x", "y", "z")
    g = waypoints.where("facade_index >= 0").groupBy(key, "facade_index").agg(F.min(p).alias("f"), F.max(p).alias("l"))
    item = F.struct(F.col("facade_index").cast("int").alias("g"), *[F.col(f"{s}.{a}").alias(f"{s}{a}") for s in "fl" for a in "xyz"])
    return g.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("groups"))


def _d(a: str, b: str) -> str:
    return f"sqrt(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y)+({a}z-{b}z)*({a}z-{b}z))"


def nearest_neighbour_tour(groups: DataFrame, key: str = "mission_id") -> DataFrame:
    """``key, position, facade_index``: start at the face whose middle (of first and last waypoint) is nearest
    to the origin, then always the unvisited face cheapest to reach at either end; ties take the lower face.
    Missions of up to two faces keep their order."""
    mid = "sqrt((g.fx+g.lx)*(g.fx+g.lx)+(g.fy+g.ly)*(g.fy+g.ly)+(g.fz+g.lz)*(g.fz+g.lz))/2"
    start = f"array_min(transform(groups, g -> struct({mid} as d, g.g as g)))"
    cost = f"least({_d('s.at.l', 'g.f')}, {_d('s.at.l', 'g.l')})"
    near = f"array_min(transform(s.rest, g -> struct({cost} as d, g.g as g, g as w)))"
    # Each step looks at the faces that are left once.
    step = f"""aggregate(sequence(2, size(groups)), named_struct('o', array(first), 'at', element_at(filter(groups, g -> g.g = first), 1), 'rest', filter(groups, g -> g.g <> first)),
      (s, i) -> element_at(transform(array({near}), b -> named_struct('o', concat(s.o, array(b.g)), 'at', b.w, 'rest', filter(s.rest, g -> g.g <> b.g))), 1),
      s -> s.o)"""
    rows = groups.withColumn("first", F.expr(f"{start}.g"))
    order = F.when(F.size("groups") <= 2, F.transform("groups", lambda g: g["g"])).otherwise(F.expr(step))
    return rows.select(key, F.posexplode(order).alias("position", "facade_index"))


def sweep_reversal(groups: DataFrame, key: str = "mission_id") -> DataFrame:
    """``key, facade_index, reversed``: in face order, turn a face round when its end is over 0.1 m nearer to the last exit."""
    sql = f"""aggregate(groups, named_struct('o', cast(array() as array<struct<g:int,r:boolean>>), 'e', cast(null as struct<x:double,y:double,z:double>)),
      (s, g) -> CASE WHEN s.e is not null AND {_d('s.e.', 'g.l')} < {_d('s.e.', 'g.f')} - 0.1
        THEN named_struct('o', concat(s.o, array(named_struct('g', g.g, 'r', true))), 'e', named_struct('x', g.fx, 'y', g.fy, 'z', g.fz))
        ELSE named_struct('o', concat(s.o, array(named_struct('g', g.g, 'r', false))), 'e', named_struct('x', g.lx, 'y', g.ly, 'z', g.lz)) END, s -> s.o)"""
    return groups.select(key, F.explode(F.expr(sql)).alias("o")).select(key, F.col("o.g").alias("facade_index"), F.col("o.r").alias("reversed"))
