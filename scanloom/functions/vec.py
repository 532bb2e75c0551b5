"""Vectors as ``STRUCT<x, y, z>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def at(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """The vector of three columns."""
    return vec(F.col(x), F.col(y), F.col(z))


def once(**columns: Column) -> Column:
    """The columns as a generator of one row: long expressions are computed once and not written out in every filter and column that reads them."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scale(a: Column, s: Column) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def unit(a: Column) -> Column:
    """Unit vector; null for a length under 1e-9."""
    n = norm(a)
    return F.when(n >= 1e-9, scale(a, 1 / n))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))
