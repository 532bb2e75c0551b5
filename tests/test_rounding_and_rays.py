import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scanloom.operators import generate
from scanloom.plans.common import decimals, facades


def test_decimals_are_duckdbs(spark):
    rng = np.random.default_rng(3)
    x = [*((rng.integers(-(10**9), 10**9, 3000) + 0.5) / 1e6).tolist(), *rng.normal(0, 1e3, 500).tolist(), 0.0, -0.0, 1 / 128, -1 / 128, 1e-7, 123456789.1234565, 3e11]
    duck = duckdb.connect().execute("SELECT round(v, 6) + 0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [x]).fetchall()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").select("i", (decimals(F.col("v"), 6) + F.lit(0.0)).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [d[0] for d in duck]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,), (1e300,), (-1e300,)], "v double").select(decimals(F.col("v"), 6)).collect()
    assert math.isnan(odd[0][0]) and [r[0] for r in odd[1:]] == [math.inf, -math.inf, None, 1e300, -1e300]


def held(cx, cy, nx, ny, want, ring):
    flat = math.hypot(nx, ny)

    def inside(x, y):
        n = 0
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]
        return n % 2 == 1

    if flat < 1e-6 or len(ring) < 3 or not inside(cx, cy):
        return want
    out = next((k * 0.25 for k in range(1, int(want / 0.25) + 1) if not inside(cx + nx / flat * k * 0.25, cy + ny / flat * k * 0.25)), want)
    return min(want, max(2.0, out - 0.5))


def test_standoff_of_rays_in_rings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 9))
        ring = [(float(r * math.cos(a)), float(r * math.sin(a))) for a, r in zip(np.sort(rng.random(n)) * 2 * math.pi, rng.random(n) * 9 + 1, strict=True)]
        nx, ny = (0.0, 0.0) if i % 11 == 0 else rng.normal(size=2).tolist()
        rows.append((i, *rng.normal(0, 1, 2).tolist(), nx, ny, float(rng.choice([0.1, 2.0, 7.0, 12.3])), ring))
    odd = [(400, None, 0.0, 1.0, 0.0, 7.0, rows[1][6]), (401, 0.0, 0.0, 1.0, 0.0, 7.0, None), (402, 0.0, 0.0, 1.0, 0.0, math.inf, []), (403, math.nan, 0.0, 1.0, 0.0, 7.0, [(-3.0, -3.0), (3.0, -3.0), (0.0, 3.0)])]
    df = spark.createDataFrame(rows + odd, "i int, cx double, cy double, nx double, ny double, want double, ring array<struct<x: double, y: double>>").where("i <> 402")
    got = df.select("i", generate.clamp_standoff(*[F.col(c) for c in ("cx", "cy", "nx", "ny", "want", "ring")]).alias("s"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().toString()
    found = {r.i: r.s for r in got.collect()}
    assert len(found) == 403 and all(math.isclose(found[r[0]], held(*r[1:])) for r in rows)


def test_index_from_the_sizes_of_faces(spark):
    f = facades(spark, "/root/testdata/sf0.001").where("building_id < 40")
    want = {tuple(r) for r in generate.global_index(generate.facade_waypoints(f)).select("building_id", "facade_index", "seq", "idx").collect()}
    assert {tuple(r) for r in generate.facade_waypoints(f, index=True).select("building_id", "facade_index", "seq", "idx").collect()} == want and len(want) > 1000
