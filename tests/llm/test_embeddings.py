import numpy as np
from pyspark.sql import functions as F

from scanloom.llm import embeddings as E


def slow(rows, cosine=0.93):
    ok = {}
    for k, v, lab in rows:
        if v is None or lab is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[k] = (np.array(v) / np.linalg.norm(v), lab)
    link = {k: set() for k, *_ in rows}
    for a in ok:
        for b in ok:
            if a != b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= cosine:
                link[a].add(b)
    comp = {k: k for k in link}
    changed = True
    while changed:
        changed = False
        for a in link:
            for b in link[a]:
                if comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {k: (len(link[k]), comp[k], comp[k] == k) for k in link}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        x = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            y = x + rng.standard_normal(64) * 0.12
            rows.append([len(rows), [float(np.float32(v)) for v in y], int(c % 3)])
    for k in range(20):
        rows.append([len(rows), rows[5][1], 7 if k % 2 else rows[5][2]])
    z = [0.0] * 64
    bad = list(rows[3][1])
    for v in (None, z, [None] + bad[1:], [float("nan")] + bad[1:], [float("inf")] + bad[1:]):
        rows.append([len(rows), v, 1])
    rows.append([len(rows), bad, None])
    rows.append([len(rows), [-0.0 if v == 0 else v for v in bad], 1])
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    want = slow(rows)
    assert got.keys() == want.keys()
    found, there = sum(n for n, *_ in got.values()), sum(n for n, *_ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.98 * there
    if found == there:
        assert got == want


def test_recall_near_the_limit():
    """Pairs at cosine 0.93 exactly, the hardest there are: at least 0.9 of them share a bucket."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    model = E.learn(x)
    a, b = E.codes(x, *model), E.codes(y, *model)
    hit = (np.bitwise_count(a ^ b) <= 1).any(axis=1) & (np.bitwise_count(a ^ b).sum(axis=1) <= E.FAR)
    assert hit.mean() >= 0.95


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(4, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in E.near_duplicates(df).collect()] == [(4, 0, 4, True)]


def test_labels_and_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(8)
    near = lambda n=8: [float(v) for v in x[:n] + rng.standard_normal(n) * 0.01]
    far = [(k, [float(v) for v in rng.standard_normal(8)], 5.0) for k in range(100, 140)]
    rows = [(0, near(), 5.0), (1, near(), 5.0 + 2**44), (2, near(), 5.0), (3, near(), 1.2), (4, near(), 1.4), (5, near(6), 5.0), (6, near(6), 5.0), (7, near(3), None)] + far
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    for d in (df, df.withColumn("label", F.col("label").cast("string")), df.withColumn("label", (F.col("label") * 10).cast("long"))):
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(d).collect() if r.vec_id < 100}
        assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_tiny_and_huge_vectors(spark):
    """Norms that under- or overflow: the same links as of vectors a power of two apart, and no failure."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    near = base + rng.normal(size=(40, 8)) * 0.05
    rows, n = [], 0
    for scale in (1.0, 1e-200, 1e-310, 1e300):
        for x, y in zip(base, near, strict=True):
            rows += [(n, "a", (x * scale).tolist()), (n + 1, "a", (y * scale).tolist())]
            n += 2
    rows += [(n, "b", [5e-324, 5e-324]), (n + 1, "b", [1e308, 1e308]), (n + 2, "b", [1e308, -1e308])]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    exact = [np.array(v) / np.abs(v).max() for _, _, v in rows]
    for i, l, v in rows:
        cos = [(j, exact[i] @ exact[j] / np.linalg.norm(exact[i]) / np.linalg.norm(exact[j])) for j, m, w in rows if m == l and j != i]
        sure = sum(c >= 0.94 for _, c in cos)
        assert sure <= got[i].n_links <= sum(c >= 0.92 for _, c in cos), i
    assert got[n + 1].component_id == n and got[n + 2].n_links == 0
