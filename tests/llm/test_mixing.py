import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import mixing as M


def slow(rows, a, block_docs, seed=7, budget=None):
    md = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    by = {}
    for k, s, n in rows:
        by.setdefault(s, []).append((k, n))
    size = {s: sum(n for _, n in d) for s, d in by.items()}
    norm = sum(t**a for t in size.values() if t)
    whole = max((t ** (1 - a) for t in size.values() if t), default=0) * norm if budget is None else budget
    out = []
    for s, d in by.items():
        t = size[s]
        quota = math.floor(t**a / norm * whole + 1e-6) if t else 0
        if budget is None:
            quota = max(quota, t)
        name = "-" if s is None else "=" + s
        nb = -(-len(d) // block_docs)
        block = lambda k: int(md(seed, "-" if k is None else k)[:8], 16) % nb
        for e in range(max(1, -(-quota // t)) if t else 1):
            left, at = quota - e * t, 0
            for b in sorted(range(nb), key=lambda b: (md(seed, e, name, b), b)):
                own = sorted([x for x in d if block(x[0]) == b], key=lambda x: (md(seed, e, "-" if x[0] is None else x[0]), x[1]))
                for k, n in own:
                    if at < left or not t or (budget is None and e == 0):
                        out.append((k, s, n, e, b, e * t + at))
                    at += n
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("big", 200), ("mid", 40), ("small", 6), (None, 9), ("blank", 3)):
        for _ in range(n):
            rows.append((len(rows), s, 0 if s == "blank" else rng.randint(0, 30)))
    return rows


@pytest.mark.parametrize("budget", [None, 900.0])
def test_mix_against_brute_force(spark, budget):
    rows = rows_of(1)
    df = spark.createDataFrame([(k, s, " ".join(["w"] * n) if n or k % 2 else None, 1) for k, s, n in rows], "doc_id long, source string, text string, epoch int")
    sizes = M.source_sizes(M.token_counts(df))
    a = M.exponent(sizes, 0.97, 50.0)
    got = M.mix(df, 0.97, 50.0, budget, block_docs=16).collect()
    key = lambda r: tuple("~" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(slow(rows, a, 16, budget=budget), key=key)
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_exponent_meets_its_target(spark):
    sizes = spark.createDataFrame([("a", 9, 900), ("b", 9, 90), ("c", 9, 10), ("d", 1, 0)], "source string, docs long, tokens long")
    p = [900.0, 90.0, 10.0]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = M.exponent(sizes, 0.9, 1e9)
    assert entropy(a) >= 0.9 * math.log(3) > entropy(a + 2e-7)
    a = M.exponent(sizes, 0.9, 4.0)
    assert (10 / 900) ** (a - 1) <= 4 < (10 / 900) ** (a - 1 - 2e-7)


def test_edges(spark):
    shape = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], shape)).collect() == []
    one = M.mix(spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "a", None)], shape)).collect()
    assert sorted(r.doc_id for r in one) == [1, 1, 2]
    # Rows that share a key but not a length have their places in order of it, and a very long text is one row.
    tied = spark.createDataFrame([(1, "a", "w " * n) for n in (5, 3, 9, 200_000, 4)], shape)
    got = [sorted((r.n_tokens, r.start) for r in M.mix(d).collect()) for d in (tied, tied.repartition(5), tied.orderBy(F.rand(3)))]
    assert got[0] == got[1] == got[2] == [(3, 0), (4, 3), (5, 7), (9, 12), (200_000, 21)]
    blank = M.mix(spark.createDataFrame([(1, None, None), (2, "b", " ")], shape)).collect()
    assert sorted(r.doc_id for r in blank) == [1, 2]
