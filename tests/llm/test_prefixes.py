import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scanloom.llm import prefixes as P
from scanloom.llm.runs import scan

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    rebuilt = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + v[h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        own = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in own) or 1
        saved[k] = sum(saved[x] for x in own) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng, rows = random.Random(5), []
    for c in [*range(-210, -190), *range(40), *range(200, 260), *range(301, 330)]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["a", "b", None]), rng.choice(["x", "y", None, "Zwölf 日"])))
    rows += [(7, None, "a", "zz"), (None, 1, "a", "b"), (8, 3, "q", "twice"), (8, 3, "q", "twice")]
    rows += [(500 + k, t, "u", f"long {t}") for k in range(30) for t in range(20)]  # whole copies
    rows += [(11, t, "r", str(t)) for t in range(1500)]  # a third of all turns
    rows += [(601, 0, "u", "very long " * 20_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [P.MOST_BITS, 6])
def test_against_brute_force(spark, bits):
    """A sketch of 64 counters a row takes nearly every prefix for shared; the nodes stay the same."""
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("at", "depth", "len", "p1", "n")})
    got = [tuple(r) for r in P.shared_trie(df, bits).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_lists_longer_than_a_piece(spark, monkeypatch):
    rows = [(c, 0, "u", "same") for c in range(900, 1000)]
    monkeypatch.setattr(P, "CHUNK", 7)
    got = [tuple(r) for r in P.shared_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_the_sketch_proves_singletons(spark):
    n = 4000
    df = spark.range(n).select("id", F.xxhash64("id").alias("p1"), F.xxhash64("id", "id").alias("p2"), F.lit(1).cast("long").alias("depth"))
    df = df.unionByName(df.where("id < 100")).withColumns({"q1": F.col("p1"), "q2": F.col("p2")})
    rows = P.screened(df, n + 100).groupBy("id").agg(F.count("*").alias("n"), F.max("lone").alias("lone")).collect()
    assert not any(r.lone for r in rows if r.n > 1)
    assert sum(r.lone for r in rows if r.n == 1) > 0.99 * (n - 100)


def test_empty(spark):
    assert P.shared_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scan_over_many_partitions(spark):
    """One group that lies in nearly all partitions beside groups of one row."""
    rows = [("hot", i, i * 77) for i in range(5000)] + [(f"g{i}", 0, i) for i in range(50)] + [("z", i, 5) for i in range(3)]
    got = scan(spark.createDataFrame(rows, "g string, o long, v long").repartition(5), "g", ["o"], ["v"]).collect()
    xor, at = {}, {}
    for g, o, v in sorted(rows):
        at[g, o] = sum(1 for x in rows if x[0] == g and x[1] < o) if g != "hot" else o
        xor[g] = xor.get(g, 0) ^ v
        at[g, o] = (at[g, o], xor[g])
    assert len(got) == len(rows) and all((r["at"], r.v_run) == at[r.g, r.o] for r in got)
