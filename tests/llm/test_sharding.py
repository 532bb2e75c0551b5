import hashlib
from collections import Counter

import pytest

from scanloom.llm import sharding as S


def slow(shards, m):
    h = lambda n, s: int(hashlib.md5(f"{s}|{n}".encode()).hexdigest()[:15], 16)
    walks = [[(h(s, "offset") % m + j * (h(s, "skip") % (m - 1) + 1)) % m for j in range(m)] for s in shards]
    table, nxt, n = [None] * m, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while table[walks[i][nxt[i]]] is not None:
                nxt[i] += 1
            table[walks[i][nxt[i]]] = i
            n += 1
            if n == m:
                return table


def test_table_against_brute_force():
    shards = [f"s{i}" for i in range(7)]
    assert S.fill(shards, 1009) == slow(shards, 1009)
    n = Counter(S.fill(shards, 1009))
    assert max(n.values()) - min(n.values()) <= 1


def test_few_slots_move_and_weights():
    shards = [f"s{i}" for i in range(10)]
    a, b = S.fill(shards, 10007), S.fill(shards[:-1], 10007)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.25 * 10007
    n = Counter(S.fill(["a", "b"], 10007, {"a": 3}))
    assert abs(n[0] / n[1] - 3) < 0.01
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            S.fill(bad, 1009)
    with pytest.raises(ValueError):
        S.fill(["a"], 1000)
    with pytest.raises(ValueError, match="1500 slots"):  # 19 of 30 shards would get none of 11
        S.fill([f"s{i}" for i in range(30)], 11)


def test_place(spark):
    rows = [(i, "t", "old") for i in range(300)] + [(None, None, None), (5, "t", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards = [f"s{i}" for i in range(4)]
    table = S.fill(shards, 1009)
    got = S.place(df, shards, 1009).collect()
    assert len(got) == len(rows)
    for r in got:
        k = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.shard_slot, r.shard) == (k, shards[table[k]])
    assert S.place(df.limit(0), shards, 1009).count() == 0


def test_write(spark, tmp_path):
    df = spark.range(100).toDF("doc_id")
    S.write_shards(S.place(df, ["a", "b"], 101), f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 100
