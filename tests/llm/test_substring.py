import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import substring as S


def slow(rows, before=()):
    """rows: (id, text) in any order; before: documents of the log."""
    docs = [(0, i, (t or "").split()) for i, t in before] + [(1, i, (t or "").split()) for i, t in rows]
    first = {}
    for new, i, w in docs:
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, (9, 9)), (new, i))
    out = []
    for new, i, w in docs:
        if not new:
            continue
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < (1, i):
                gone.update(range(a, a + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}é"
    passages = [[word() for _ in range(k)] for k in (49, 50, 51, 80, 200)]
    texts = [None, "", " \n\t ", "one", "a " * 49, "a " * 50, "a " * 120, "a " * 700]
    while len(texts) < n:
        w = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(w))
            w[a:a] = p
        texts.append((" " if rng.random() < 0.5 else "\n").join(w))
        if rng.random() < 0.2:
            texts.append(texts[rng.randrange(len(texts))])
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_against_brute_force(spark, batches):
    rows = corpus(3)
    got = S.dedup_table(frame(spark, rows), batches).collect()
    assert sorted(map(tuple, got)) == slow(rows)


def folders(path):
    return sorted(x for x in os.listdir(path.removeprefix("file:")) if x != "manifest")


def test_log_reopens_and_compacts(spark):
    rows = corpus(4, 90)
    path = S.scratch_path(spark, "log")
    done = []
    for lo in (60, 45, 30, 15, 0):  # later batches have smaller ids: the log still comes first
        part = [r for r in rows if lo <= r[0] < lo + 15]
        log = S.FingerprintLog(spark, path, buckets=3 if lo == 60 else 7, most_runs=2, unique_keys=lo == 30)
        assert log.live.buckets == 3
        got = S.dedup_batch(log, frame(spark, part)).collect()
        assert sorted(map(tuple, got)) == slow(part, done)
        log.compact()
        assert folders(path) == sorted(log.live.runs + log.live.texts)
        log.close()
        done += part
    assert log.live.version == 7 and len(log.live.runs) == len(log.live.texts) == 1
    other = spark.newSession()
    assert S.FingerprintLog(other, path).live == log.live


def test_history_is_merged_without_a_shuffle(spark):
    """The batch side alone is exchanged, and a passage of many documents is in the history once."""
    words = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{words} own{i}") for i in range(40)]
    log = S.FingerprintLog(spark)
    S.dedup_batch(log, frame(spark, rows)).collect()
    run = log.read(log.live.runs[0])
    assert run.groupBy("fp").count().where("count > 1").count() <= 3
    # Names the exchanges of a join of a batch with the run.
    batch = frame(spark, rows).select(F.xxhash64("doc_id").alias("fp")).groupBy("fp").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = batch.join(run, "fp")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1
    merged = log.read(log.live.runs[0]).unionByName(log.read(log.live.runs[0])).groupBy("fp").count()
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    log.close()


def test_repeats_nulls_and_empty(spark):
    t = " ".join(f"x{i}" for i in range(60))
    rows = [(5, t), (5, t), (None, t), (2, "y " + t), (7, t)]
    got = sorted(map(tuple, S.dedup_table(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 61, 0, "y " + t), (5, 60, 60, ""), (5, 60, 60, ""), (7, 60, 60, ""), (None, 60, 0, t)], key=str)
    assert S.dedup_table(frame(spark, rows[:0])).collect() == []
    # Different texts under one id, met only in a later batch, and a very long text.
    long = " ".join(f"z{i % 70_001}" for i in range(300_000))
    rows = [(1, "q " * 60), (2, t), (90, "a b " + t + " c"), (90, "other " * 3), (91, long), (92, "first " + long)]
    got = sorted(map(tuple, S.dedup_table(frame(spark, rows), 3).collect()))
    assert got == slow(rows)


def test_sha_is_of_the_kept_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
