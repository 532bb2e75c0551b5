import random

import numpy as np
import pytest
import xxhash

from scanloom.llm import simhash as S


def slow_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    label = dict(fps)
    comp = {k: k for k in label}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(label[a] ^ label[b]).count("1") <= 3 and comp[b] > comp[a]:
                    comp[b] = comp[a]
                    changed = True
    return comp


def test_keys_cover_all_radius_three():
    rng = random.Random(5)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        kx, _, sx = S.keys_of(np.array([x], np.uint64).view(np.int64))
        ky, _, sy = S.keys_of(np.array([y], np.uint64).view(np.int64))
        assert set(kx[sx == 0]) & set(ky[sy == 1])


def test_golay_is_perfect():
    g = S.Golay()
    x = np.random.default_rng(1).integers(0, 1 << 23, 20000)
    index, held = g.near(x)
    assert set(held.sum(axis=1)) <= {1, 6}
    assert (g.weight[1:] > 0).all()


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "Solo", "two Words", "É two"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 4)):
            edit = list(base)
            for _ in range(rng.randint(0, 2)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            texts.append(" ".join(edit))
    texts += [texts[10]] * 5 + ["x " * 30000]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    fps = {i: slow_fp(t) for i, t, _ in rows}
    comp = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []


@pytest.mark.parametrize("n", [1, 300])
def test_links_of_a_dense_ball(spark, n):
    rng = random.Random(n)
    fps = {0}
    while len(fps) < n:
        x = 0
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    df = spark.createDataFrame([(int(np.array([x], np.uint64).view(np.int64)[0]),) for x in fps], "fp long")
    links = S.fingerprint_links(df)
    parts = {r.node: r.component for r in S.connected_components(links).collect()}
    assert len(set(parts.values())) == (1 if n > 1 else 0) and len(parts) == (n if n > 1 else 0)
