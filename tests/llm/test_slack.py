import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanloom.llm import slack as S
from scanloom.llm.packing import Shelf

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(lengths, windows, rest):
    found = {}
    for own in [*windows, rest]:
        for row, at, n in own:
            found.setdefault(row, []).append((at, n))
    assert len(found) == len(lengths)
    for row, own in found.items():
        at = 0
        for a, n in sorted(own):
            assert a == at and n > 0
            at += n
        assert at == lengths[row]


@pytest.mark.parametrize("seed", range(30))
def test_closest_against_all_subsets(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(3, 40) for _ in range(9)]
    room = rng.randint(10, 120)
    best = max(sum(c) for k in range(10) for c in combinations(lengths, k) if sum(c) <= room)
    shelf = Shelf(np.array(lengths), 128)
    found = S.closest(shelf, room)
    assert sum(n * k for n, k in found) == best
    assert all(0 < k <= lengths.count(n) for n, k in found) and len({n for n, _ in found}) == len(found)


@pytest.mark.parametrize("lengths", [np.minimum(np.random.default_rng(1).lognormal(6, 1, 4000).astype(int) + 1, 2048), np.full(900, 1500), np.ones(7000, int), np.full(40, 2048), np.array([1]), np.array([2048, 2047])])
@pytest.mark.parametrize("last", [True, False])
def test_windows_are_full(lengths, last):
    windows, rest = S.minimum_slack(lengths, 2048, last)
    whole(lengths, windows, rest)
    sums = [sum(p[2] for p in own) for own in windows]
    assert sum(s == 2048 for s in sums) == lengths.sum() // 2048
    assert all(s & (s - 1) == 0 for s in sums)
    assert sum(p[2] for p in rest) == (0 if last else lengths.sum() % 2048)


def test_few_documents_are_cut():
    lengths = np.minimum(np.random.default_rng(2).lognormal(6, 1, 10_000).astype(int) + 1, 2048)
    windows, rest = S.minimum_slack(lengths)
    assert sum(map(len, windows)) - len(lengths) < 20


@pytest.mark.parametrize("group", [S.GROUP, 12])
def test_pack_tightly(spark, group):
    rng = random.Random(3)
    texts = [None, "", " \n", "Hello, World! it's", "naïve é", "word " * 9000, "<|endoftext|> x", "same", "same"]
    texts += [" ".join(rng.choice(["the", "cat's", "Ärger", "1999", "日本語"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "Hello, World! it's"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "skip", "length", "key", "start")})
    got = S.pack_tightly(df, PATH, group=group).collect()
    encode = Tokenizer.from_file(PATH)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(encode.encode(t or "", add_special_tokens=False).ids + [1])
    places, have = {}, {}
    for r in got:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        have.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, own in have.items():
        assert sum(n for _, n in own) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for a, n in sorted(own):
                assert a == at
                at += n
    for own in places.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at & (at - 1) == 0 and at <= 2048
    assert sum(sum(n for _, n in p) == 2048 for p in places.values()) == sum(len(x) for v in ids.values() for x in v) // 2048


def test_empty(spark):
    assert S.pack_tightly(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
