import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from scanloom.llm import quality as Q
from scanloom.llm import toxicity as T

SF = {"quality": "/root/testdata/sf0.01", "toxic": "/root/testdata/sf0.1"}


def slow_stats(text):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return (0.0,) * len(Q.STATS)
    size = sum(len(x.encode()) for x in w)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for k in range(3)}
    share = lambda cs: sum(text.count(c) for c in cs) / size
    return (len(w), size / len(w), share("#*$%&|<>"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), text.count("!") / len(w), text.count("|") / len(w), share("0123456789"), 1 - len(set(lines)) / len(lines), len(hit) / len(w), len(set(w)) / len(w), max(Counter(w).values()) / len(w), len(w) / len(lines), text.count(".") / len(w))


def test_statistics(spark):
    texts = [None, "", " \n", "One word!", "a b c a b c\na b c", "É#1|2 XX\n\nÉ#1|2 XX\n" * 40, "x " * 9000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, symbols int")
    for r in Q.statistics(df).collect():
        assert np.allclose(tuple(r)[1:], slow_stats(texts[r.doc_id]))


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(Q.STATS))).round(2)
    y = ((x[:, 2] < 0.3) & (x[:, 5] > 0.4) | (x[:, 7] > 0.9)).astype(float)
    m = Q.RuleEnsemble.fit(x, y)
    z = m.intercept + sum(w * Q.holds(x, r) for r, w in zip(m.rules, m.weights, strict=True))
    p = 1 / (1 + np.exp(-z))
    assert ((p > 0.5) == y).mean() > 0.97 and len(m.rules) < 200
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:200])], "i int, " + ", ".join(f"{s} double" for s in Q.STATS))
    got = np.array([r[0] for r in df.orderBy("i").select(m.column()).collect()])
    assert np.allclose(got, p[:200])


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out(spark, name):
    docs, labels = spark.read.parquet(f"{SF[name]}/documents.parquet"), spark.read.parquet(f"{SF[name]}/labels.parquet")
    module = Q if name == "quality" else T
    got = module.score(docs, module.fit(docs, labels)).cache()
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").toPandas()
    assert all(rows.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in rows.doc_id])
    out = rows[rows.held_out]
    assert rows.score.between(0, 1).all() and auc(out.score.to_numpy(), out[name].to_numpy()) > 0.95
    assert (rows.predicted == (rows.score >= (0.7 if name == "quality" else 0.3))).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 5), (3, "", 5), (4, "x" * 100_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, 2, 0)], "doc_id long, quality int, toxic int")
    for module in (Q, T):
        for lab in (labels, labels.limit(0)):
            rows = module.score(docs, module.fit(docs, lab)).collect()
            assert len(rows) == 5 and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).collect() == []


def brute(channel, marks):
    """The best path over all ways to read the marks."""
    best = (-math.inf, "")

    def go(i, run, word, s):
        nonlocal best
        a, b = ([0, 0] + [T.CODE[c] for c in word])[-2:]
        if i == len(marks):
            best = max(best, (s + channel.logp[a, b, 0], word))
            return
        c = marks[i]
        run = run + 1 if i and marks[i - 1] == c else 1
        for x, cost in [(c, 0.0)] if c in T.CODE else [(x, T.SWAP) for x in T.STANDS_FOR.get(c, "")]:
            go(i + 1, run, word + x, s + cost + channel.logp[a, b, T.CODE[x]])
        skip = T.STRETCH if run > 1 and c in T.CODE else T.STRAY if c not in T.CODE else None
        if skip is not None and (run == 1 or word):
            go(i + 1, run, word, s + skip)

    go(0, 0, "", 0.0)
    return best[1]


def test_restores_obfuscation(spark):
    clean = "you are an idiot and a moron so stupid they said that loser is trash the scum of this place and all the rest is fine " * 30
    df = spark.createDataFrame([(1, clean), (2, None)], "doc_id long, text string")
    counts = T.trigrams(df)
    assert counts.sum() == sum(counts.ravel()) and counts[T.CODE["i"], T.CODE["d"], T.CODE["i"]] == 30
    channel = T.Channel(T.language_model(counts))
    for odd, plain in {"1d10t": "idiot", "m0r0n": "moron", "st*pid": "stupid", "$tup1d": "stupid", "l0s3r!!": "loser", "traaaaash": "trash", "s.c.u.m": "scum", "idiot###": "idiot", "Moron,": "moron", "2024": "", "all": "all"}.items():
        assert channel.word(odd) == plain, odd
    assert "scum" in channel.words("what s c u m.") and "idiot" in channel.words("an i-d-i-o-t he is")
    for marks in ("1d10t", "s.c.u.m", "$tup1d", "traaash", "l0$3r", "*ll"):
        assert channel.decode(marks) == brute(channel, marks)
    odd = spark.createDataFrame([(1, "an 1d10t, a m0r0n"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in T.restore(odd, channel.logp).collect()} == {1: "an idiot a moron", 2: ""}


def test_words_end_at_marks_gaps_and_missing_spaces(spark):
    clean = "you are an idiot and a moron so stupid they said that fool and the rest is fine shut up all of you "
    rows = spark.createDataFrame([(i, clean) for i in range(30)], "doc_id long, text string")
    channel = T.Channel(T.language_model(T.trigrams(rows)), T.vocabulary(rows))
    for odd, plain in {
        "an-idiot": "an idiot", "fool,stupid": "fool stupid", "shut/stupid": "shut stupid", "l'idiot": "l idiot", "f00l/1d10t": "fool idiot",
        "you are a s t u p i d fool": "you are a stupid fool", "y o u i d i o t": "you idiot", "i-d-i-o-t": "idiot",
        "youareanidiot": "you are an idiot", "youidiotyoumoron": "you idiot you moron", "fine-" * 40 + "m0r0n": "fine " * 40 + "moron",
    }.items():
        assert " ".join(channel.words(odd)) == plain, odd
    weights = {"idi": 1.0, "idiot$": 3.0, "mor": 2.0, "so$": 0.5}
    model = T.Model(channel.logp, weights, np.zeros(T.DIMS), channel.vocabulary)
    quick = T.Channel(channel.logp, channel.vocabulary, model.hot())
    found = lambda c, text: sorted(x for w in c.words(text) if (x := model.weigh(w)))
    for text in ("youidiot youareamoron", "y o u m o r o n", "so,sofine an-idiot", clean.replace(" ", "")):
        assert found(quick, text) == found(channel, text) and found(quick, text)


EDGE = re.compile(r"^(?:[.,;:?\"'()\[\]{}<>~`=/\\-]|([%&#*$@!|+])\1+)+|(?:[.,;:?!\"'()\[\]{}<>~`=/\\%&#*|+-]|([$@])\2\2+)+$")


def test_marks_around_tokens_against_the_pattern():
    rng = random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.,$$$@@!!#%*|+-(") for _ in range(rng.randint(0, 9)))
        assert T.bare(t) == EDGE.sub("", t), t


@pytest.mark.parametrize("token", ["a" + "." * 300_000 + "a", "." * 300_000, "$a" * 150_000, "a" + "$" * 300_000 + "b", "x-" * 100_000])
def test_very_long_tokens_take_time_in_proportion(token):
    began = time.process_time()
    T.bare(token)
    T.Channel(np.full((T.SIZE,) * 3, -3.0, np.float32), {"a": -1.0}).word(token[:20_000])
    assert T.units(f"{token} z") == [token, "z"] and time.process_time() - began < 10


def test_texts_that_share_an_id_fit_alike(spark):
    rows = [(i % 60, f"word{i % 7} quiet " * 30 + ("stupid" if i % 2 else "kind")) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    a = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    x, y = (T.fit(d, labels) for d in (a, b))
    assert x.weights == y.weights and np.allclose(x.layer, y.layer)
    x, y = (Q.fit(d, labels) for d in (a, b))
    assert (x.intercept, x.rules, x.weights) == (y.intercept, y.rules, y.weights)


def test_toxicity_learns_from_all_training_rows(spark, monkeypatch):
    n = 28_000
    docs = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, 'common odd', 'common even') AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS toxic")
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    odd = sum(i % 3 == 0 for i in train)
    assert len(train) > 20_000
    model = T.fit(docs, labels)
    assert math.isclose(math.exp(model.vocabulary["odd"]), odd / (2 * len(train)))
    assert math.isclose(model.weights["odd$"], math.log((odd + 0.5) / (odd + 1) / (0.5 / (len(train) - odd + 1))))
    monkeypatch.setattr(T, "BLOCK_ROWS", 3_000)
    assert np.allclose(T.fit(docs, labels).layer, model.layer)


def test_features_counted_in_two_steps_are_those_of_all_words(spark):
    path = SF["quality"]
    docs = spark.read.parquet(f"{path}/documents.parquet").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    rows = docs.selectExpr("text", "CAST(toxic AS double) AS y", "CAST(doc_id % 2 AS int) AS half").where("y in (0, 1)").cache()
    got = rows.toPandas()
    n = [[int(((got.half == h) & (got.y == y)).sum()) for y in (0, 1)] for h in (0, 1)]
    logp, known = T.language_model(T.trigrams(rows)), T.vocabulary(rows)
    channel = T.Channel(logp, known)
    count = {}
    for t, y, half in zip(got.text, got.y, got.half, strict=True):
        for f in {f for w in set(channel.words(t or "")) for f in T._features(w)}:
            count.setdefault(f, [0, 0, 0, 0])[2 * half + int(y)] += 1
    brute = spark.createDataFrame([(f, *c) for f, c in count.items()], "f string, c0 long, t0 long, c1 long, t1 long")
    found = T.feature_counts(rows, n, logp, known)
    assert {(r.f, r.c0, r.t0, r.c1, r.t1) for r in found.collect()} <= {(f, *c) for f, c in count.items()}
    for c, t, clean, toxic in (("c0", "t0", *n[0]), ("c1", "t1", *n[1]), ("c0 + c1", "t0 + t1", n[0][0] + n[1][0], n[0][1] + n[1][1])):
        whole, two = (T.lexicon(d.selectExpr("f", f"{c} AS c", f"{t} AS t"), clean, toxic) for d in (brute, found))
        assert whole == two and (whole or toxic < 20)
