import random
import re

from pyspark.sql import functions as F

from scanloom.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, x in enumerate(tri):
        if tri.count(x) > 1:
            hit.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines), len(re.findall("[A-Z]", t)), t.count("!"))


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t\n", "One", "a b c a b c", "x " * 9, "É ü\x0bß\x0c|#\r\nÉ ü", "same line\nsame line\n same line\nsame line", "é" * 3000]
    for _ in range(40):
        w = [rng.choice(["aa", "B!", "c#", "dé", "x\n", "\n"]) for _ in range(rng.randint(0, 90))]
        out.append(" ".join(w))
    return out


def test_measures_against_brute_force(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r[0]: tuple(r)[1:] for r in R.measurements(df).collect()}
    assert got == {i: slow(t) for i, t, _ in rows}


def test_ledger_policies_and_ablations(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(1, ""), (None, "word " * 60)]
    found = R.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    led = found.collect()
    assert len(led) == len(rows)
    judged = R.judge(found).collect()
    for r in judged:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not base or not r.kept)
        assert r.kept == (r.fail_bits == 0)
    for a in R.ablations(found).collect():
        m, own = R.mask(R.POLICIES[a.policy]), R.mask((a.rule,))
        assert a.failed == sum(bool(r.fail_bits & own) for r in led)
        assert a.failed_alone == sum(r.fail_bits & m == own for r in led)
        assert a.kept_without == sum(r.fail_bits & m & ~own == 0 for r in led)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.judge(R.ledger(df)).count() == 0
    assert {r.failed for r in R.ablations(R.ledger(df)).collect()} <= {0}


def test_keep_carries_all_columns(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "a"), (1, good, "a"), (None, good, "b"), (2, None, "c"), (3, "x " * 90, "d"), (4, good + " " + "y" * 1000, None), (5, " ".join(f"v{i}" for i in range(400_000)), "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("fail_bits", F.lit("z"))
    got = R.keep(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, str(r.n_words)) for r in got.collect()) == sorted((str(a), b, str(c)) for a, b, c in rows if a not in (2, 3))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert R.keep(df.limit(0)).collect() == []
