import hashlib
import zlib

from pyspark.sql import functions as F

from scanloom.llm import manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = {c: c + 32 for c in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        b = i // 16 * 16
        out.append((level[b:i], level[i + 1 : b + 16]))
        i //= 16
    return out


def slow(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way = path(trees[s], i) + path(top, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(LOW)
            h = leaf(r[0], text, *r[2:])
            for a, b in way:
                h = H(*a, h, *b)
            out.append((r[0], leaf(*r), trees[s][-1][0], root, H(*(x for a, b in way for x in a + b)), h, h == root))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    made = M.manifest(docs, now={"text": M.lower_fifth()})
    got = [tuple(r) for r in M.verified(made).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)
    return made


def test_against_brute_force(spark):
    # A source of 400 leaves, exact powers, lone leaves, a null source, nulls everywhere, repeated rows and ids.
    rows = [(i, f"Text {i} É", "en", "big", i) for i in range(400)]
    rows += [(1000 + i, "AB", None, f"s{i:02d}", None) for i in range(20)] + [(2000 + i, None, "de", "s16", 3) for i in range(16)] + [(3000 + i, "Xx", "de", "t17", 3) for i in range(17)]
    rows += [(None, "N", "en", None, 1), (None, None, None, None, None), (5, "", "en", None, 0), (5, "Again", "en", "big", 7), (5, "Again", "en", "big", 7), (10, "Word " * 30_000, "en", "", 5), (15, "日本 ÄB", "fr", "é", 2), (-20, "ABC", "fr", "é", 2)]
    made = check(spark, rows)
    nodes = {(r.grp, r.level, r.lo): r for r in made.groups.nodes().collect()}
    for (grp, level, lo), r in nodes.items():  # intervals are nested, and only a group's root has no parent
        if r.parent_lo is None:
            assert lo == 0 and (grp, level + 1, 0) not in nodes
        else:
            up = nodes[grp, level + 1, r.parent_lo]
            assert up.lo <= r.lo < r.hi <= up.hi == r.parent_hi


def test_one_leaf_and_one_source(spark):
    check(spark, [(10, "Lone", "en", None, 4)])
    check(spark, [(i, "A", "en", "s", 1) for i in range(17)])


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    made = M.manifest(docs)
    assert made.root is None and M.verified(made).collect() == []
    rows = [(i, "Some", "en", "s", 4) for i in range(20)]
    clash = spark.createDataFrame(rows, SCHEMA)
    for c in ("grp", "at", "digest", "item", "key", "now", "level", "lo", "path", "root"):
        clash = clash.withColumn(c, F.lit("x"))
    got = M.verified(M.manifest(clash)).collect()
    assert len(got) == 20 and all(r.verified for r in got)
