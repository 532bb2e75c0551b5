import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as C
from scanloom.llm import mixing, rules


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    rows, base = [], None
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(40):
        t = " ".join(rng.choice(words) for _ in range(200))
        if i % 5 == 1:
            t = base
        base = t
        if i % 7 == 3:
            t = f"{t}\n{passage}"
        rows.append((i, t, "en", f"s{0 if i < 20 else i % 4}", len(t)))
    rows += [(90, None, "en", None, None), (91, "", "en", "s1", 0), (92, "few words", "en", "s1", 9), (93, "x### " * 80, "en", "s1", 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = df, {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == df.columns
    judged = {r.doc_id: r.kept for r in rules.judge(rules.ledger(df)).collect()}
    assert {r.doc_id for r in seen["quality_rules"]} == {k for k, v in judged.items() if v} == set(range(40))
    ids = {r.doc_id for r in seen["near_duplicates"]}
    assert ids.isdisjoint({i for i in range(40) if i % 5 == 1 and i % 7 != 3 and (i - 1) % 7 != 3}) and {0, 2, 4} <= ids
    texts = {r[0]: r[1] for r in rows}
    for r in seen["substring_dedup"]:
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text) < len(texts[r.doc_id])
    assert sum(passage.split()[5] in r.text and passage in " ".join(r.text.split()) for r in seen["substring_dedup"]) == 1
    assert {r.doc_id for r in seen["mix_sources"]} == {r.doc_id for r in seen["substring_dedup"]}
    a = mixing.exponent(mixing.source_sizes(mixing.token_counts(spark.read.parquet(f"{tmp_path}/substring_dedup"))))
    assert 0 <= a <= 1
    assert sum(r.length for r in seen["pack"] if r.piece == 0) > 0
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["mix_sources"]}
    assert public_tokenizers.path("word_bpe_49k.json")
    whole = C.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, seen["pack"]))


def test_odd_tables(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"w{i}" for i in range(90))
    other = " ".join(f"v{i}" for i in range(70))
    rows = [(1, good, None, None, 5), (1, good, None, None, 5), (2, f"{other} {good}", "en", "s", None), (None, other, "en", "s", 1), (3, None, None, None, None), (4, " ", "en", "s", 1)]
    extra = {c: F.lit("x") for c in ("n_words", "kept_text", "times", "turn", "fp", "key", "component_id", "start", "kept", "n_tokens", "block", "epoch", "piece")}
    for docs in (spark.createDataFrame(rows, shape).withColumns(extra), spark.createDataFrame([], shape)):
        for k, (_, stage) in enumerate(C.STAGES):
            docs = stage(spark, docs, "").withColumns(extra if k < 4 else {})
            docs.write.parquet(path := f"{tmp_path}/{k}-{docs.schema['doc_id'].nullable}-{len(list(tmp_path.iterdir()))}")
            docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.collect()}
        assert ids in ({1, 2}, set())
