import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanloom.llm import planes as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype("<u4").tobytes() for n in (1, 70_000, 3, 200_001)] + [np.array([2**32 - 1], "<u4").tobytes()]
    f = B.PlaneFile(B.encode_file(pa.array(range(5)), docs, kind))
    assert b"".join(x.tobytes() for x in f.blocks()) == b"".join(docs)
    assert f.block(2).tobytes() == np.frombuffer(b"".join(docs), "<u4")[2 * B.BLOCK : 3 * B.BLOCK].tobytes()
    with pytest.raises(ValueError):
        B.PlaneFile(b"x" * 100)


def test_token_index(spark, tmp_path):
    texts = {7: None, 3: "", 12: "Hello  world\n\n x", 1: "a" * 5000, 40: "<|endoftext|>", 5: "nb  sp"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, file string")
    whole = Tokenizer.from_file(PATH)
    at, want = 0, []
    for k in sorted(texts):
        ids = np.array(whole.encode(texts[k] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = B.token_index(df, PATH, 2, f"file://{tmp_path}/t").collect()
    assert sorted(map(tuple, got)) == want
    small = B.write_token_files(df, f"file://{tmp_path}/s", PATH, 2, file_ids=5, partitions=2, kind="bit")
    assert small.count() >= 5
    rows = B.read_token_files("long", f"file://{tmp_path}/s", spark, with_ids=True).collect()
    assert sorted((r.key, r.n, zlib.crc32(r.ids)) for r in rows) == [(k, n, c) for k, _, n, c in want]


def test_empty_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted(B.token_index(df, PATH, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1] and [r.start for r in got] == [0, 2, 4]
    assert B.token_index(df.limit(0), PATH, 2).collect() == []


def test_rows_that_share_a_key_are_in_a_fixed_order(spark):
    rows = [(1, f"text {i} " * (i + 1)) for i in range(50)]
    a, b = (B.token_index(spark.createDataFrame(r, "doc_id long, text string").repartition(n), PATH, 2).collect() for r, n in ((rows, 5), (rows[::-1], 3)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_stores_by_hadoop_names():
    paths = ("s3a://b/x", "s3n://b/x", "s3://b/x", "dbfs:/x/y", "file:/tmp/x", "file:///tmp/x", "hdfs://n/x", "/tmp/x")
    assert [B.store_name(p) for p in paths] == ["s3://b/x"] * 3 + ["file:///dbfs/x/y"] + ["file:///tmp/x"] * 2 + ["hdfs://n/x", "/tmp/x"]
