import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanloom.llm import packing as P
from scanloom.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    t = [None, "", " \n", "Hello, World! it's", "naïve café é́", "<|endoftext|> x<|startoftext|>", "zero​width nbsp em \x1c sep", "ABC123 4 56", "word " * 5000, "ǅ İstanbul ΣΑΣ"]
    rng = random.Random(3)
    return t + [" ".join(rng.choice(["the", "cat's", "Ärger", "1999", "—", "日本語"]) for _ in range(rng.randint(1, 900))) for _ in range(40)]


def test_encoder_equals_library():
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        mine = Encoder.of(path, spaced)
        extra = ["a  b   c\n\n d\t\te \n", "  lead", "trail   ", "x  y", "a   b", "'s 't\n'll", "\x85 a", "a\x1c\x1db"]
        for t in texts() + extra:
            want = np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
            assert mine.encode([t or ""])[0] == want, (name, t)


def letters():
    return [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_letter_before_every_mark(name, spaced):
    whole, mine = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), spaced)
    texts = [f"{a}{c}{m}" for c in letters() for m in ".,;:!?#$%&*|" for a in ("", " x")] + [f"y{c}{m}{m}." for c in letters() for m in ".!|"]
    for t, got, want in zip(texts, mine.encode(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(want.ids, "<u4").tobytes(), t


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_fuzz_with_special_strings(name, spaced):
    whole, mine = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), spaced)
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<|", "İ", "ı", "!", "?!", "...", "'s", "'S", "a", "Zz", "é", "é", "ß", "ǅ", "日本", "1", "42", " ", "  ", "\n", "\t", "\x1c", "\xa0", "​", "\u3000", "ﬁ", "😀", "|", "*", "Don't", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for t, got, want in zip(texts, mine.encode(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(want.ids, "<u4").tobytes(), repr(t)


def test_pack_documents(spark):
    rows = [(i, t, 9) for i, t in enumerate(texts())] + [(3, "Hello, World! it's", 9), (None, "none", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = P.pack_documents(df, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for n, lo in enumerate(range(0, len(ids), 2048)):
            own = ids[lo : lo + 2048]
            want.append((i, n, lo, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r[3] for r in want) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 2048)
    bins = P.best_two_fit(lengths)
    assert sorted(x for b in bins for x in b) == sorted(lengths.tolist())
    assert max(map(sum, bins)) <= 2048
    assert len(bins) <= 1.002 * lengths.sum() / 2048 + 2


def test_the_exchange_is_used():
    # 60 takes 35 and leaves 5; 35 gives way to 25 and 15.
    bins = P.best_two_fit(np.array([60, 35, 25, 15]), 100)
    assert sorted(map(sorted, bins)) == [[15, 25, 60], [35]]


def test_sequences_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    packed = P.pack(P.pieces(df, PATH, with_ids=True))
    rows = P.sequences(packed).collect()
    assert len(rows) == 1 and len(rows[0].ids) == 4 * rows[0].length
    assert P.pack_documents(df.limit(0), PATH).count() == 0
    assert Path(PATH).exists()
