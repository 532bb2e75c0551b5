"""Quality rules: a bitmask ledger.

Each text is measured once and each rule evaluated once; the ledger holds the
measurements and one failure bit per rule. Policies are versioned masks over
those bits, so keeping, re-judging under another version and ablations are bitwise
work on a long and never read a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS, tidy

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

#: Rule name and its failure condition, in the order of their bits. Integers only,
#: so every engine gives the same verdict.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "100 * n_bangs > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
#: Policy versions: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(n for n, _ in RULES),
}


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    top = int(ids.max()) + 1
    pair = a * top + b
    if top > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair * top + c, return_inverse=True, return_counts=True)
    hit = count[which] > 1
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + n] |= hit
    return int(cover.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    chars = len(joined.decode("utf-8", "replace"))
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        len(joined) - len(joined.translate(None, UPPER)),
        text.count(b"!"),
    )


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and MEASURES of every row; null texts have no words, a very long text costs its length."""
    return _measured(docs.select(F.col(key), F.col(text)), text, [key])


def _measured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of docs and MEASURES, in one pass."""
    kinds, names = dict(docs.dtypes), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(lo, TEXT_ROWS)
                found = [measure(t or b"") for t in part.column(names.index(text)).cast(pa.binary()).to_pylist()]
                cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                held = [part.column(names.index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*held, *cols], names=[*(f"c{i}" for i in range(len(carry))), *MEASURES])

    shape = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), *(f"{m} long" for m in MEASURES)])
    return docs.mapInArrow(tidy(run), shape).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def mask(rules: tuple[str, ...]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _bits() -> Column:
    """One bit for each rule that fails, from the measurements."""
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, MEASURES and ``fail_bits``: one row per row of docs, repeated rows
    included; an empty table gives an empty ledger and other columns are ignored."""
    return measurements(docs, key, text).withColumn("fail_bits", _bits())


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of docs that a policy and the base rules keep, as they are: measured and judged where
    they lie, without a shuffle. No row is told by its key, so null and repeated keys are no matter."""
    own = docs.columns
    plain = docs.toDF(*(f"d{i}" for i in range(len(own))))
    found = _measured(plain, f"d{own.index(text)}", plain.columns).withColumn("fail_bits", _bits())
    return found.where(~(fails("base") | fails(policy))).select(*plain.columns).toDF(*own)


def fails(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def judge(found: DataFrame, policy: str = "v2") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy; what fails the base rules is never kept."""
    return found.withColumn("base_failed", fails("base")).withColumn("kept", ~(fails("base") | fails(policy)))


def ablations(found: DataFrame) -> DataFrame:
    """``policy, rule, failed, failed_alone, kept_without``: per policy and rule, how many rows
    fail it, fail nothing else of the policy, and would be kept if it were dropped.

    Rows are first counted by fail_bits (2 ** rules values at most, map side), so the
    rest works on that small table.
    """
    by_bits = found.groupBy("fail_bits").agg(F.count("*").alias("rows"))
    parts = []
    for policy, rules in POLICIES.items():
        whole = F.lit(mask(rules)).cast("long")
        for rule in rules:
            own = F.lit(mask((rule,))).cast("long")
            bits = F.col("fail_bits").bitwiseAND(whole)
            parts.append(F.struct(F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), (bits.bitwiseAND(own) != 0).alias("hit"), (bits == own).alias("alone"), (bits.bitwiseAND(F.bitwise_not(own)) == 0).alias("without")))
    rows = by_bits.select("rows", F.explode(F.array(*parts)).alias("p")).select("rows", "p.*")
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("rows"))), F.lit(0))
    return rows.groupBy("policy", "rule").agg(n("hit").alias("failed"), n("alone").alias("failed_alone"), n("without").alias("kept_without"))
