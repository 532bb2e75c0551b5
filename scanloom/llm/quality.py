"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on a bounded labelled sample;
every path from a root becomes a conjunctive rule, a lasso logistic fit keeps few
of them, and those compile to one Spark column expression. Scoring is the
statistics of each text plus that expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS
from scanloom.llm.rules import SYMBOLS, UPPER, repeat_words

#: Labelled rows that the model is fitted on at most, the first by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
#: Weight of the lasso penalty per rule.
PENALTY = 0.002
STATS = ("n_words", "word_length", "symbols", "capitals", "bangs", "pipes", "digits", "repeated_lines", "repeated_words", "distinct", "top_word", "line_words", "stops")


def stats_of(text: bytes) -> tuple[float, ...]:
    """STATS of one text; shares of nothing are 0."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    joined = b"".join(words)
    size = len(joined)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    less = lambda chars: (size - len(joined.translate(None, chars))) / size
    return (
        float(n),
        size / n,
        less(SYMBOLS),
        less(UPPER),
        text.count(b"!") / n,
        text.count(b"|") / n,
        less(b"0123456789"),
        1 - len(set(lines)) / len(lines),
        repeat_words(ids) / n,
        len(seen) / n,
        float(np.bincount(ids).max()) / n,
        n / len(lines),
        text.count(b".") / n,
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``key, STATS`` of every row (and the columns ``extra`` as they are); null texts have no words."""
    kinds = dict(docs.dtypes)
    keep = (key, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                found = [stats_of(t or b"") for t in part.column(len(keep)).cast(pa.binary()).to_pylist()]
                cols = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + cols, names=[f"k{i}" for i in range(len(keep))] + list(STATS))

    shape = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keep)) + ", " + ", ".join(f"{s} double" for s in STATS)
    rows = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text)).mapInArrow(run, shape)
    return rows.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


Rule = tuple[tuple[int, bool, float], ...]


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds half way to the next value above each quantile, of all values and of those above the least."""
    own = np.unique(values)
    marks = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, BINS + 1)[:-1]) for v in (values, values[values > own[0]]) if len(v)]))
    at = np.searchsorted(own, marks, side="right")
    at = np.unique(at[(at > 0) & (at < len(own))])
    return (own[at - 1] + own[at]) / 2


def grow(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """Paths of boosted trees: conditions (statistic, above, threshold)."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    cuts = [_cuts(x[:, j]) for j in range(m)]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    score = np.full(n, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, depth: int, out: np.ndarray) -> None:
        best = (1e-6, -1, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth < DEPTH and len(rows) >= 40:
            for j in features:
                if not len(cuts[j]):
                    continue
                cg = np.cumsum(np.bincount(bins[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                ch = np.cumsum(np.bincount(bins[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] < 0:
            out[rows] += RATE * total_g / (total_h + 1)
            return
        _, j, k = best
        low = bins[rows, j] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            step = (*path, (j, above, float(cuts[j][k])))
            rules.setdefault(tuple(sorted(step)))
            split(part, g, h, step, depth + 1, out)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        own = rng.random(n) < 0.6
        features = rng.choice(m, max(2, m // 2), replace=False)
        step = np.zeros(n)
        keep = np.where(own)[0]
        split(keep, y - p, p * (1 - p), (), 0, step)
        score += step  # rows outside the subsample stay where they are
    return list(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1 logistic fit, by accelerated proximal steps."""
    n, m = z.shape
    w, v, b, vb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    norm = np.ones(m)
    for _ in range(15):
        norm = z.T @ (z @ norm)
        size = np.linalg.norm(norm)
        if size == 0:
            break
        norm /= size
    rate = 4 * n / (size + n + 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        r = (p - y) / n
        new = v - rate * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * r.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return b, w


@dataclass
class RuleEnsemble:
    """Weighted rules; ``column()`` is the probability of label 1."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))))
        rules = grow(x, y)
        if not rules:
            p = y.mean()
            return cls(float(np.log(p / (1 - p))))
        z = np.column_stack([holds(x, r) for r in rules]).astype(np.float32)
        b, w = lasso(z, y)
        kept = np.flatnonzero(np.abs(w) > 1e-4)
        return cls(float(b), [rules[k] for k in kept], [float(w[k]) for k in kept])

    def column(self, names: tuple[str, ...] = STATS) -> Column:
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for j, above, t in rule:
                met &= F.col(names[j]) > F.lit(t) if above else F.col(names[j]) <= F.lit(t)
            z = z + F.when(met, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id counts as no text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(4)) == 2


def labelled(labels: DataFrame, label: str, key: str = "doc_id", sample: int | None = SAMPLE) -> DataFrame:
    """At most ``sample`` training rows ``key, y`` (None: all of them): known labels outside the held-out fold, one for each id."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    return rows if sample is None else rows.orderBy(F.xxhash64(key), key).limit(sample)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from the texts of the bounded sample alone."""
    # The sample is at most ``sample`` ids, so its broadcast has a known bound.
    rows = docs.select(key, text).join(F.broadcast(labelled(labels, label, key, sample)), key)
    # Of texts that share an id the one with the least statistics, in every run.
    one = F.min(F.struct(*STATS, "y")).alias("d")
    got = statistics(rows, key, text, ("y",)).groupBy(key).agg(one).select(key, "d.*").orderBy(key).toPandas()
    return RuleEnsemble.fit(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``key, held_out, score, predicted`` of every row; null and blank texts are scored by
    their (zero) statistics, repeated rows alike, other columns ignored; texts of any length are read whole."""
    found = statistics(docs, key, text).select(F.col(key), held_out(key).alias("held_out"), model.column().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
