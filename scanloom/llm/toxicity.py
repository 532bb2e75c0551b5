"""Toxicity: noisy-channel deobfuscation.

A character trigram model counts the whole corpus. Tokens and runs of letters set
apart become lattices of what each character may stand for (look-alike digits and
symbols, stretched letters). The Viterbi path under the trigram model and the
channel's costs restores the letters; a second one, under the shares of known words,
finds where words end: at a mark, at a gap between single letters, or between two
letters where a space is missing. Restored texts
are scored by word beginnings whose share of toxic documents is learned from the
training fold.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS, remembered
from scanloom.llm.quality import held_out, labelled
from scanloom.session import cut, kept

#: Letters of the character model; anything else is a word boundary (index 0).
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
SIZE = 64
#: What a character may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou", "%": "o", "&": "a", "^": "a", "<": "c"}
#: Log costs of the channel: a look-alike, a stray mark, a stretched letter.
SWAP, STRAY, STRETCH = -1.0, -2.5, -0.3
#: Log costs of white space inside a word set apart, of a missing space, and of a word that isn't known. A mark or white space read as a space is free.
GAP, MISSING, UNKNOWN = -0.5, -3.0, -4.0
#: Known words: at most so many, in so many training texts and in one of so many of them, of so many letters.
VOCABULARY, KNOWN_DOCS, KNOWN_SHARE, LONGEST = 50_000, 5, 4_000, 24
#: Training ids up to which they are broadcast to find their texts; more of them shuffle.
IDS_BROADCAST = 1_000_000
#: Training rows of one block of the logistic layer.
BLOCK_ROWS = 50_000
#: Beginnings of words that are features, by length, and how many of them are kept.
BEGIN = range(3, 10)
FEATURES = 4_000
#: A feature stands in so many toxic training texts, and in one of so many of them.
LEAST_DOCS, LEAST_SHARE = 5, 2_000
#: Counts that a task holds before it hands them on.
TALLY_ROWS = 200_000
WORDS_KEPT = 400_000
#: Longer tokens are restored each time they come.
TOKEN_KEPT = 64
#: Plain words of so many letters may be two words, the second with a beginning that is a feature.
JOINED = 1 + BEGIN.start
#: At least three single characters, or groups of them with marks between, with white space between.
SPACED = re.compile(r"(?<!\S)(?:\S(?:[._-]\S)*[.,;:_-]?\s+){2,}\S(?:[._-]\S)*[.,;:!?]*(?!\S)")
STRETCHED = re.compile(r"(.)\1\1")
#: Marks before a token, alone or at least two of a kind; marks after it, alone or at least three of a kind.
BEFORE, BEFORE_RUN = frozenset(".,;:?\"'()[]{}<>~`=/\\-"), frozenset("%&#*$@!|+")
AFTER, AFTER_RUN = frozenset(".,;:?!\"'()[]{}<>~`=/\\%&#*|+-"), frozenset("$@")
PLAIN = re.compile(f"[{LETTERS}]+")
LETTER, ODD = re.compile(f"[{LETTERS}]"), re.compile(f"[{re.escape(''.join(STANDS_FOR))}]")
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x10000, np.int64)
for _c, _k in CODE.items():
    _TABLE[ord(_c)] = _k
    if len(_c.upper()) == 1:
        _TABLE[ord(_c.upper())] = _k


def bare(token: str) -> str:
    """The token without the marks around it, walked from both ends: linear in its length, whatever is inside."""
    lo, hi = 0, len(token)
    while lo < hi:
        c, n = token[lo], 1
        if c in BEFORE_RUN:
            while lo + n < hi and token[lo + n] == c:
                n += 1
            if n < 2:
                break
        elif c not in BEFORE:
            break
        lo += n
    while lo < hi:
        c, n = token[hi - 1], 1
        if c in AFTER_RUN:
            while hi - n > lo and token[hi - n - 1] == c:
                n += 1
            if n < 3:
                break
        elif c not in AFTER:
            break
        hi -= n
    return token[lo:hi]


def trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of the whole table, (64, 64, 64): at most 262,144 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                joined = "  ".join(t or "" for t in whole.column(0).slice(at, TEXT_ROWS).to_pylist())
                x = np.frombuffer(f"  {joined}  ".encode("utf-32-le", "replace"), "<u4")
                x = _TABLE[np.where(x < 0x10000, x, 0)]
                total += np.bincount(x[:-2] * SIZE * SIZE + x[1:-1] * SIZE + x[2:], minlength=SIZE**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["code", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), each order smoothed by the one below."""
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 50 * one) / (two.sum(axis=1, keepdims=True) + 50)
    three = (counts + 20 * two[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return np.log(three).astype(np.float32)


def vocabulary(rows: DataFrame, text: str = "text") -> dict[str, float]:
    """Log shares of the words that enough of all the texts hold, the most frequent ones."""
    least = max(KNOWN_DOCS, rows.count() / KNOWN_SHARE)
    word = F.explode(F.array_distinct(F.split(F.lower(text), f"[^{LETTERS}]+"))).alias("w")
    n = rows.select(word).where(f"w != '' and length(w) <= {LONGEST}").groupBy("w").agg(F.count("*").alias("n"))
    got = n.where(f"n >= {least}").orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()
    total = sum(r["n"] for r in got)
    return {r["w"]: math.log(r["n"] / total) for r in got}


class Channel:
    """Restores tokens under a language model and known words (log shares), remembering tokens it has seen.

    hot: plain tokens for which it is false need not be parted, as none of their words is asked for.
    """

    def __init__(self, logp: np.ndarray, vocabulary: dict[str, float] | None = None, hot: Callable[[str], bool] | None = None) -> None:
        self.logp = logp
        self.vocabulary = vocabulary or {}
        self.hot = hot
        self.rows: list[list[float]] = logp.reshape(SIZE * SIZE, SIZE).tolist()
        self.known: dict[str, str] = {}

    def decode(self, marks: str, stretched: bool = True) -> str:
        """The likeliest letters behind all the marks, with a space where a mark parts them."""
        return self.path(marks, stretched).replace("\0", "").strip()

    def path(self, marks: str, stretched: bool = True) -> str:
        """Viterbi over (last two letters): letters, " " for a mark read as a space and "\\0" for one read as nothing.

        A path is a chain of its letters, so a long token costs its length. stretched: letters may be repeats.
        """
        rows = self.rows
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        least = (-math.inf, None)
        last = ""
        run = 0
        for c in marks:
            run = run + 1 if c == last else 1
            options = [(CODE[c], c, 0.0)] if c in CODE else [(CODE[x], x, SWAP) for x in STANDS_FOR.get(c, "")]
            skip = (STRETCH if run > 1 and stretched else None) if c in CODE else GAP if c == " " else STRAY
            mark = not c.isalnum()
            last = c
            new: dict[int, tuple[float, tuple | None]] = {}
            for ab, (s, word) in states.items():
                b = ab % SIZE
                row = rows[ab]
                end = s + row[0]
                for k, x, cost in options:
                    v = s + cost + row[k]
                    if v > new.get(b * SIZE + k, least)[0]:
                        new[b * SIZE + k] = (v, (word, x))
                if mark and b and end > new.get(b * SIZE, least)[0]:
                    new[b * SIZE] = (end, (word, " "))
                if skip is not None and (run == 1 or word):
                    v = s if mark and word and not b else s + skip
                    if v > new.get(ab, least)[0]:
                        new[ab] = (v, (word, "\0") if mark and b else word)
            states = new or states
        path = max(((s + (self.rows[ab][0] if ab % SIZE else 0.0), word) for ab, (s, word) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def part(self, path: str) -> str:
        """Viterbi over places: the likeliest words of a path, with a space between. Known words go by their shares, others by their letters."""
        letters, free = "", {0}
        for piece in re.split("[ \0]+", path):
            letters += piece
            free.add(len(letters))
        if letters in self.vocabulary:
            return letters
        n, rows, words = len(letters), self.rows, self.vocabulary
        code = [CODE[c] for c in letters]
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
        #: The best unknown word of one letter, and of more, that is open here: score and start.
        one = more = (-math.inf, 0)
        for i in range(n):
            at = best[i][0] + (0.0 if i in free else MISSING)
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                share = words.get(letters[i:j])
                if share is not None and at + share > best[j][0]:
                    best[j] = (at + share, i)
            k = code[i]
            if i:
                a, b = (code[i - 2] if i > 1 else 0), code[i - 1]
                more = max((more[0] + rows[a * SIZE + b][k], more[1]), (one[0] + rows[b][k], one[1]))
            one = (at + UNKNOWN + rows[0][k], i)
            for v, start, ab in ((*one, k), (*more, (code[i - 1] if i else 0) * SIZE + k)):
                if v + rows[ab][0] > best[i + 1][0]:
                    best[i + 1] = (v + rows[ab][0], start)
        out = []
        while n:
            out.append(letters[best[n][1] : n])
            n = best[n][1]
        return " ".join(reversed(out))

    def word(self, token: str) -> str:
        """The restored word of one token or run ("" if it holds no letter); several, with a space between, where it joins them."""
        got = self.known.get(token)
        if got is None:
            low = token.lower()
            alone = PLAIN.fullmatch(low) is not None
            if not alone:
                low = bare(low)
                alone = PLAIN.fullmatch(low) is not None
            if not alone and not LETTER.search(low):
                got = ""
            else:
                plain = not STRETCHED.search(low) and (alone or not ODD.search(low))
                if plain and alone and (len(low) < JOINED or self.hot and not self.hot(low)):
                    got = low
                elif not self.vocabulary:
                    got = low if plain and alone else self.decode(low, not plain)
                else:
                    got = self.part(low if plain and alone else self.path(low, not plain))
            if len(token) <= TOKEN_KEPT:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[token] = got
        return got

    def words(self, text: str) -> list[str]:
        """The words of the restored text."""
        return [w for t in units(text) for w in self.word(t).split()]


def units(text: str) -> list[str]:
    """The white-space tokens; a run of letters set apart is one, with single spaces."""
    out, at = [], 0
    for m in SPACED.finditer(text):
        out += text[at : m.start()].split()
        out.append(" ".join(m[0].split()))
        at = m.end()
    return out + text[at:].split()


def restore(docs: DataFrame, logp: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, restored``: the decoded words of every text, joined by one space."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(logp)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([" ".join(channel.words(t or "")) for t in part.column(1).to_pylist()], pa.string())], names=["k", "restored"])

    return docs.select(F.col(key).alias("k"), F.col(text)).mapInArrow(run, f"k {kind}, restored string").withColumnRenamed("k", key)


def _features(word: str) -> list[str]:
    return [word[:n] for n in BEGIN if n < len(word)] + [word + "$"]


@dataclass
class Model:
    """The character model, word weights and the logistic layer over a document's weights."""

    logp: np.ndarray
    weights: dict[str, float]
    layer: np.ndarray
    vocabulary: dict[str, float]

    def hot(self) -> Callable[[str], bool]:
        """True for every token that holds a word with a weight: one of the features is a part of it."""
        stems = {f.rstrip("$") for f in self.weights} - {""}
        if not stems:
            return lambda low: False
        find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for f in stems:
            find.add_word(f)
        find.make_automaton()
        return lambda low: next(find.iter(low), None) is not None

    def weigh(self, word: str) -> float:
        return max((self.weights[f] for f in _features(word) if f in self.weights), default=0.0)


def summary(weights: np.ndarray, n: int) -> tuple[float, ...]:
    """What the logistic layer sees of a document's positive word weights."""
    top = np.sort(weights)[::-1]
    three = np.zeros(4)
    three[: min(4, len(top))] = top[:4]
    total = float(top.sum())
    return (*three.tolist(), math.log1p(total), total / math.sqrt(n + 1), float(len(top)) / (n + 10), math.log1p(n))


DIMS = 9


def blocks(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``block, x, y``: rows ``seen, y`` in blocks of some BLOCK_ROWS by a hash, each as the bytes of its numbers in the given order."""
    shape = "block int, x binary, y binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x, y = np.stack(pdf["seen"].to_list()).astype(float), pdf["y"].to_numpy(float)
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "x": [x.tobytes()], "y": [y.tobytes()]})

    block = F.pmod(F.xxhash64(*order), F.lit(-(-n // BLOCK_ROWS) or 1)).cast("int")
    return kept(rows.withColumn("block", block).groupBy("block").applyInPandas(run, shape), "toxicity-blocks")


def logistic(rows: DataFrame, n: int, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept first; Newton steps with a small ridge over all ``n`` rows of the blocks. A round sends a gradient and a Hessian a block to the driver."""
    w = np.zeros(DIMS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                y = np.frombuffer(y)
                z = np.column_stack([np.ones(len(y)), np.frombuffer(x).reshape(len(y), -1)])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g, h = z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([[*g, *h.ravel()]], pa.list_(pa.float64()))], names=["block", "sums"])

    for _ in range(rounds):
        got = rows.mapInArrow(sums, "block int, sums array<double>").collect()
        total = np.sum([r["sums"] for r in sorted(got, key=lambda r: r["block"])], axis=0)
        g = total[:DIMS] - ridge * n * w * np.r_[0, np.full(DIMS - 1, 0.01)]
        h = total[DIMS:].reshape(DIMS, DIMS) + np.eye(DIMS) * (1e-6 + ridge * n * 0.01)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Weights(dict):
    """The positive weights of the words of each token, remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.weigh, self.hot = model.weigh, model.hot()
        self.channel = Channel(model.logp, model.vocabulary, self.hot)

    def __missing__(self, token: str) -> tuple[float, ...]:
        # A word without a part that is a feature has no weight; a plain token stands for its own letters.
        low = token.lower()
        plain = PLAIN.fullmatch(low) or PLAIN.fullmatch(low := bare(low))
        if plain and not self.hot(low) and not STRETCHED.search(low):
            got = ()
        else:
            got = tuple(x for w in self.channel.word(token).split() if self.hot(w) and (x := self.weigh(w)) > 0)
        if len(token) <= TOKEN_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[token] = got
        return got


def _summaries(rows: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``seen`` (array of DIMS - 1 numbers) of each text. A worker remembers tokens from task to task."""
    kinds = dict(rows.dtypes)
    name = ("toxicity", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(name, lambda: Weights(model))
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                seen = []
                for t in part.column(len(keep)).to_pylist():
                    w = [x for u in units(t or "") for x in known[u]]
                    seen.append(summary(np.array(w, np.float64), len((t or "").split())))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(seen, pa.list_(pa.float64()))], names=[f"k{i}" for i in range(len(keep))] + ["seen"])

    shape = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keep)) + ", seen array<double>"
    got = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text)).mapInArrow(run, shape)
    return got.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keep)})


class Features(dict):
    """The features of the words of each token, remembered; of those in ``wanted`` alone, if there are such."""

    def __init__(self, logp: np.ndarray, vocabulary: dict[str, float], wanted: frozenset[str] | None = None) -> None:
        super().__init__()
        self.wanted = wanted
        self.channel = Channel(logp, vocabulary, None if wanted is None else Model(logp, dict.fromkeys(wanted, 1.0), np.zeros(DIMS), vocabulary).hot())

    def words(self, token: str) -> list[str]:
        return self.channel.word(token).split()

    def __missing__(self, token: str) -> tuple[str, ...]:
        low, hot = token.lower(), self.channel.hot
        plain = hot and (PLAIN.fullmatch(low) or PLAIN.fullmatch(low := bare(low)))
        if plain and not hot(low) and not STRETCHED.search(low):  # none of its parts is wanted
            got = ()
        else:
            got = tuple(f for w in self.words(token) for f in _features(w) if self.wanted is None or f in self.wanted)
        if len(token) <= TOKEN_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[token] = got
        return got


class Sure(Features):
    """The same for tokens that stand for themselves, whatever the features: short and known words."""

    def words(self, token: str) -> list[str]:
        low = token.lower()
        plain = PLAIN.fullmatch(low) or PLAIN.fullmatch(low := bare(low))
        return [low] if plain and not STRETCHED.search(low) and (len(low) < JOINED or low in self.channel.vocabulary) else []


def tally(rows: DataFrame, text: str, make: Callable[[], Features]) -> DataFrame:
    """``f, c0, t0, c1, t1``: in how many texts of rows (text, y, half) a feature stands, by label and half."""
    name = ("tally", uuid.uuid4().hex)
    names = ["f", "c0", "t0", "c1", "t1"]

    def batch(count: list[Counter]) -> pa.RecordBatch:
        held = list(set().union(*count))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array([c[f] for f in held], pa.int64()) for c in count)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = remembered(name, make), [Counter() for _ in range(4)]
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                for t, y, half in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    count[2 * half + int(y)].update(set().union(*map(known.__getitem__, set(units(t or "")))))
                if sum(map(len, count)) >= TALLY_ROWS:
                    yield batch(count)
                    count = [Counter() for _ in range(4)]
        yield batch(count)

    return rows.select(text, "y", "half").mapInArrow(run, "f string, c0 long, t0 long, c1 long, t1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in names[1:]))


def telling(t: Column, c: Column, clean: int, toxic: int) -> tuple[Column, Column]:
    """Log odds of a feature and how sure they are; both fall as c grows."""
    a, b = (t + 0.5) / (toxic + 1.0), (c + 0.5) / (clean + 1.0)
    return F.log(a / b), (a - b) / F.sqrt((t + c + 0.5) / (clean + toxic + 1.0) * (1.0 / toxic + 1.0 / clean))


def lexicon(counts: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Log odds of the FEATURES word beginnings with the most telling counts ``f, c, t``."""
    w, z = telling(F.col("t"), F.col("c"), clean, toxic)
    rows = counts.where(f"t >= {LEAST_DOCS}").select("f", w.alias("w"), z.alias("z")).where("z > 4 and w > 0.7")
    return {r["f"]: float(r["w"]) for r in rows.orderBy(F.desc("z"), "f").limit(FEATURES).collect()}


def feature_counts(rows: DataFrame, n: list[list[int]], logp: np.ndarray, known: dict[str, float], text: str = "text") -> DataFrame:
    """``f, c0, t0, c1, t1`` of every feature that a lexicon of a half or of both may hold.

    Toxic texts are restored whole. Clean texts are first counted by words that need no restoring; what stands in too many
    of them already can be in no lexicon, and only tokens with a part that is another feature are restored.
    """
    toxic = n[0][1] + n[1][1]
    least = max(LEAST_DOCS, toxic / LEAST_SHARE)
    hot = cut(tally(rows.where("y = 1"), text, lambda: Features(logp, known)).where(f"t0 + t1 >= {least}").select("f", "t0", "t1"))
    wanted = frozenset(r["f"] for r in hot.select("f").collect())
    with_clean = lambda some: hot.join(tally(rows.where("y = 0"), text, some).select("f", "c0", "c1"), "f", "left").na.fill(0, ["c0", "c1"])
    may = F.lit(False)
    for h in ((0,), (1,), (0, 1)):
        clean, toxic = (sum(n[i][y] for i in h) for y in (0, 1))
        if clean and toxic:
            w, z = telling(sum((F.col(f"t{i}") for i in h), F.lit(0)), sum((F.col(f"c{i}") for i in h), F.lit(0)), clean, toxic)
            may = may | (w > 0.69) & (z > 3.99)
    found = frozenset(r["f"] for r in with_clean(lambda: Sure(logp, known, wanted)).where(may).select("f").collect())
    # What isn't in found has no clean counts here.
    keep = rows.sparkSession.createDataFrame([(f,) for f in sorted(found)], "f string")
    return cut(with_clean(lambda: Features(logp, known, found)).join(keep, "f", "left_semi"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """The character model counts all texts; the rest learns from all training rows.
    The logistic layer sees each half of them under word weights of the other."""
    logp = language_model(trigrams(docs, text))
    ids = cut(labelled(labels, label, key, None))
    # The broadcast has a known bound.
    ids = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids.hint("merge")
    rows = docs.select(key, text).join(ids, key).withColumn("half", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).cast("int"))
    # Of texts that share an id the one with the smallest hash, in every run.
    one = F.min(F.struct(F.xxhash64(text).alias("h"), text, "y", "half")).alias("d")
    rows = kept(rows.groupBy(key).agg(one).select(key, f"d.{text}", "d.y", "d.half"), "toxicity-rows")
    known = vocabulary(rows, text)
    size = {(r["half"], int(r["y"])): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    n = [[size.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    clean, toxic = n[0][0] + n[1][0], n[0][1] + n[1][1]
    if not clean or not toxic:
        return Model(logp, {}, np.r_[math.log((toxic + 1) / (clean + 1)), np.zeros(DIMS - 1)], known)
    counts = feature_counts(rows, n, logp, known, text)
    seen, learned = [], 0
    for h in (0, 1):
        if min(*n[h], *n[1 - h]):
            other = Model(logp, lexicon(counts.select("f", F.col(f"c{1 - h}").alias("c"), F.col(f"t{1 - h}").alias("t")), *n[1 - h]), np.zeros(DIMS), known)
            seen.append(_summaries(rows.where(f"half = {h}"), other, [key, "y", "half"], text))
            learned += sum(n[h])
    model = Model(logp, lexicon(counts.select("f", F.expr("c0 + c1").alias("c"), F.expr("t0 + t1").alias("t")), clean, toxic), np.r_[math.log(toxic / clean), np.zeros(DIMS - 1)], known)
    if seen:
        model.layer = logistic(blocks(reduce(DataFrame.unionByName, seen), learned, ["half", key]), learned)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` of every row; null and blank texts are scored as
    texts without words, repeated rows alike, other columns ignored; a text of any length is read whole, in time that grows with its length."""
    seen = _summaries(docs, model, [key], text)
    z = F.lit(float(model.layer[0]))
    for i, w in enumerate(model.layer[1:]):
        z = z + F.col("seen")[i] * F.lit(float(w))
    rows = seen.select(key, held_out(key).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
