"""SimHash near-dedup: Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 23, 23 and 18 bits (the last
padded with zeros). Two fingerprints with at most three differing bits have at
most one segment with two or more of them, so some pair of segments has at most
one error in each. The perfect binary Golay code turns "one error" into equal
keys: if d(x, y) <= 1, the codeword nearest to x (distance <= 3) is within
distance 4 of y. Each fingerprint is therefore filed once per segment pair under
its nearest codewords, and looked up under the 1 or 6 codewords within distance
4 of each segment (1 to 36 keys per pair). Equal keys meet in sorted runs and are
verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_text, whole_runs
from scanloom.operators.graph import connected_components
from scanloom.session import cut

RADIUS = 3
#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: Segments as (first bit, bits), and the pairs of which one has an error at most in each.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Pairs of rows that a task compares at once.
BLOCK = 2_000_000


def fingerprint(text: bytes, seed: int = 42, width: int = 3) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles, repeats included; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    pairs = list(zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True))
    for at in range(0, n, 16384):
        h = np.array([digest(joined[a:b], seed) for a, b in pairs[at : at + 16384]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (64 bits as a signed long) of every row; null and blank texts give 0."""

    def per_batch(keys: list, texts: list) -> dict:
        return {key: keys, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    kind = dict(docs.dtypes)[key]
    return map_text(docs, key, text, f"{key} {kind}, fp long", per_batch)


class Golay:
    """Decoding tables by syndrome, built from the generator polynomial."""

    def __init__(self) -> None:
        words = np.arange(1 << 11, dtype=np.int64)
        #: Remainder of a 23-bit word, by its upper 12 bits; the lower 11 bits are added.
        tops = np.zeros(1 << 12, np.int64)
        for i in range(12):
            r = 1 << (i + 11)
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= GOLAY << (bit - 11)
            tops ^= np.where(np.arange(1 << 12) >> i & 1, r, 0)
        self.tops = tops
        self.leader = np.zeros(len(words), np.int64)
        self.weight = np.zeros(len(words), np.int64)
        for w in (1, 2, 3):
            e = np.array([sum(1 << b for b in c) for c in combinations(range(23), w)])
            s = self.syndrome(e)
            self.leader[s], self.weight[s] = e, w
        e = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)])
        s = self.syndrome(e)
        order = np.argsort(s, kind="stable")
        far = e[order][self.weight[s[order]] == 3].reshape(-1, 5)
        self.far = np.zeros((len(words), 5), np.int64)
        self.far[np.unique(s[self.weight[s] == 3])] = far

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.tops[x >> 11] ^ (x & 0x7FF)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword within distance 3."""
        return (x ^ self.leader[self.syndrome(x)]) >> 11

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of all codewords within distance 4 as an (n, 6) array, and which of its cells hold one."""
        s = self.syndrome(x)
        found = np.column_stack([self.nearest(x), (x[:, None] ^ self.far[s]) >> 11])
        return found, np.column_stack([np.ones(len(x), bool), np.repeat((self.weight[s] == 3)[:, None], 5, axis=1)])


_CODE: list[Golay] = []


def code() -> Golay:
    if not _CODE:
        _CODE.append(Golay())
    return _CODE[0]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, side) rows of fingerprints: side 0 is filed, side 1 looks up."""
    g, u = code(), fp.view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near, index = [g.near(p) for p in parts], [g.nearest(p) for p in parts]
    keys, fps, sides = [], [], []
    for k, (a, b) in enumerate(PAIRS):
        keys.append(k << 24 | index[a] << 12 | index[b])
        fps.append(fp)
        sides.append(np.zeros(len(fp), np.int8))
        both = k << 24 | near[a][0][:, :, None] << 12 | near[b][0][:, None, :]
        held = near[a][1][:, :, None] & near[b][1][:, None, :]
        keys.append(both[held])
        fps.append(np.repeat(fp, held.reshape(len(fp), -1).sum(axis=1)))
        sides.append(np.ones(len(keys[-1]), np.int8))
    return np.concatenate(keys), np.concatenate(fps), np.concatenate(sides)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component of the links a-b: as many links as nodes at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _links(fp: np.ndarray, start: np.ndarray, filed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets; each bucket's filed rows come first."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    work = filed * (size - filed)
    big = work > BLOCK

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        x, y = fp[i], fp[j]
        ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS) & (x != y)
        if ok.any():
            out.append((x[ok], y[ok]))

    live = np.flatnonzero((work > 0) & ~big)
    cum = np.concatenate([[0], np.cumsum(work[live])])
    for lo in range(0, len(live), 200_000):
        for part in np.array_split(live[lo : lo + 200_000], max(1, int((cum[min(lo + 200_000, len(live))] - cum[lo]) // BLOCK))):
            w = work[part]
            at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            probes = np.repeat(size[part] - filed[part], w)
            base = np.repeat(start[part], w)
            verify(base + at // probes, base + np.repeat(filed[part], w) + at % probes)
    for k in np.flatnonzero(big):
        left, right = np.arange(start[k], start[k] + filed[k]), np.arange(start[k] + filed[k], start[k] + size[k])
        step, held = max(1, BLOCK // len(right)), len(out)
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            verify(np.repeat(part, len(right)), np.tile(right, len(part)))
            if sum(len(x) for x, _ in out[held:]) > BLOCK:
                out[held:] = [forest(*map(np.concatenate, zip(*out[held:], strict=True)))]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*map(np.concatenate, zip(*out, strict=True)))


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and side: links of each run of equal keys."""
    def emit(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([start, [len(key)]]))
        filed = np.add.reduceat((side == 0).astype(np.int64), start) if len(key) else size
        a, b = _links(fp, start, filed, size)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    for key, fp, side in whole_runs(batches, 3):
        yield emit(key, fp, side)


def fingerprint_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links ``src, dst`` that span every component of the distinct fingerprints.

    Connected by links means the same under these rows as under all pairs within
    RADIUS bits; a bucket gives as many rows as it has fingerprints at most.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                key, got, side = keys_of(x[at : at + 4096].copy())
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(got), pa.array(side)], names=["key", "fp", "side"])

    filed = fps.select(F.col(fp)).distinct().mapInArrow(expand, "key int, fp long, side byte")
    runs = filed.repartition("key").sortWithinPartitions("key", "side")
    return runs.mapInArrow(_sorted_runs, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` of every row of docs.

    Texts whose fingerprints differ in at most 3 bits link; component_id is the
    smallest key reachable by links. Null and blank texts have the zero
    fingerprint and link like any other. Equal fingerprints are one node, so
    copies are never paired; rows with a null key keep their fingerprint and
    their component. Repeated rows stay. Other columns are ignored.
    """
    fps = cut(fingerprints(docs, key, text))
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("first")))
    parts = connected_components(fingerprint_links(nodes))
    parts = cut(parts.toDF("fp", "part"))
    first = nodes.join(parts, "fp", "left").select("fp", "first", F.coalesce("part", "fp").alias("part"))
    low = first.groupBy("part").agg(F.min("first").alias("component_id"))
    label = first.join(low, "part").select("fp", "component_id")
    return fps.join(label, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
