"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations learned on a bounded sample turn vectors into balanced binary codes.
Every distinct vector is filed under each 16-bit substring of its code and looked
up under that substring and all its one-bit neighbours. A pair that meets in
several tables is taken from the first of them only, so no pair is made twice; a wide
Hamming limit on the whole codes drops chance meetings, and the original vectors
decide by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import whole_runs
from scanloom.llm.simhash import forest
from scanloom.operators.graph import connected_components
from scanloom.session import cut

COSINE = 0.93
#: Vectors on which the rotations are learned, the first by a hash of their id.
SAMPLE = 20_000
BITS = 128
SUBSTRING = 16
TABLES = BITS // SUBSTRING
#: Whole codes further apart than this are not reranked. At cosine 0.93 a bit differs with
#: probability 0.12: 15 of 128, with a deviation below 4 if bits were independent.
FAR = 48
BLOCK = 1_000_000


def learn(sample: np.ndarray, seeds: int = 8, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions) of BITS bits: projections on the principal axes, rotated
    to balance the codes, once for each random start until there are enough bits."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:64]
    v = x @ axes.T
    out, seed = [], 0
    while sum(w.shape[0] for w in out) < BITS:
        rng = np.random.default_rng(seed)
        r = np.linalg.qr(rng.standard_normal((len(axes), len(axes))))[0]
        for _ in range(rounds if seed < seeds else 0):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append((axes.T @ r).T)
        seed += 1
    return mean, np.concatenate(out)[:BITS]


def codes(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(n, 8) substrings of 16 bits."""
    bits = (x - mean) @ directions.T >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Distinct usable vectors: ``rep (smallest key), label, x, copies``."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & ~F.exists("x", bad) & F.exists("x", lambda e: e != 0)
    rows = vectors.select(F.col(key), F.col(label), F.col(vector), v.alias("x")).where(fine)
    return rows.groupBy(F.col(label).alias("label"), "x").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of numbers; shorter ones end in zeros if a width is given."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width or int(size.max())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest component to between 1/2 and 1: exact, and no norm over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(runs: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs a < b of whole buckets, each from the first table in which they meet."""
    for key, rep, side, table, *code in runs:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        filed = np.add.reduceat((side == 0).astype(np.int64), start)
        full = np.column_stack(code).view(np.uint64)
        for k in np.flatnonzero((filed > 0) & (size > filed)):
            left = np.arange(start[k], start[k] + filed[k])
            right = np.arange(start[k] + filed[k], start[k] + size[k])
            step = max(1, BLOCK // len(right))
            for lo in range(0, len(left), step):
                i = np.repeat(left[lo : lo + step], len(right))
                j = np.tile(right, len(left[lo : lo + step]))
                ok = (rep[i] < rep[j]) & (table[i] == table[j])
                i, j = i[ok], j[ok]
                apart = full[i] ^ full[j]
                near = np.bitwise_count(apart).sum(axis=1) <= FAR
                i, j, apart = i[near], j[near], apart[near]
                first = (np.bitwise_count(apart.view("<u2")) <= 1).argmax(axis=1) == table[i]
                if first.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i[first]]), pa.array(rep[j[first]])], names=["a", "b"])


def candidates(found: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Pairs ``a, b`` of class representatives that share a bucket of one table.

    A bucket's key mixes in a hash of the label; labels whose hashes meet are told
    apart by :func:`rerank`.
    """
    spread = np.uint64(0x9E3779B97F4A7C15)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], 1 << np.arange(SUBSTRING)])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                x = _matrix(part.column(2), len(mean))
                sub = codes(_units(x), mean, directions)
                full = np.ascontiguousarray(sub).view(np.int64)
                rep, label = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64) * spread
                for t in range(TABLES):
                    base = (label + np.uint64(t << 16)).view(np.int64)
                    probe = base[:, None] + (sub[:, t].astype(np.int64)[:, None] ^ flips[None, :])
                    keys = np.concatenate([base + sub[:, t], probe.ravel()])
                    n = len(flips)
                    cols = [keys, np.concatenate([rep, np.repeat(rep, n)]), np.repeat(np.array([0, 1], np.int8), [len(rep), n * len(rep)]), np.full(len(keys), t, np.int8)]
                    cols += [np.concatenate([full[:, c], np.repeat(full[:, c], n)]) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rep", "side", "tab", "c0", "c1"])

    shape = "key long, rep long, side byte, tab byte, c0 long, c1 long"
    rows = found.select("rep", F.xxhash64("label"), "x").mapInArrow(expand, shape)
    runs = rows.repartition("key").sortWithinPartitions("key", "side")
    return runs.mapInArrow(lambda b: _pairs(whole_runs(b, 6)), "a long, b long")


def rerank(pairs: DataFrame, found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """What the pairs come to whose labels are equal and whose original vectors, of one length, reach the cosine.

    Rows ``u, n`` (u has n links, copies counted, in some block of pairs) and rows ``u, v`` (links that span
    the components of a block): as many as a block has vectors, not as it has pairs.
    """
    one = found.select("rep", "label", "x", "copies")
    rows = pairs.join(one.toDF("a", "la", "xa", "na"), "a").join(one.toDF("b", "lb", "xb", "nb"), "b")
    rows = rows.where((F.col("la") == F.col("lb")) & (F.size("xa") == F.size("xb"))).select("a", "b", "xa", "xb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            x, y = _scaled(_matrix(whole.column(2))), _scaled(_matrix(whole.column(3)))
            got = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            a, b, na, nb = (whole.column(k).to_numpy()[got] for k in (0, 1, 4, 5))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([nb, na]), minlength=len(nodes)).astype(np.int64)
            u, v = forest(a, b)
            ends = [pa.nulls(len(nodes), pa.int64()), pa.array(v, pa.int64())]
            counts = [pa.array(count, pa.int64()), pa.nulls(len(u), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes, u]), pa.int64()), pa.concat_arrays(ends), pa.concat_arrays(counts)], names=["u", "v", "n"])

    return rows.mapInArrow(run, "u long, v long, n long")


def fit(spark: SparkSession, found: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Rotations from the bounded sample; None for an empty table."""
    rows = found.select("x", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("x").toPandas()
    if not len(rows):
        return None
    width = found.agg(F.max(F.size("x"))).first()[0]
    x = np.stack([np.pad(v, (0, width - len(v))) for v in rows["x"]])
    return learn(_units(x))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Rows with equal, known labels link at ``cosine`` or more; n_links counts the
    other rows linked directly, component_id is the smallest key reachable, kept
    marks it. Equal vectors form one class, compared once. A vector that is
    null, zero, or holds a null or non-finite number, and a row without a label,
    links with nothing; others may be as small or large as doubles are. Labels may be of any type and are equal as Spark compares
    them; vectors of two lengths never link. Rows with a null key are in no class.
    Other columns are ignored, repeated rows are rows of their own, and an empty table gives no row.
    """
    spark = vectors.sparkSession
    found = cut(classes(vectors, key, vector, label))
    model = fit(spark, found)
    rows = vectors.select(F.col(key), F.col(label).alias("label"), F.transform(F.col(vector), lambda e: e.cast("double")).alias("x"))
    if model is None:
        return rows.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    links = cut(rerank(candidates(found, *model), found, cosine))
    degree = links.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("v is not null").select("u", "v"), "u", "v").toDF("rep", "component_id")
    label_of = found.join(degree, "rep", "left").join(parts, "rep", "left").select(F.col("label").alias("l"), F.col("x").alias("y"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # -0.0 and 0.0 are one class: both sides are normalised the way grouping does it.
    same = (F.col("label") == F.col("l")) & (F.transform("x", lambda e: e + F.lit(0.0)) == F.transform("y", lambda e: e + F.lit(0.0)))
    out = rows.join(label_of, same, "left")
    part = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col(key) == part, F.lit(True)).alias("kept"))
