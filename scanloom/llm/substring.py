"""Substring dedup: a log-structured fingerprint index.

A window is WINDOW consecutive words. The smallest hash among the GRAM-word
grams of a window is its fingerprint: equal windows always have the same one, and
a text of n words has only about 2 n / (WINDOW - GRAM + 2) different ones.

The log holds sorted immutable runs of ``fp, key, body`` rows, bucketed by
fingerprint, and for each batch its texts, bucketed by key (and a digest where keys repeat). A batch is
staged once (words compressed, fingerprints), its fingerprints become a sorted table of the same buckets,
and that is merge-joined with every run of the history: no run is shuffled
again. Where two documents hold a fingerprint, the windows behind it are
hashed in full and verified by a second, independent digest of their words (128
bits in all); of the history only the documents that share one are decompressed. Of
a batch, the run keeps the fingerprints of windows that are first there, so a passage in
a third of all documents is in the history once. A manifest names the live runs;
compaction merges them bucket by bucket and deletes the old files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS, lookup, tidy
from scanloom.session import cut, delete_path, forget, kept, scratch_path

WINDOW = 50
GRAM = 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Batches of a whole table, and runs of the history beyond which they are merged into one.
BATCHES = 3
MOST_RUNS = 1
MANIFEST = "version int, buckets int, own array<string>, runs array<string>, texts array<string>"
#: Distinct words whose hashes a worker remembers.
WORDS_KEPT = 50_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Windows:
    """Rolling hashes of the words of one text."""

    _words = WordHashes()
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        if len(Windows._up) <= n:
            size = max(2 * len(Windows._up), n + 1)
            Windows._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]), dtype=np.uint64)
            Windows._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, INVERSE, np.uint64)]), dtype=np.uint64)
        a = np.fromiter(map(Windows._words.__getitem__, words), np.uint64, n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(a * Windows._up[:n], dtype=np.uint64)])

    @classmethod
    def forget(cls) -> None:
        """Free what is remembered between texts."""
        cls._words.clear()
        cls._up = cls._down = np.ones(1, np.uint64)

    def hashes(self, k: int) -> np.ndarray:
        h = (self.sums[k:] - self.sums[:-k]) * Windows._down[: len(self.sums) - k]
        return h

    def fingerprints(self) -> np.ndarray:
        """One for each window: the smallest mixed hash of its grams."""
        h = self.hashes(GRAM)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        low = h ^ (h >> np.uint64(29))
        want, have = WINDOW - GRAM + 1, 1
        while 2 * have <= want:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        rest = want - have
        return np.minimum(low[:-rest], low[rest:]) if rest else low


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def staged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, body, check, n_words, z, fps`` of each row: two 64-bit digests of its words joined by one
    space, these words compressed, and its fingerprints (none for fewer words than a window has)."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                body, check, n_words, z, fps = [], [], [], [], []
                for t in _bytes(part.column(1)):
                    words = t.split()
                    joined = b" ".join(words)
                    both = xxhash.xxh3_128_intdigest(joined, 7)
                    body.append(_signed(both >> 64)), check.append(_signed(both & 0xFFFFFFFFFFFFFFFF))
                    n_words.append(len(words))
                    z.append(squeeze.compress(joined))
                    fps.append(np.unique(Windows(words).fingerprints()).view(np.int64) if len(words) >= WINDOW else [])
                longs = [pa.array(x, pa.int64()) for x in (body, check, n_words)]
                yield pa.RecordBatch.from_arrays([part.column(0), *longs, pa.array(z, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["key", "body", "check", "n_words", "z", "fps"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(tidy(run), f"key {kind}, body long, check long, n_words long, z binary, fps array<long>")


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, [body,] z, fps) -> the windows behind the fingerprints: key[, body], at, h, v."""
    open_ = zstandard.ZstdDecompressor()
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        own = whole.num_columns - 2
        for lo in range(0, whole.num_rows, TEXT_ROWS):
            part = whole.slice(lo, TEXT_ROWS)
            rows, spots, hashes, checks = [], [], [], []
            for i in range(part.num_rows):
                words = open_.decompress(part.column(own)[i].as_py()).split()
                w = Windows(words)
                wanted = part.column(own + 1)[i].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(w.fingerprints(), wanted, kind="sort"))
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                rows.append(np.full(len(at), i))
                spots.append(at.astype(np.int32))
                hashes.append(w.hashes(WINDOW)[at].view(np.int64))
                checks.append(np.array([digest(joined[a:b]) for a, b in zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)], np.uint64).view(np.int64))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(own)), *(pa.array(np.concatenate(x)) for x in (spots, hashes, checks))], names=[*["key", "body"][:own], "at", "h", "v"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, z, gone) -> key, n_words, n_removed, kept; gone: starts of removed windows, -1 for all, null for none."""
    Windows.forget()  # no text is hashed any more, and the worker may serve other stages
    open_ = zstandard.ZstdDecompressor()
    for whole in batches:
        for lo in range(0, whole.num_rows, TEXT_ROWS):
            part = whole.slice(lo, TEXT_ROWS)
            n_words, n_removed, kept = [], [], []
            for z, gone in zip(part.column(1), part.column(2), strict=True):
                joined = open_.decompress(z.as_py())
                words = joined.split()
                n = len(words)
                if not gone.is_valid:
                    n_words.append(n), n_removed.append(0), kept.append(joined)
                    continue
                at = gone.values.to_numpy()
                if (at < 0).any():
                    n_words.append(n), n_removed.append(n), kept.append(b"")
                    continue
                edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.concatenate([np.zeros(WINDOW, np.int64), np.bincount(at, minlength=n + 1)])[: n + 1]
                stays = np.cumsum(edge)[:n] == 0
                n_words.append(n), n_removed.append(int(n - stays.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept_text"])


@dataclass
class Manifest:
    """What is live in a log: sorted runs and the texts of their documents, by name of their folder."""

    version: int = 0
    buckets: int = 0
    #: What tells rows apart: the key, and the digest of the text unless keys are unique.
    own: list[str] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


class FingerprintLog:
    """Sorted immutable runs below ``path``, one for each batch until compacted.

    A log that exists there is opened as its last whole manifest says, in this session or
    in another one; ``buckets`` and ``unique_keys`` then are those of the log. One writer at a
    time. unique_keys: no two rows of all batches share a key, so rows need no digest beside it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_runs: int = 4, unique_keys: bool = False) -> None:
        self.spark, self.most_runs = spark, most_runs
        self.path = path or scratch_path(spark, "fingerprint-log")
        self.live = self._read()
        self.live.buckets = self.live.buckets or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.live.own = self.live.own or (["key"] if unique_keys else ["key", "body"])

    def _read(self) -> Manifest:
        # A version's one file comes to its folder when it is whole.
        try:
            rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(f"{self.path}/manifest").select("path").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return Manifest()
        last = max((int(r["path"].split("/")[-2][1:]) for r in rows), default=0)
        if not last:
            return Manifest()
        got = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/v{last:06d}").first()
        return Manifest(**got.asDict())

    def _commit(self, runs: list[str], texts: list[str]) -> None:
        """Make a new manifest the live one; only then are files that it no longer names deleted."""
        old, self.live = self.live, Manifest(self.live.version + 1, self.live.buckets, self.live.own, runs, texts)
        row = self.spark.createDataFrame([(self.live.version, self.live.buckets, self.live.own, runs, texts)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v{self.live.version:06d}")
        for name in {*old.runs, *old.texts}.difference(runs, texts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, f"{self.path}/{name}")

    def write(self, rows: DataFrame, *by: str) -> str:
        """A new immutable table, bucketed and sorted; one file a bucket if rows lie by bucket already."""
        name = f"{'run' if by == ('fp',) else 'texts'}_{uuid.uuid4().hex[:16]}"
        rows.sortWithinPartitions(*by).write.bucketBy(self.live.buckets, *by).sortBy(*by).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        """A table of the log, as buckets."""
        if not self.spark.catalog.tableExists(name):
            by = "fp" if name.startswith("run") else ", ".join(self.live.own)
            columns = ", ".join(f"`{c}` {t}" for c, t in self.spark.read.parquet(f"{self.path}/{name}").dtypes)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{self.path}/{name}') CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.live.buckets} BUCKETS")
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        """Remove a table that no manifest names."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Take the log's tables out of the session's catalog; their files stay."""
        for name in (*self.live.runs, *self.live.texts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def append(self, run: str, texts: str) -> None:
        self._commit([*self.live.runs, run], [*self.live.texts, texts])

    def compact(self) -> None:
        """Merge the runs into one, and the texts, if there are more than ``most_runs``; equal buckets are put together, so nothing is shuffled."""
        if len(self.live.runs) > self.most_runs:
            whole = lambda names: reduce(DataFrame.unionByName, map(self.read, names))
            run = self.write(whole(self.live.runs), "fp")
            texts = self.write(whole(self.live.texts), *self.live.own)
            self._commit([run], [texts])


def _first_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, [body,] z, fps, gone) -> fp, key[, body]: those of fps with a window that isn't in gone."""
    open_ = zstandard.ZstdDecompressor()
    for part in batches:
        own = part.num_columns - 3
        rows, prints = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(part.num_rows):
            fp = Windows(open_.decompress(part.column(own)[i].as_py()).split()).fingerprints()
            gone = part.column(own + 2)[i]
            if gone.is_valid:
                fp = np.delete(fp, gone.values.to_numpy())
            left = np.intersect1d(fp.view(np.int64), part.column(own + 1)[i].values.to_numpy())
            rows.append(np.full(len(left), i)), prints.append(left)
        row = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints)), *(part.column(k).take(row) for k in range(own))], names=["fp", "key", "body"][: own + 1])


def add_batch(log: FingerprintLog, docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Add docs to the log; returns the log's table of their texts and ``key[, body], gone`` of
    those that lose words (starts of removed windows, -1 for all), written."""
    spark, buckets, kind = log.spark, log.live.buckets, dict(docs.dtypes)[key]
    here = docs.where(F.col(key).isNotNull())
    own = log.live.own
    texts = log.write(staged(here, key, text).repartition(buckets, *own), *own)
    rows = log.read(texts)
    full = rows.where(f"n_words >= {WINDOW}")
    shape = ", ".join(f"{c} {kind if c == 'key' else 'long'}" for c in own)

    # Among whole copies only the first has to be looked at; the rest go whole.
    same = ["body", "check", "n_words"]
    copies = cut(full.groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copied = kept(lookup(full.select("key", *same), copies, same, rows.count()).where("key > first").select(*own).distinct(), "copies")
    lead = full.join(copied, own, "left_anti").select(*own, F.explode("fps").alias("fp"))

    # The batch as sorted fingerprints, merged with each run: one row a fingerprint, with what is known of its holders.
    low = [F.min(c).alias(c) for c in own]
    mine = lead.groupBy("fp").agg(*low, *[F.max(c).alias(f"high_{c}") for c in own], F.count("*").alias("n"))
    for k, name in enumerate(log.live.runs):
        mine = mine.join(log.read(name).select("fp").distinct().withColumn(f"old{k}", F.lit(True)), "fp", "left")
    old = F.coalesce(*[F.col(f"old{k}") for k in range(len(log.live.runs))], F.lit(False))
    two = reduce(Column.__or__, [F.col(c) != F.col(f"high_{c}") for c in own])
    batch = log.write(mine.select("fp", *own, "n", old.alias("old"), (old | two).alias("shared")), "fp")
    found = log.read(batch)

    # The windows behind shared fingerprints, here and in the touched documents of the history.
    wanted = lookup(lead, found.where("shared").select("fp", "n"), ["fp"], found.agg(F.sum("n")).first()[0] or 0)
    wanted = kept(wanted.groupBy(*own).agg(F.collect_set("fp").alias("fps")), "wanted")
    hash_ = lambda t, w: t.select(*own, "z").join(w, own).select(*own, "z", "fps").mapInArrow(tidy(_shared_windows), f"{shape}, at int, h long, v long")
    windows = hash_(full, wanted).withColumn("old", F.lit(False))
    if log.live.runs:
        asked = found.where("old").select("fp")
        held = reduce(DataFrame.unionByName, [log.read(r).join(asked, "fp", "left_semi") for r in log.live.runs])
        held = kept(held.groupBy(*own).agg(F.collect_set("fp").alias("fps")), "held")
        for name in log.live.texts:
            windows = windows.unionByName(hash_(log.read(name), held).withColumn("old", F.lit(True)))
    windows = kept(windows, "windows")
    first = windows.groupBy("h", "v").agg(F.min(F.when(~F.col("old"), F.col("key"))).alias("low"), F.max("old").alias("known"), F.count("*").alias("n"))
    first = kept(first.where("low is not null and n > 1"), "first")
    gone = lookup(windows.where("not old").drop("old"), first, ["h", "v"], windows.count()).where("known or key > low")
    spots = gone.select(*own, "at").groupBy(*own).agg(F.collect_set("at").alias("gone"))
    spots = kept(spots.unionByName(copied.select(*own, F.array(F.lit(-1)).alias("gone"))), "gone")

    # The run: unshared fingerprints with their one holder, shared ones with the documents where a window of theirs is first.
    left = full.select(*own, "z").join(wanted, own).join(spots, own, "left").select(*own, "z", "fps", "gone").mapInArrow(tidy(_first_here), f"fp long, {shape}").distinct()
    merged = found.alias("b").join(left.alias("w"), "fp", "left").where("not shared or w.key is not null")
    run = log.write(merged.select("fp", *[F.when(F.col("shared"), F.col(f"w.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in own]), "fp")
    log.append(run, texts)
    log.drop(batch)
    for df in (copied, wanted, windows, first):
        forget(df)
    return texts, spots


def _result(rows: DataFrame, spots: DataFrame, key: str) -> DataFrame:
    """``key, n_words, n_removed, kept_text`` of staged rows."""
    shape = f"key {dict(rows.dtypes)['key']}, n_words long, n_removed long, kept_text string"
    own = [c for c in ("key", "body") if c in spots.columns]
    return rows.select(*own, "z").join(spots, own, "left").select("key", "z", "gone").mapInArrow(tidy(_cut_out), shape).withColumnRenamed("key", key)


def _keyless(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows without a key, as they are."""
    rows = staged(docs.where(F.col(key).isNull()), key, text)
    shape = f"key {dict(rows.dtypes)['key']}, n_words long, n_removed long, kept_text string"
    return rows.select("key", "z", F.lit(None).cast("array<int>").alias("gone")).mapInArrow(tidy(_cut_out), shape).withColumnRenamed("key", key)


def dedup_batch(log: FingerprintLog, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove from docs what the log's documents, or smaller keys of docs, hold already, and add docs to the log.

    Returns ``key, n_words, n_removed, kept_text`` for each row of docs: the words not
    covered by a window whose words also start in an earlier document, joined by
    one space. Earlier: any document of the log, then the smaller key. Windows are judged on
    the input, not on what is left. Null and blank texts have no words; a very long text costs its
    length; rows with a null key keep everything and aren't logged; rows that share a key are one document and never
    remove from each other; repeated rows come back as often; other columns are
    ignored; an empty table gives no row. Read or write the
    result before the log is compacted: it lies in the log's files.
    """
    texts, spots = add_batch(log, docs, key, text)
    return _result(log.read(texts), spots, key).unionByName(_keyless(docs, key, text))


def dedup_table(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", most_runs: int = MOST_RUNS) -> DataFrame:
    """Deduplicate a whole table through a fresh log: ascending ranges of the key arrive as batches, one after the other.

    Each batch meets the history as :func:`dedup_batch` says; between them the log is
    compacted. A key that is no number arrives in one batch.
    """
    spark = docs.sparkSession
    unique = not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").head(1)
    log = FingerprintLog(spark, most_runs=most_runs, unique_keys=unique)
    number = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    cuts = docs.agg(F.percentile_approx(key, [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 and number else []
    bounds = [None, *sorted(set(cuts)), None]
    spots = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if lo is not None:
            log.compact()
        inside = (F.lit(True) if hi is None else F.col(key) <= hi) & (F.lit(True) if lo is None else F.col(key) > lo)
        spots.append(add_batch(log, docs.where(inside), key, text)[1])
    union = lambda x: reduce(DataFrame.unionByName, x)
    out = union([_result(log.read(t), union(spots), key) for t in log.live.texts])
    log.close()
    return out.unionByName(_keyless(docs, key, text))
