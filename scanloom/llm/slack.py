"""Minimum-bin-slack packing of token pieces: windows are filled to the last token, a document is cut where nothing fits.

Null and blank texts are the end id alone; texts of any length are encoded whole and cut into pieces of a window's
capacity first. Repeated rows are documents of their own, null keys stay; other columns are ignored,
whatever their names. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS, trim
from scanloom.llm.packing import CAPACITY, Shelf
from scanloom.llm.tokens import PIECES_KEPT, Encoder
from scanloom.session import scratch_path

#: Pieces that one task packs together; what is left of all groups is packed again.
GROUP = 10_000
#: Cut pieces whose ids are looked up by a broadcast of their places; more are joined.
FEW = 50_000
#: A sequence number: level, group, number in the group.
LEVEL_BITS, GROUP_BITS = 56, 20


def closest(shelf: Shelf, room: int) -> list[tuple[int, int]]:
    """``(length, how many)`` of the unpacked lengths whose sum comes closest to room from below.

    Subset sums as bits of one number, a shift for every doubling of a length's count, from the
    longest length down until room itself is reached; the counts are traced back from the best sum.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    left = shelf.bits & full & ~1
    while left and not reach >> room & 1:
        n = left.bit_length() - 1
        left ^= 1 << n
        steps.append((n, reach))
        many, k = min(shelf.count[n], room // n), 1
        while many:
            t = min(k, many)
            reach |= (reach << (n * t)) & full
            many, k = many - t, 2 * k
    best, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        k = 0
        while not before >> best & 1:
            best, k = best - n, k + 1
        if k:
            out.append((n, k))
    return out


class Windows:
    """Fills windows from pieces ``(row, from, length)``."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.shelf, self.capacity, self.total = Shelf(lengths, capacity), capacity, int(lengths.sum())
        self.stock: dict[int, list[tuple[int, int]]] = {}
        for row in np.argsort(lengths, kind="stable")[::-1].tolist():
            self.stock.setdefault(int(lengths[row]), []).append((row, 0))

    def _take(self, n: int) -> tuple[int, int, int]:
        self.shelf.take(n)
        self.total -= n
        return *self.stock[n].pop(), n

    def fill(self, room: int) -> list[tuple[int, int, int]]:
        """A window of exactly room tokens, room being no more than what is left: the longest piece, the
        multiset closest to the rest, and where that falls short the beginning of the longest piece left."""
        own = []
        if n := self.shelf.fit(room):
            own.append(self._take(n))
            room -= n
        for n, k in closest(self.shelf, room):
            own += [self._take(n) for _ in range(k)]
            room -= n * k
        if room:
            row, at, n = self._take(self.shelf.fit(self.capacity))
            own.append((row, at, room))
            self.stock.setdefault(n - room, []).append((row, at + room))
            self.shelf.put(n - room)
            self.total += n - room
        return own

    def rest(self) -> list[tuple[int, int, int]]:
        return [(row, at, n) for n, own in self.stock.items() for row, at in own]


def minimum_slack(lengths: np.ndarray, capacity: int = CAPACITY, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of ``(row, from, length)``, all full, and what is left: less than a window, or nothing if ``last``.

    The last tokens then fill windows of the powers of two in their number, which need no padding.
    """
    w, windows = Windows(lengths, capacity), []
    while w.total >= capacity:
        windows.append(w.fill(capacity))
    if last:
        windows += [w.fill(1 << b) for b in reversed(range(capacity.bit_length())) if w.total >> b & 1]
    return windows, w.rest()


def _pack_group(capacity: int, last: bool, level: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "ascending"), ("id", "ascending"), ("start", "ascending")]))
        windows, rest = minimum_slack(group["length"].to_numpy(), capacity, last)
        base = (level << LEVEL_BITS) + (group["bin_group"][0].as_py() << GROUP_BITS)
        rows, seq, offset = [], [], []
        for n, own in enumerate(windows):
            at = 0
            for piece in own:
                rows.append(piece), seq.append(base + n), offset.append(at)
                at += piece[2]
        rows, seq, offset = rows + rest, seq + [None] * len(rest), offset + [None] * len(rest)
        row, start, length = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        own = group.drop_columns("bin_group").take(pa.array(row))
        cut = length != own["length"].to_numpy()
        crc = pc.if_else(pa.array(cut), pa.scalar(None, pa.int64()), own["ids_crc32"].combine_chunks())
        new = {"skip": own["skip"].to_numpy() + start, "start": own["start"].to_numpy() + start, "length": length, "ids_crc32": crc}
        for name, values in new.items():
            own = own.set_column(own.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return own.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """``id, key, start, length, ids_crc32, doc_tokens, ids`` of every text's pieces of at most capacity ids, as a table in the shared folder."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, False, pieces_kept)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                cols: list[list] = [[] for _ in names]
                for k, own in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = own + end
                    for lo in range(0, len(ids), 4 * capacity):
                        own = ids[lo : lo + 4 * capacity]
                        for c, x in zip(cols, (k, lo // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4, own), strict=True):
                            c.append(x)
                kinds = (part.column(0).type, *[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        trim()  # the encoder stays for the worker's next task

    found = docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    path = scratch_path(docs.sparkSession, "slack-pieces")
    found = found.withColumn("id", F.monotonically_increasing_id())
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _crc_of_cuts(cuts: DataFrame, found: DataFrame) -> DataFrame:
    """The checksums of pieces cut while packing, from their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, skip, length = (b.column(c).to_pylist() for c in ("ids", "skip", "length"))
            crc = [zlib.crc32(memoryview(x)[4 * a : 4 * (a + n)]) for x, a, n in zip(ids, skip, length, strict=True)]
            at = b.schema.get_field_index("ids_crc32")
            yield b.set_column(at, "ids_crc32", pa.array(crc, pa.int64())).drop_columns(["ids"])

    own = F.broadcast(cuts) if cuts.count() <= FEW else cuts
    return found.select("id", "ids").join(own, "id").select(*cuts.columns, "ids").mapInArrow(run, cuts.schema)


def pack_tightly(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP, key: str = "doc_id", text: str = "text", pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Pieces are dealt by a hash into groups of about ``group``, whatever source or length they have; every group
    leaves less than a window, and what all groups leave is packed again, until one group is left. So
    every window but those of the last few tokens is full, and these are powers of two: no padding at any size.
    """
    spark = docs.sparkSession
    found = encoded(docs, tokenizer, end_id, capacity, key, text, pieces_kept)
    rest, level, parts = found.drop("ids").withColumn("skip", F.lit(0).cast("long")), 0, []
    while True:
        groups = max(1, -(-rest.count() // group))
        dealt = rest.withColumn("bin_group", F.pmod(F.xxhash64("id", "start"), F.lit(groups)))
        shape = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", sequence_id long, offset long"
        path = scratch_path(spark, f"slack-level-{level}")
        dealt.groupBy("bin_group").applyInArrow(_pack_group(capacity, groups == 1, level), shape).write.parquet(path)
        packed = spark.read.schema(shape).parquet(path)
        parts.append(packed.where("sequence_id is not null"))
        if groups == 1:
            break
        rest, level = packed.where("sequence_id is null").drop("sequence_id", "offset"), level + 1
    whole = reduce(DataFrame.unionByName, parts)
    rows = whole.where("ids_crc32 is not null").unionByName(_crc_of_cuts(whole.where("ids_crc32 is null"), found))
    return rows.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
