"""Best-two-fit packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS, trim
from scanloom.llm.tokens import PIECES_KEPT, Encoder
from scanloom.session import cut

CAPACITY = 2048
#: Pieces that one task packs together; every group ends with one loosely filled sequence at most.
GROUP = 50_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False, pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """``key, piece, start, length, ids_crc32[, ids]``: each text's ids with end_id after them, cut only where longer than capacity.

    Null and blank texts are the end id alone; repeated rows give repeated pieces.
    ids: little-endian unsigned 32-bit bytes. pieces_kept: how many words a worker remembers the ids of; it
    changes memory and time alone.
    """
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, False, pieces_kept)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                cols: list[list] = [[] for _ in range(6)]
                encoded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for k, own in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids = own + end
                    for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        for c, x in zip(cols, (k, n, lo // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                            c.append(x)
                kinds = (part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: len(names)], kinds, strict=False)], names=names)
        trim()

    shape = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, shape).withColumnRenamed("key", key)


class Shelf:
    """Unpacked lengths: how many of each, and the ones there are as bits of one number."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = sum(1 << n for n, c in enumerate(self.count) if c)

    def fit(self, room: int) -> int:
        """The largest length that fits, or 0."""
        return max((self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1, 0) if room > 0 else 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def put(self, n: int) -> None:
        self.count[n] += 1
        self.bits |= 1 << n

    def two(self, room: int, over: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum in (over, room]."""
        best, found = over, None
        a = self.fit(room - 1)
        while a and 2 * a > best:
            b = self.fit(min(a, room - a))
            if b == a and self.count[a] < 2:
                b = self.fit(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = self.fit(a - 1)
        return found


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths, each at most capacity in sum; every given length is in one bin.

    A bin opens with the longest piece left and takes the largest that fits
    until none does; then its smallest piece is exchanged for two unpacked ones
    if those fill the widened gap more tightly, again and again.
    """
    shelf, bins = Shelf(lengths, capacity), []
    while shelf.bits:
        own, room = [], capacity
        while n := shelf.fit(room):
            shelf.take(n)
            own.append(n)
            room -= n
        while room and len(own) > 1 and (pair := shelf.two(room + own[-1], own[-1])):
            last = own.pop()
            for n in pair:
                shelf.take(n)
                own.append(n)
            shelf.put(last)
            room += last - sum(pair)
            own.sort(reverse=True)
        bins.append(own)
    return bins


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("length", "ascending"), ("key", "ascending"), ("start", "ascending")]).to_numpy()
        length = group["length"].to_numpy()
        used = np.searchsorted(length[order], np.arange(capacity + 2))
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for n, own in enumerate(best_two_fit(length, capacity)):
            at = 0
            for size in own:
                row = order[used[size]]
                used[size] += 1
                sequence[row], offset[row] = n, at
                at += size
        sequence += group["bin_group"][0].as_py() << 24
        return group.drop_columns("bin_group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id, offset`` to rows of :func:`pieces`.

    Pieces are dealt by a hash of their place into groups of about ``group``
    pieces; each is packed on its own. A group has as many rows whatever source
    or length they have, so no value of the data makes it large.
    """
    n = found.count()
    groups = max(1, -(-n // group))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "key", "piece"), F.lit(groups))
    dealt = found.withColumnRenamed(key, "key").withColumn("bin_group", salt)
    shape = ", ".join(f"{c} {t}" for c, t in dealt.dtypes if c != "bin_group") + ", sequence_id long, offset long"
    return dealt.groupBy("bin_group").applyInArrow(_pack_group(capacity), shape).withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """Pieces of all texts with their places in sequences of at most capacity tokens."""
    return pack(cut(pieces(docs, tokenizer, end_id, capacity, key, text, pieces_kept=pieces_kept)), capacity, key=key)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of packed rows that carry ids (see ``with_ids``)."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
