"""Pieces that the text operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one Arrow batch of whole texts; a batch of very long texts stays small.
TEXT_ROWS = 512
#: Keys that hold a HOT-th of all rows or more are broadcast by :func:`lookup`: HOT of them at most.
HOT = 4_000
#: What this Python worker remembers from task to task, for one operator at a time.
_REMEMBERED: dict[object, object] = {}
T = TypeVar("T")


def remembered(name: object, make: Callable[[], T]) -> T:
    """The thing of this name, made when the worker first asks for it. What it remembered for others goes."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def trim() -> None:
    """Hand free memory back to the system; a worker that waits for its next task would hold it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give:
            give(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that first forgets what it remembers for other operators and gives free memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def _forget() -> None:
    _REMEMBERED.clear()
    trim()


def map_text(df: DataFrame, key: str, text: str, schema: str, per_batch: Callable[[list, list], dict]) -> DataFrame:
    """``per_batch(keys, texts)`` over whole texts in slices of TEXT_ROWS.

    texts: UTF-8 bytes, b"" for null. The result's columns come back as a dict of
    lists or arrays in the order of ``schema``.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(at, TEXT_ROWS)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                got = per_batch(part.column(0).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(F.col(key), F.col(text)).mapInArrow(tidy(run), out)


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int, least: int = 100_000) -> Iterator[list]:
    """Rows sorted by their first column, as lists of arrays in which no run of equal keys is cut."""
    import numpy as np

    held: list[list] = []
    rows = 0

    def joined() -> list:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        rows += batch.num_rows
        if rows < least or held[0][0][0] == held[-1][0][-1]:
            continue
        whole = joined()
        last = int(np.searchsorted(whole[0], whole[0][-1]))
        yield [x[:last] for x in whole]
        held, rows = [[x[last:] for x in whole]], len(whole[0]) - last
    if rows:
        yield joined()


def lookup(rows: DataFrame, found: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with ``found``, which has one row per ``on`` and how many rows hold it, ``n``.

    Keys with a HOT-th of all ``total`` rows or more can be HOT at most; they are broadcast, so that
    none of them ends up in one task. The others shuffle.
    """
    often = F.col("n") * HOT >= total
    hot, cold = F.broadcast(found.where(often).drop("n")), found.where(~often).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
