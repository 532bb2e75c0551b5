"""Positions and running sums inside the groups of a table that is sorted as a whole.

No group has to fit in one task: rows are dealt by ranges of (group, order), so a group
may lie in many partitions; what a partition's first group had before it is one
small row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.session import kept


class _Run:
    """Where the walk through a sorted partition is: its group so far, how many rows of it and their folds."""

    def __init__(self, folds: int) -> None:
        self.group: pa.Scalar | None = None
        self.rows, self.first, self.folded = 0, True, [np.int64(0)] * folds

    def step(self, group: pa.Array, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = len(group)
        new = np.zeros(n, bool)
        new[1:] = pc.not_equal(group.slice(1), group.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.group is not None and self.group != group[0]
        index = np.arange(n)
        start = np.maximum.accumulate(np.where(new, index, -1))
        at = np.where(start < 0, index + self.rows, index - start)
        first = (start < 0) & self.first
        runs = []
        for k, x in enumerate(values):
            whole = np.bitwise_xor.accumulate(x)
            before = np.where(start < 0, self.folded[k], np.where(start > 0, whole[start - 1], 0))
            runs.append(whole ^ before)
            self.folded[k] = runs[-1][-1]
        self.group, self.rows, self.first = group[n - 1], int(at[-1]) + 1, bool(first[-1])
        return at, first, runs


def scan(rows: DataFrame, group: str, order: Sequence[str], folds: Sequence[str] = (), name: str = "runs") -> DataFrame:
    """Add ``at``, a row's position in its group from 0, and ``<fold>_run`` for every long column in folds:
    the exclusive-or of the group's values up to and with the row.

    group: no nulls. order: nulls first; rows equal in it stand in any order. The result is a
    table in the shared folder; other columns stay as they are.
    """
    folds = list(folds)
    shape = T.StructType([*rows.schema.fields, T.StructField("run_part", T.IntegerType()), T.StructField("run_first", T.BooleanType()), T.StructField("at", T.LongType()), *(T.StructField(f"{f}_run", T.LongType()) for f in folds)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), _Run(len(folds))
        for b in batches:
            if not b.num_rows:
                continue
            at, first, runs = run.step(b.column(group), [b.column(f).to_numpy() for f in folds])
            new = [pa.array(np.full(len(at), part, np.int32)), pa.array(first), pa.array(at), *map(pa.array, runs)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f.name for f in shape])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group, *order]
    found = kept(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(walk, shape), name)
    # Groups that open a partition may have begun before it; there are as many as partitions at most.
    opened = found.where("run_first").select(group).distinct()
    ends = [F.max_by(f"{f}_run", "at").alias(f"{f}_end") for f in folds]
    shares = found.join(F.broadcast(opened), group, "left_semi").groupBy(group, "run_part").agg(F.count("*").alias("n"), F.max("run_first").alias("opens"), *ends)
    w = Window.partitionBy(group).orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    had = [F.expr(f"bit_xor({f}_end)").over(w).alias(f"{f}_had") for f in folds]
    carry = shares.select("run_part", "opens", F.sum("n").over(w).alias("had"), *had).where("opens and had is not null").drop("opens")
    late = lambda c: F.when(F.col("run_first"), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    whole = found.join(F.broadcast(carry), "run_part", "left").withColumn("at", F.col("at") + late(F.col("had")))
    for f in folds:
        whole = whole.withColumn(f"{f}_run", F.col(f"{f}_run").bitwiseXOR(late(F.col(f"{f}_had"))))
    return whole.select(*rows.columns, "at", *(f"{f}_run" for f in folds))
