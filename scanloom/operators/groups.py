"""Python on whole groups, many groups a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def by_key(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], shape: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``run`` on tables of whole groups, sorted by ``keys`` and ``order``: as ``applyInPandas``, which costs a call a group, for tables of very many small groups.

    Rows come in Arrow batches; of each, the last group waits for what follows, so no more than a batch and one group are in memory.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        for pdf in parts:
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1]
            at = len(pdf)
            new = pd.Series(False, index=pdf.index)
            for k in keys:
                new |= ~((pdf[k] == last[k]) | (pdf[k].isna() & pd.isna(last[k])))
            away = new.to_numpy().nonzero()[0]
            at = int(away[-1]) + 1 if len(away) else 0
            if at or (left and not _same(left[-1][keys].iloc[-1], last)):
                whole = pd.concat([*left, pdf.iloc[:at]], ignore_index=True) if left else pdf.iloc[:at].reset_index(drop=True)
                left = []
                yield run(whole)
            left.append(pdf.iloc[at:])
        if left:
            yield run(pd.concat(left, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(batches, shape)


def _same(a: pd.Series, b: pd.Series) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))
