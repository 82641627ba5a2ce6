"""Aggregates of a fixed size for each group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_smallest(rows: DataFrame, by: list[str], value: str, k: int, name: str = "examples") -> DataFrame:
    """Per group: its ``k`` smallest values, repeats included, as a sorted array; groups whose values are all null don't come.

    Each task keeps ``k`` values of a group as it reads, and these are merged: no sort or window over all
    rows, and no more than ``k`` rows of a group from a task are shuffled.
    """
    columns = [*by, value]

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            frame = frame if best is None else pd.concat([best, frame], ignore_index=True)
            best = frame.sort_values(value, kind="stable").groupby(by, dropna=False, sort=False).head(k)
        if best is not None:
            yield best

    few = rows.select(*columns).where(F.col(value).isNotNull())
    return few.mapInPandas(keep, few.schema).groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(value)), 1, k).alias(name))
