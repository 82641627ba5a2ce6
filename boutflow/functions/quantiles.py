"""Exclusive quartiles of a sorted array, which built-in percentiles (inclusive) do not give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exclusive_quartile(values: Column, i: int) -> Column:
    """The ``i``-th quartile (1 to 3) of a sorted array of two or more numbers."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4).cast("int")))
    share = i * (n + 1) - 4 * at
    return F.when(n >= 2, (F.element_at(values, at) * (4 - share) + F.element_at(values, at + 1) * share) / 4.0)


def exclusive_quartile_of_counts(counts: Column, n: Column, i: int) -> Column:
    """The same of an array of (value, how often), sorted, whose counts add up to ``n``."""
    at = F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4))).cast("long")
    share = i * (n + 1) - 4 * at

    def value(place: Column) -> Column:
        """The value at a place from 1, found by adding up counts."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
        step = lambda s, c: F.struct((s["seen"] + c["n"]).alias("seen"), F.coalesce(s["value"], F.when(s["seen"] + c["n"] >= place, c["n_bouts"])).alias("value"))
        return F.aggregate(counts, start, step)["value"]

    return F.when(n >= 2, (value(at) * (4 - share) + value(at + 1) * share) / 4.0)
