"""Rounding by the double's own value, as C and most SQL engines do it; Spark's ``round`` and ``format_string`` go by its shortest decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` scaled, rounded (half away from zero) and scaled back."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def whole_text(x: Column) -> Column:
    """``x`` without decimals, half to even."""
    return F.format_string("%.0f", F.rint(x))


def tenths_text(x: Column) -> Column:
    """``x`` (0 to 2^30) with one decimal: the nearest by the exact value, half to even."""
    below = F.floor(x * 10)
    high = F.floor(x * 2.0**20) / 2.0**20  # two parts, each of which times 20 is exact
    beyond = (high * 20 - (below * 2 + 1)) + (x - high) * 20  # its sign: on which side of the middle x is
    up = (beyond > 0) | ((beyond == 0) & (below % 2 == 1))
    return F.format_string("%.1f", (below + F.when(up, 1).otherwise(0)) / 10.0)
