"""Glicko-2 terms: column expressions for the closed forms, and an Arrow UDF for the volatility's root.

Ratings are kept on the internal scale: mu = (rating - 1500) / SCALE, phi = deviation / SCALE.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the system.
SCALE = 173.7178
START_RATING, START_DEVIATION, START_VOLATILITY = 1500.0, 400.0, 0.06
TAU, EPSILON = 0.5, 1e-6


def g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / (math.pi**2))


def expected(mu: Column, mu_other: Column, phi_other: Column) -> Column:
    return 1 / (1 + F.exp(-g(phi_other) * (mu - mu_other)))


def new_volatility(sigma: np.ndarray, phi: np.ndarray, v: np.ndarray, delta: np.ndarray, tau: float = TAU) -> np.ndarray:
    """The volatility after a period, for arrays of players: regula falsi with the Illinois rule on all at once."""
    a = np.log(sigma**2)

    def f(x: np.ndarray) -> np.ndarray:
        ex = np.exp(x)
        return ex * (delta**2 - phi**2 - v - ex) / (2 * (phi**2 + v + ex) ** 2) - (x - a) / tau**2

    over = delta**2 > phi**2 + v
    k = np.ones_like(a)
    while (low := ~over & (f(a - k * tau) < 0)).any():
        k[low] += 1
    low_end, high_end = a.copy(), np.where(over, np.log(np.where(over, delta**2 - phi**2 - v, 1.0)), a - k * tau)
    f_low, f_high = f(low_end), f(high_end)
    while (open_ := np.abs(high_end - low_end) > EPSILON).any():
        step = np.where(open_, f_high - f_low, 1.0)
        c = np.where(open_, low_end + (low_end - high_end) * f_low / step, high_end)
        fc = f(c)
        crossed = fc * f_high <= 0  # a zero ends the search
        low_end, f_low = np.where(open_ & crossed, high_end, low_end), np.where(open_, np.where(crossed, f_high, f_low / 2), f_low)
        high_end, f_high = np.where(open_, c, high_end), np.where(open_, fc, f_high)
    return np.exp(low_end / 2)


def volatility(sigma: Column, phi: Column, v: Column, delta: Column) -> Column:
    """``new_volatility`` of columns, by Arrow batches."""

    def solve(sigma: pd.Series, phi: pd.Series, v: pd.Series, delta: pd.Series) -> pd.Series:
        return pd.Series(new_volatility(*(x.to_numpy(float) for x in (sigma, phi, v, delta))))

    return F.pandas_udf(solve, T.DoubleType())(sigma, phi, v, delta)
