"""Discrete power laws fitted to histograms by maximum likelihood."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: B_2j / (2j)! of the Bernoulli numbers B_2 to B_12.
_TAIL = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160, -691 / 1307674368000)
_HEAD = 12
_GOLDEN = (5**0.5 - 1) / 2


def zeta(s: float, q: np.ndarray) -> np.ndarray:
    """Hurwitz's zeta: the sum over k >= 0 of (q + k) ** -s, for s > 1 and q > 0, by Euler and Maclaurin."""
    q = np.asarray(q, dtype=float)
    out = sum((q + k) ** -s for k in range(_HEAD))
    end = q + _HEAD
    out = out + end ** (1 - s) / (s - 1) + end**-s / 2
    factor = s * end ** (-s - 1)
    for j, b in enumerate(_TAIL):
        out = out + b * factor
        factor = factor * (s + 2 * j + 1) * (s + 2 * j + 2) / end**2
    return out


def fit_exponent(values: np.ndarray, counts: np.ndarray, least: int) -> tuple[float, float]:
    """(alpha, D) of P(x) = x ** -alpha / zeta(alpha, least) for x >= least: likeliest exponent, largest gap between distributions."""
    n, logs = counts.sum(), float((counts * np.log(values)).sum())
    loss = lambda a: n * np.log(zeta(a, np.array([least]))[0]) + a * logs
    low, high = 1 + 1e-6, 2.0
    while loss(high) > loss(high * 2) and high < 1e4:
        high *= 2
    high *= 2
    x, y = high - _GOLDEN * (high - low), low + _GOLDEN * (high - low)
    fx, fy = loss(x), loss(y)
    while high - low > 1e-10 * high:
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - _GOLDEN * (high - low)
            fx = loss(x)
        else:
            low, x, fx = x, y, fy
            y = low + _GOLDEN * (high - low)
            fy = loss(y)
    alpha = (low + high) / 2
    model = 1 - zeta(alpha, values + 1) / zeta(alpha, np.array([least]))[0]
    return alpha, float(np.abs(np.cumsum(counts) / n - model).max())


def power_law(histogram: Column, least: int = 2) -> Column:
    """Struct (alpha, D, n) of an array of (value, count) structs, values under ``least`` left out; nulls where none is left.

    A histogram has one entry a different value, so degrees that sum to s are under sqrt(2 s) entries.
    """

    @F.pandas_udf("alpha double, D double, n long")
    def fitted(column: pd.Series) -> pd.DataFrame:
        out = []
        for entries in column:
            pairs = sorted((int(e["value"]), int(e["count"])) for e in (entries if entries is not None else ()) if e["value"] is not None and e["value"] >= least)
            values, counts = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], dtype=float)
            out.append((*fit_exponent(values, counts, least), int(counts.sum())) if pairs else (None, None, 0))
        return pd.DataFrame(out, columns=["alpha", "D", "n"]).astype({"alpha": float, "D": float, "n": "int64"})

    return fitted(histogram)
