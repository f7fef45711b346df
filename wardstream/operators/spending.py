"""Spending sequences: how much of the error budget each hypothesis may use."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstream.functions.special import zeta

EXPONENT = 1.6


def gamma(kind: str, n: int, horizon: int | None = None) -> np.ndarray:
    """gamma_1..gamma_n as an array with index 0 for gamma_1.

    ``poly``: j^-1.6 / zeta(1.6), normalised by the infinite sum. ``uniform``: 1/horizon up to the horizon
    (by default n), 0 beyond. ``jm``: log(max(j,2)) / (j exp(sqrt(log j))), normalised over the horizon.
    """
    j, h = np.arange(1, n + 1, dtype=float), horizon or n
    if kind == "poly":
        return j**-EXPONENT / zeta(EXPONENT)
    if kind == "uniform":
        return np.where(j <= h, 1.0 / h if h else 0.0, 0.0)
    if kind == "jm":
        raw = lambda x: np.log(np.maximum(x, 2)) / (x * np.exp(np.sqrt(np.log(x))))
        return raw(j) / raw(np.arange(1, h + 1, dtype=float)).sum()
    raise ValueError(f"no spending sequence {kind!r}")


def gamma_column(kind: str, pos: Column, n: Column | int) -> Column:
    """The same per row of a stream with 1-based position ``pos`` and horizon ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    if kind == "poly":
        return F.pow(pos.cast("double"), F.lit(-EXPONENT)) / F.lit(zeta(EXPONENT))
    if kind == "uniform":
        return F.when(pos <= n, F.lit(1.0) / n).otherwise(F.lit(0.0))
    raise ValueError(f"no spending sequence {kind!r}")


def cold_window(kind: str, ceiling: float, alpha: float, n: int, rejections: int = 0) -> int:
    """Last position at which a rejection is possible after ``rejections`` of them (0 if none)."""
    lvl = alpha * gamma(kind, n) * (rejections + 1)
    ok = np.flatnonzero((lvl > 0) & (ceiling >= 1.0 / np.where(lvl > 0, lvl, 1.0)))
    return int(ok[-1]) + 1 if ok.size else 0


def cold_window_closed(ceiling: float, alpha: float, rejections: int = 0) -> int:
    """The same for ``poly`` in closed form: floor((ceiling alpha (R+1) / zeta)^(1/1.6))."""
    x = ceiling * alpha * (rejections + 1) / zeta(EXPONENT)
    return math.floor(x ** (1 / EXPONENT)) if x >= 1 else 0
