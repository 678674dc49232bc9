"""Numeric column builders that Spark SQL lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.functions.vec import let


# Acklam's rational approximation of the normal quantile.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_LOW = 0.02425


def _horner(coefficients: tuple, x: Column, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out if last is None else out * x + F.lit(last)


def probit(p: Column) -> Column:
    """The normal quantile of p in (0, 1); relative error below 1.2e-9."""
    q = F.sqrt(F.lit(-2.0) * F.ln(p))
    r = F.sqrt(F.lit(-2.0) * F.ln(1 - p))
    m = p - 0.5
    mid = _horner(_A, m * m) * m / _horner(_B, m * m, 1.0)
    return F.when(p < _LOW, _horner(_C, q) / _horner(_D, q, 1.0)).when(p > 1 - _LOW, -_horner(_C, r) / _horner(_D, r, 1.0)).otherwise(mid)


def normal_scores(values: Column, knots: list[list[float]], clip: float) -> Column:
    """An array of values, each turned into its quantile among its own knots and
    then into a normal deviate, clipped.

    All columns of a row go through one Arrow call and come back as one array;
    NumPy interpolates whole batches. A value equal to a run of equal knots gets
    the middle of the run (mean of the interpolations from both sides).
    """
    tables = [np.asarray(k if len(k) > 1 else [*k, *k] or [0.0, 0.0], dtype=float) for k in knots]

    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), len(tables))
        out = np.empty_like(x)
        for j, t in enumerate(tables):
            at = np.linspace(0, 1, len(t))
            q = (np.interp(x[:, j], t, at) - np.interp(-x[:, j], -t[::-1], -at[::-1])) / 2
            out[:, j] = _probit_array(np.clip(q, 1e-7, 1 - 1e-7))
        return pd.Series(list(np.clip(out, -clip, clip)))

    return F.pandas_udf(run, "array<double>")(values)


def _probit_array(p):
    side = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(_C, side) / np.polyval((*_D, 1.0), side)
    m = p - 0.5
    mid = np.polyval(_A, m * m) * m / np.polyval((*_B, 1.0), m * m)
    return np.where(p < _LOW, tail, np.where(p > 1 - _LOW, -tail, mid))


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array, shifted by its maximum."""
    return let(F.struct(values.alias("v"), F.array_max(values).alias("m")), lambda t: t["m"] + F.ln(F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + F.exp(x - t["m"]))))
