"""Objectives of the heads, evaluated over tables (aggregates, no training)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.functions.mathx import log_sum_exp


def digamma(x: Column) -> Column:
    """For x > 0: six steps up, then the asymptotic series (error below 1e-10)."""
    y = x + 6
    up = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    z = 1 / (y * y)
    return F.ln(y) - 0.5 / y - z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z / 240))) - up


def lgamma(x: Column) -> Column:
    """For x > 0: log gamma by six steps up and Stirling's series."""
    y = x + 6
    up = sum((F.ln(x + k) for k in range(1, 6)), F.ln(x))
    z = 1 / (y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + (F.lit(1 / 12) - z * (F.lit(1 / 360) - z * (F.lit(1 / 1260) - z / 1680))) / y - up


def am_softmax(cos: Column, position: Column, scale: float = 30.0, margin: float = 0.35) -> Column:
    """Additive-margin softmax loss of a row: the true class's cosine is lowered
    by the margin before the scaled softmax."""
    lowered = F.transform(cos, lambda c, i: F.when(i == position, c - margin).otherwise(c) * scale)
    return vec.let(F.struct(lowered.alias("v"), position.alias("y")), lambda t: log_sum_exp(t["v"]) - F.element_at(t["v"], t["y"] + 1))


def compactness(cos: Column, position: Column) -> Column:
    """1 - cosine to the own class."""
    return 1 - F.element_at(cos, position + 1)


def unknown_penalty(log_e: Column) -> Column:
    """What a synthetic unknown costs: log(1 + all evidence), 0 if it has none."""
    return F.log1p(vec.total(F.transform(log_e, lambda x: F.exp(x))))


def dirichlet_kl(alpha: Column) -> Column:
    """KL divergence of a Dirichlet from the uniform one."""
    n = F.size(alpha).cast("double")

    def of(t: Column) -> Column:
        return (lgamma(t["s"]) - lgamma(t["n"]) - vec.total(F.transform(t["a"], lgamma))
                + vec.total(F.transform(t["a"], lambda a: (a - 1) * (digamma(a) - digamma(t["s"])))))

    return vec.let(F.struct(alpha.alias("a"), vec.total(alpha).alias("s"), n.alias("n")), of)


def evidential(log_e: Column, position: Column, weight: float = 0.1) -> Column:
    """Expected cross-entropy of the Dirichlet (digamma form) plus a weighted KL
    of the evidence for other classes from the uniform one."""
    alpha = F.transform(log_e, lambda x: F.exp(x) + 1)

    def of(t: Column) -> Column:
        others = F.transform(t["a"], lambda a, i: F.when(i == t["y"], 1.0).otherwise(a))
        return digamma(vec.total(t["a"])) - digamma(F.element_at(t["a"], t["y"] + 1)) + weight * dirichlet_kl(others)

    return vec.let(F.struct(alpha.alias("a"), position.alias("y")), of)


def channel_ratio(df: DataFrame, attribution: Column, positions: list[int]) -> DataFrame:
    """One row: the share of absolute attribution that lies on ``positions``."""
    own = F.lit(positions)
    parts = df.select(attribution.alias("a")).select(
        vec.total(F.transform("a", lambda x: F.abs(x))).alias("all"),
        vec.total(F.transform("a", lambda x, i: F.when(F.array_contains(own, i), F.abs(x)).otherwise(0.0))).alias("own"),
    )
    return parts.agg(F.coalesce(F.try_divide(F.sum("own"), F.sum("all")), F.lit(0.0)).alias("ratio"))


def sibling_absorption(df: DataFrame, held: Column, sibling: Column) -> DataFrame:
    """One row: of the rows of a held-out class, the share named a sibling."""
    n = lambda c: F.sum(c.cast("bigint"))
    return df.agg(n(held).alias("n_held"), n(held & sibling).alias("n_absorbed")).withColumn("rate", F.coalesce(F.try_divide(F.col("n_absorbed").cast("double"), F.col("n_held")), F.lit(0.0)))
