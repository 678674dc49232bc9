"""Aggregates that a minority of corrupt messages cannot move.

Messages are long: one row per (group, coordinate, message) with ``value`` and
``weight``. Groups are neighbour lists, bounded by the neighbour cap (see
``graph.neighbours``), so a window over a group is small whatever the node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9


def weighted_mean(df: DataFrame, groups: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """``agg``: sum of weight times value (weights are taken as normalised)."""
    return df.groupBy(*groups).agg(F.sum(F.col(weight) * F.col(value)).alias("agg"))


def _kept(df: DataFrame, groups: list[str], beta: float, value: str, tie: str) -> DataFrame:
    """Marks the values left after cutting floor(beta * n) at each end."""
    ordered = Window.partitionBy(*groups).orderBy(value, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    r = df.withColumn("_n", n).withColumn("_r", F.row_number().over(ordered)).withColumn("_k", F.floor(F.col("_n") * F.lit(beta)))
    enough = F.col("_n") - 2 * F.col("_k") >= 1
    return r.withColumn("_enough", enough).withColumn("_in", ~enough | ((F.col("_r") > F.col("_k")) & (F.col("_r") <= F.col("_n") - F.col("_k"))))


def _check_beta(beta: float) -> None:
    if not 0 <= beta < 0.5:
        raise ValueError("beta must be in [0, 0.5)")


def trimmed_mean(df: DataFrame, groups: list[str], beta: float = 0.2, value: str = "value", weight: str = "weight", tie: str = "flow_id") -> DataFrame:
    """``agg``: weighted mean of what is left after trimming both ends, weights
    renormalised; if nothing would be left, the plain weighted sum."""
    _check_beta(beta)
    k = _kept(df, groups, beta, value, tie).filter("_in")
    s, w = F.sum(F.col(weight) * F.col(value)), F.sum(weight)
    return k.groupBy(*groups, "_enough").agg(s.alias("_s"), w.alias("_w")).select(*groups, F.when(F.col("_enough"), F.col("_s") / F.greatest(F.col("_w"), F.lit(TINY))).otherwise(F.col("_s")).alias("agg"))


def trimmed_std(df: DataFrame, groups: list[str], beta: float = 0.2, value: str = "value", weight: str = "weight", tie: str = "flow_id") -> DataFrame:
    """``agg``: sqrt(weighted variance of the kept values about their own
    weighted mean + 1e-9), by central moments (no cancellation)."""
    _check_beta(beta)
    k = _kept(df, groups, beta, value, tie).filter("_in")
    w = Window.partitionBy(*groups)
    mean = F.sum(F.col(weight) * F.col(value)).over(w) / F.greatest(F.sum(weight).over(w), F.lit(TINY))
    centred = k.withColumn("_d", F.col(value) - mean)
    var = F.sum(F.col(weight) * F.col("_d") * F.col("_d")) / F.greatest(F.sum(weight), F.lit(TINY))
    return centred.groupBy(*groups).agg(F.sqrt(var + TINY).alias("agg"))


def soft_medoid(vectors: DataFrame, group: str, vector: str = "vec", weight: str = "weight", temperature: float = 1.0) -> DataFrame:
    """``agg`` (array): the mean of a group's vectors under softmax weights of
    minus their summed distances / temperature, times the given weights.

    A group's vectors travel as one array (bounded by the neighbour cap), and
    pairwise distances are taken inside it: no self-join."""
    lists = vectors.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("flow_id", F.col(vector).alias("v"), F.col(weight).alias("w")))).alias("m"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    far = F.transform("m", lambda a: -F.aggregate(F.transform("m", lambda b: dist(a["v"], b["v"])), F.lit(0.0), lambda s, x: s + x) / temperature)
    lists = lists.withColumn("far", far).withColumn("top", F.array_max("far"))
    raw = F.zip_with("far", "m", lambda f, m: F.exp(f - F.col("top")) * m["w"])
    lists = lists.withColumn("raw", raw).withColumn("all", F.aggregate("raw", F.lit(0.0), lambda s, x: s + x))
    size = F.size(F.element_at(F.col("m"), 1)["v"])
    zero = F.array_repeat(F.lit(0.0), size)
    mean = F.aggregate(F.zip_with("m", "raw", lambda m, r: F.transform(m["v"], lambda x: x * r / F.col("all"))), zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return lists.select(group, mean.alias("agg"))


def multi_aggregate(df: DataFrame, groups: list[str], beta: float = 0.2, cap: int = 32, **names) -> DataFrame:
    """``trim_mean, trim_std, degree``: the three parts the multi-aggregator
    joins; degree is log1p(n) / log1p(cap)."""
    n = df.groupBy(*groups).agg((F.log1p(F.count(F.lit(1))) / math.log1p(cap)).alias("degree"))
    a, b = trimmed_mean(df, groups, beta, **names).withColumnRenamed("agg", "trim_mean"), trimmed_std(df, groups, beta, **names).withColumnRenamed("agg", "trim_std")
    return a.join(b, groups).join(n, groups)


def robust_aggregate(df: DataFrame, groups: list[str], kind: str = "trimmed", beta: float = 0.2, **names) -> DataFrame:
    """The named aggregate over long messages (``mean`` or ``trimmed``; the soft
    medoid works on vectors, see :func:`soft_medoid`)."""
    if kind == "mean":
        return weighted_mean(df, groups, **{k: v for k, v in names.items() if k in ("value", "weight")})
    if kind == "trimmed":
        return trimmed_mean(df, groups, beta, **names)
    raise ValueError(f"unknown aggregate {kind!r}")


def segment_softmax(score: Column, groups: list[str]) -> Column:
    """Softmax of a score within the group, shifted by the maximum (groups
    bounded by the neighbour cap)."""
    w = Window.partitionBy(*groups)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def segment_softmax_by_join(df: DataFrame, groups: list[str], score: str, out: str = "weight") -> DataFrame:
    """The same for groups of any size: maxima and sums are folded per group
    (on the map side) and joined back, so no group is gathered."""
    top = df.groupBy(*groups).agg(F.max(score).alias("_top"))
    shifted = df.join(top, groups).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(*groups).agg(F.sum("_e").alias("_all"))
    return shifted.join(total, groups).withColumn(out, F.col("_e") / F.col("_all")).drop("_e", "_top", "_all")


def scatter_mean(df: DataFrame, target: str, value: str) -> DataFrame:
    """Mean message of each target node (a partial fold on the map side)."""
    return df.groupBy(target).agg(F.avg(value).alias("agg"), F.count(F.lit(1)).alias("n"))


def decay_weights(df: DataFrame, groups: list[str], half_life_s: float, dt: str = "dt_s", out: str = "weight") -> DataFrame:
    """Exponential time decay inside a softmax over the group: ``out`` is
    proportional to 2 ** (-dt / half life) and adds up to 1 in each group."""
    e = F.pow(F.lit(2.0), -F.col(dt) / F.lit(half_life_s))
    return df.withColumn(out, e / F.sum(e).over(Window.partitionBy(*groups)))


def time_encoding(dt: Column, size: int = 16, shortest_s: float = 0.1, longest_s: float = 600.0) -> Column:
    """An array of one linear term and sines whose periods are spaced evenly on
    a log scale."""
    ratio = (longest_s / shortest_s) ** (1 / max(size - 2, 1))
    waves = [F.sin(F.lit(2 * math.pi / (shortest_s * ratio**i)) * dt) for i in range(size - 1)]
    return F.array(dt.cast("double"), *waves)


def recency_encoding(dt: Column, window_s: float, size: int = 16) -> Column:
    """An array of log1p(dt / window) and zeros."""
    return F.array(F.log1p(dt / window_s), *[F.lit(0.0)] * (size - 1))
