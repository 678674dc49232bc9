"""Attributions of prototype evidence, and how good they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import vec


def attribution(z: Column, proto: Column, tau: float) -> Column:
    """Exact contribution of each dimension to log evidence: z_j p_j / tau."""
    return F.zip_with(z, proto, lambda a, b: a.cast("double") * b / max(tau, 1e-6))


def completeness_gap(z: Column, proto: Column, tau: float, margin: float) -> Column:
    """What the attributions and the constant miss of log evidence (0 up to rounding)."""
    whole = (vec.dot(z, proto) - 1 + margin) / max(tau, 1e-6)
    return F.abs(vec.total(attribution(z, proto, tau)) + (margin - 1) / max(tau, 1e-6) - whole)


def integrated_gradients(z: Column, base: Column, proto: Column, tau: float, steps: int = 50) -> Column:
    """(z - base) times the mean gradient of cos(z, proto) / tau along the path
    from base to z (midpoint rule). A row is worked alone, in Arrow batches."""

    def run(z: pd.Series, base: pd.Series, proto: pd.Series) -> pd.Series:
        a, b, p = (np.array(v.tolist(), dtype=float).reshape(len(v), -1) for v in (z, base, proto))
        acc = np.zeros_like(a)
        for i in range(steps):
            x = b + (a - b) * ((i + 0.5) / steps)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            d = (x * p).sum(axis=1, keepdims=True)
            acc += (p / n - d * x / n**3) / tau
        return pd.Series(list((a - b) * acc / steps))

    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    return F.pandas_udf(run, "array<double>")(doubles(z), doubles(base), doubles(proto))


def top_k(v: Column, k: int) -> Column:
    """1-based positions of the k largest magnitudes, largest first (ties: the
    earlier position)."""
    tagged = F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), (i + 1).alias("i")))
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda t: t["i"])


def masked(z: Column, positions: Column, base: Column, keep: bool) -> Column:
    """``z`` with the positions (``keep=False``) or all others (``keep=True``)
    replaced by ``base``."""
    inside = lambda i: F.array_contains(positions, i + 1)
    return F.transform(F.arrays_zip(z.alias("z"), base.alias("b")), lambda t, i: F.when(inside(i) if keep else ~inside(i), t["z"].cast("double")).otherwise(t["b"]))


def stability(df: DataFrame, group: str, member: str, vector: str) -> DataFrame:
    """Per group: mean pairwise Spearman correlation of the members' vectors
    (ties get average ranks; 1.0 for a single member). Groups are the few
    perturbations of one row."""
    long = df.select(group, member, F.posexplode(vector).alias("i", "x"))
    w = Window.partitionBy(group, member)
    rank = F.rank().over(w.orderBy("x")) + (F.count(F.lit(1)).over(Window.partitionBy(group, member, "x")) - 1) / 2
    r = long.withColumn("r", rank)
    a, b = r.select(group, F.col(member).alias("_a"), "i", F.col("r").alias("ra")), r.select(group, F.col(member).alias("_b"), "i", F.col("r").alias("rb"))
    per = a.join(b, [group, "i"]).filter("_a < _b").groupBy(group, "_a", "_b").agg(F.corr("ra", "rb").alias("rho"))
    mean = per.groupBy(group).agg(F.avg(F.when(~F.isnan("rho"), F.col("rho"))).alias("stability"))
    return df.select(group).distinct().join(mean, group, "left").na.fill(1.0, ["stability"])


def counterfactual(df: DataFrame, group: str, contribution: str, tie: str, need: Column) -> DataFrame:
    """Per group (a decision and the edges that speak for it): how many of the
    largest contributions must go before the sum falls below ``need``, and
    whether removing all of them flips it. Contributions are bounded by the
    neighbour cap."""
    w = Window.partitionBy(group).orderBy(F.desc(contribution), tie)
    total = F.sum(contribution).over(Window.partitionBy(group))
    left = total - F.sum(contribution).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = df.withColumn("_k", F.row_number().over(w)).withColumn("_left", left)
    return r.groupBy(group).agg(F.min(F.when(F.round("_left", 9) < need, F.col("_k"))).alias("needed"), F.count(F.lit(1)).alias("n_edges")).withColumn("flips", F.col("needed").isNotNull())


def kernel_shap(df: DataFrame, vector: str, base: list[float], weights: list[float], coalitions: int = 200, seed: int = 0) -> DataFrame:
    """``shap``: Shapley estimates of a linear-cosine score by weighted least
    squares over random coalitions, in Arrow batches: the coalitions, and so the
    solving matrix, are the same for all rows, so a batch is a few products."""
    b, w = np.array(base, dtype=float), np.array(weights, dtype=float)

    m = len(b)
    rng = np.random.default_rng(seed)
    masks = np.zeros((coalitions, m))
    for i, s in enumerate(rng.integers(1, m, size=coalitions)):
        masks[i, rng.choice(m, size=s, replace=False)] = 1
    masks = np.vstack([masks, np.ones((1, m))])
    pull = np.sqrt(np.concatenate([np.ones(coalitions), [1e4]]))
    solve = np.linalg.pinv(masks * pull[:, None])  # the same for all rows

    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), m)
        off = 1 - masks
        score = ((x * w) @ masks.T + off @ (b * w)) / np.maximum(np.sqrt((x * x) @ masks.T + off @ (b * b)), 1e-12)
        y = score - (b @ w) / max(np.linalg.norm(b), 1e-12)
        return pd.Series(list((y * pull) @ solve.T))

    return df.withColumn("shap", F.pandas_udf(run, "array<double>")(F.transform(F.col(vector), lambda y: y.cast("double"))))


def triage(df: DataFrame, k: int = 2) -> DataFrame:
    """Reports of unknown decisions: the ``k`` nearest classes and a sentence.
    Needs ``classes, cos, evidence_total, vacuity, decision``."""
    pairs = F.transform(F.arrays_zip("classes", "cos"), lambda t: F.struct((-t["cos"]).alias("d"), t["classes"].alias("class_id"), t["cos"].alias("cosine")))
    near = F.slice(F.array_sort(pairs), 1, k)
    r = df.filter("decision = -1").withColumn("nearest", F.transform(near, lambda t: F.struct(t["class_id"].alias("class_id"), t["cosine"].alias("cosine"))))
    prose = F.format_string("Unknown (evidence %.3f, vacuity %.2f): nearest class %d at cosine %.2f, too little evidence to name it.", "evidence_total", "vacuity", F.col("nearest")[0]["class_id"], F.col("nearest")[0]["cosine"])
    return r.withColumn("prose", prose)


def attention_ranking(df: DataFrame, groups: list[str], weight: str, k: int = 3) -> DataFrame:
    """The attention baseline: the ``k`` edges of each neighbour list that the
    layer itself weighs most (ties: the smaller id). Lists are capped."""
    w = Window.partitionBy(*groups).orderBy(F.desc(weight), "flow_id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def counterfactual_round_robin(df: DataFrame, group: str, scale: str, contribution: str, tie: str, need: Column) -> DataFrame:
    """As :func:`counterfactual`, but edges leave in turn over the scales: the
    largest of each scale, then the second of each, and so on."""
    inside = F.row_number().over(Window.partitionBy(group, scale).orderBy(F.desc(contribution), tie))
    turned = df.withColumn("_turn", inside)
    w = Window.partitionBy(group).orderBy("_turn", scale)
    left = F.sum(contribution).over(Window.partitionBy(group)) - F.sum(contribution).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = turned.withColumn("_k", F.row_number().over(w)).withColumn("_left", left)
    return r.groupBy(group).agg(F.min(F.when(F.round("_left", 9) < need, F.col("_k"))).alias("needed"), F.count(F.lit(1)).alias("n_edges")).withColumn("flips", F.col("needed").isNotNull())


def edge_masks(lists: DataFrame, group: str, proto: list[float], steps: int = 60, rate: float = 0.5, sparsity: float = 0.05) -> DataFrame:
    """``group, masks, score, masked_score``: for each neighbour list the weights in
    (0, 1) that keep its score with as few edges as possible, learned by gradient
    steps on sigmoid masks.

    ``lists``: ``group`` and ``l``, an array of (flow_id, w, m): weight and message
    vector. The score is the cosine of the weighted mean of messages with
    ``proto``. A list is solved alone, in Arrow batches; lists are capped.
    """
    p = np.array(proto, dtype=float)
    p = p / max(np.linalg.norm(p), 1e-12)

    def solve(w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float, float]:
        def score(g):
            a = g * w
            v = a @ m / max(a.sum(), 1e-12)
            return v, a.sum(), float(v @ p / max(np.linalg.norm(v), 1e-12))

        theta = np.full(len(w), 2.0)
        for _ in range(steps):
            g = 1 / (1 + np.exp(-theta))
            v, total, s = score(g)
            n = max(np.linalg.norm(v), 1e-12)
            by_v = p / n - s * v / (n * n)  # of the cosine
            by_g = ((m - v) @ by_v) * w / max(total, 1e-12)
            theta += rate * (by_g * len(w) - sparsity) * g * (1 - g) * 4
        g = 1 / (1 + np.exp(-theta))
        return g, score(np.ones(len(w)))[2], score(g)[2]

    def run(batches):
        for b in batches:
            out = []
            for row in b["l"]:
                w, m = np.array([x["w"] for x in row], dtype=float), np.array([list(x["m"]) for x in row], dtype=float).reshape(len(row), -1)
                out.append(solve(w, m))
            yield pd.DataFrame({group: b[group], "masks": [list(g) for g, _, _ in out], "score": [s for _, s, _ in out], "masked_score": [s for _, _, s in out]})

    kind = lists.schema[group].dataType.simpleString()
    return lists.select(group, "l").mapInPandas(run, f"`{group}` {kind}, masks array<double>, score double, masked_score double")
