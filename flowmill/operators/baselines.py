"""Baseline models: trees and networks from MLlib, open-set scores, and message
passing with given weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.functions.mathx import log_sum_exp
from flowmill.operators.ranking import ranked
from flowmill.plans.shared import broadcast_if_small


def _assembled(df: DataFrame, features: list[str], label: str | None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    safe = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    out = VectorAssembler(inputCols=features, outputCol="_x").transform(safe)
    if label is None:
        return out
    counts = out.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total, classes = out.count(), counts.count()
    return out.join(F.broadcast(counts), label).withColumn("_w", F.lit(float(total)) / (F.col("_c") * classes))  # one row per class


def tabular(kind: str, train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 0, **params) -> DataFrame:
    """``test`` with ``predicted``: a forest (``rf``), extremely randomised trees
    (``et``, see :func:`_extra_trees`), depth-limited tree (``dt``)
    or multilayer perceptron (``mlp``), classes weighted by inverse frequency."""
    from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier

    data = _assembled(train, features, label)
    common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "predicted"}
    if kind == "mlp":
        n = int(data.agg(F.max(label).alias("m")).first()["m"]) + 1
        model = MultilayerPerceptronClassifier(layers=[len(features), *params.get("hidden", (32,)), n], maxIter=params.get("iterations", 40), seed=seed, **common).fit(data)
    elif kind == "dt":
        model = DecisionTreeClassifier(maxDepth=params.get("depth", 8), weightCol="_w", seed=seed, **common).fit(data)
    elif kind == "rf":
        model = RandomForestClassifier(numTrees=params.get("trees", 20), maxDepth=params.get("depth", 8), featureSubsetStrategy="sqrt", weightCol="_w", seed=seed, **common).fit(data)
    elif kind == "et":
        return _extra_trees(data, _assembled(test, features, None), features, common, params.get("trees", 20), params.get("depth", 8), seed, params.get("groups", 5))
    else:
        raise ValueError(f"unknown model {kind!r}")
    return model.transform(_assembled(test, features, None)).drop("_x", "rawPrediction", "probability")


def _extra_trees(train: DataFrame, test: DataFrame, features: list[str], common: dict, trees: int, depth: int, seed: int, groups: int, cuts: int = 8) -> DataFrame:
    """Trees that split at random thresholds, not at fitted ones, on all rows.

    Every group of trees sees the features through its own random cuts (uniform
    between each feature's minimum and maximum), so no other threshold can be
    chosen; trees of a group differ by their random feature subsets. Votes of
    all groups are added.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ends = train.agg(*[f(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first()
    rng, votes = np.random.default_rng(seed), None
    for g in range(groups):
        bounds = [sorted((rng.uniform(ends[f"a{i}"], ends[f"b{i}"], size=cuts)).tolist()) if ends[f"a{i}"] is not None else [] for i in range(len(features))]
        binned = array_to_vector(F.zip_with(vector_to_array("_x"), F.lit(bounds), lambda x, b: F.size(F.filter(b, lambda t: x > t)).cast("double")))
        model = RandomForestClassifier(numTrees=max(trees // groups, 1), maxDepth=depth, featureSubsetStrategy="sqrt", bootstrap=False, maxBins=cuts + 1, weightCol="_w", seed=seed + g, **(common | {"featuresCol": "_b"})).fit(train.withColumn("_b", binned))
        test = model.transform(test.withColumn("_b", binned)).withColumn(f"_v{g}", vector_to_array("rawPrediction")).drop("_b", "rawPrediction", "probability", common["predictionCol"])
        votes = F.col(f"_v{g}") if votes is None else F.zip_with(votes, F.col(f"_v{g}"), lambda a, b: a + b)
    return test.withColumn(common["predictionCol"], vec.argmax(votes).cast("double")).drop("_x", *[f"_v{g}" for g in range(groups)])


def identity_tree(train: DataFrame, test: DataFrame, source: str, target: str, ports: list[str], label: str) -> DataFrame:
    """The floor that identities alone reach: a tree of depth 8 on host codes
    (places in the order of train's hosts, as numbers; hosts unseen in train
    share the code -1) and ports. Codes are a joined table, never a model's state."""

    def coded(df: DataFrame, column: str, out: str) -> DataFrame:
        hosts = train.select(F.col(column).alias("_host")).filter(F.col("_host").isNotNull()).distinct().withColumn("_all", F.lit(0))
        codes = ranked(hosts, ["_all"], [F.col("_host").asc()]).select("_host", F.col("rank").cast("double").alias(out))
        return df.join(broadcast_if_small(codes, 1_000_000), F.col(column) == F.col("_host"), "left").drop("_host").na.fill(-1.0, [out])

    both = lambda d: coded(coded(d, source, "_s"), target, "_t")
    return tabular("dt", both(train), both(test), ["_s", "_t", *ports], label).drop("_s", "_t")


def reconstruction_error(train: DataFrame, test: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """``test`` with ``score``: squared error of a rank-k reconstruction fitted
    on ``train`` (the linear analogue of an autoencoder)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    a = _assembled(train, features, None)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(a)
    pca = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaler.transform(a))
    parts = [[float(pca.pc.toArray()[i][j]) for i in range(len(features))] for j in range(k)]
    out = scaler.transform(_assembled(test, features, None)).withColumn("_z", vector_to_array("_z"))
    # components are orthonormal: the error is the norm that the projections leave
    left = vec.dot(F.col("_z"), F.col("_z"))
    for p in parts:
        left = left - F.pow(vec.dot(F.col("_z"), F.lit(p)), F.lit(2))
    return out.withColumn("score", F.greatest(left, F.lit(0.0)) / len(features)).drop("_x", "_z")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_x", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", maxIter=20).fit(data).transform(data).drop("_x")


def energy(logits: Column, temperature: float = 1.0) -> Column:
    """-T logsumexp(logits / T): higher is more unknown."""
    return -temperature * log_sum_exp(F.transform(logits, lambda x: x / temperature))


def odin(logits: Column, temperature: float = 1000.0) -> Column:
    """1 - largest tempered softmax: higher is more unknown."""
    return 1 - F.array_max(vec.softmax(F.transform(logits, lambda x: x / temperature)))


def weibull_fit(tail: list[float]) -> tuple[float, float]:
    """Shape and scale by maximum likelihood (location 0), by Newton steps on the
    shape's equation; (1, 1) for fewer than two distinct values."""
    x = [t for t in tail if t > 0]
    if len(x) < 2 or max(x) == min(x):
        return 1.0, 1.0
    top = max(x)
    y = [t / top for t in x]
    logs = [math.log(t) for t in y]
    mean = sum(logs) / len(y)
    k = 1.0
    for _ in range(100):
        p = [t**k for t in y]
        s0, s1, s2 = sum(p), sum(a * b for a, b in zip(p, logs, strict=True)), sum(a * b * b for a, b in zip(p, logs, strict=True))
        f = s1 / s0 - 1 / k - mean
        g = s2 / s0 - (s1 / s0) ** 2 + 1 / (k * k)
        step = f / g
        k = max(k - step, k / 2)
        if abs(step) < 1e-10 * k:
            break
    return k, top * (sum(t**k for t in y) / len(y)) ** (1 / k)


def openmax_fit(df: DataFrame, label: str, logits: str, size: int, tail: int = 20) -> DataFrame:
    """``class_id, mean, shape, scale`` from the ``tail`` largest distances of
    each class to its mean (a group limit: local top, then one merge)."""
    from flowmill.operators.prototypes import check_bank

    means = df.groupBy(F.col(label).alias("class_id")).agg(*[F.avg(F.col(logits)[i]).alias(f"_{i}") for i in range(size)]).select("class_id", F.array(*[f"_{i}" for i in range(size)]).alias("mean"))
    far = df.join(F.broadcast(check_bank(means)), F.col(label) == F.col("class_id")).withColumn("d", F.sqrt(vec.total(F.zip_with(logits, "mean", lambda a, b: (a - b) * (a - b)))))
    w = Window.partitionBy("class_id").orderBy(F.desc("d"))
    top = far.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= tail).groupBy("class_id").agg(F.collect_list("d").alias("t"))

    @F.pandas_udf("shape double, scale double")
    def fit(tails: pd.Series) -> pd.DataFrame:  # once per class
        return pd.DataFrame([weibull_fit(list(t)) for t in tails], columns=["shape", "scale"])

    return top.withColumn("w", fit("t")).join(means, "class_id").select("class_id", "mean", "w.shape", "w.scale")


def openmax_score(df: DataFrame, fit: DataFrame, logits: str, alpha: int = 3) -> DataFrame:
    """``unknown_score``: 1 - largest softmax after the top ``alpha`` logits are
    each discounted by their own class's Weibull tail."""
    packed = fit.agg(F.array_sort(F.collect_list(F.struct("class_id", "mean", "shape", "scale"))).alias("f")).scalar()
    v = F.col(logits)
    dist = lambda m: F.sqrt(vec.total(F.zip_with(v, m, lambda a, b: (a - b) * (a - b))))
    keep = lambda f: F.exp(-F.pow(dist(f["mean"]) / f["scale"], f["shape"]))  # noqa: E731  1 - the distribution function
    cut = F.element_at(F.sort_array(v, asc=False), F.least(F.lit(alpha), F.size(v)))
    out = df.withColumn("_fit", packed).withColumn("_keep", F.transform("_fit", keep)).withColumn("_cut", cut)
    recal = F.zip_with(v, F.col("_keep"), lambda x, k: F.when(x >= F.col("_cut"), x * (1 - k)).otherwise(x))
    return out.withColumn("unknown_score", 1 - F.array_max(vec.softmax(recal))).drop("_fit", "_keep", "_cut")


def message_pass(edges: DataFrame, states: DataFrame, mix: float = 0.5) -> DataFrame:
    """One layer of mean aggregation: a node's new state is a blend of its own and
    the mean of its in-neighbours' (fold per target, combined on the map side).

    ``edges``: src, dst; ``states``: node, h (array of a fixed size, scalar per
    column here). Nodes without neighbours keep their state."""
    told = edges.join(states.select(F.col("node").alias("src"), "h"), "src").groupBy(F.col("dst").alias("node")).agg(F.avg("h").alias("m"))
    return states.join(told, "node", "left").select("node", F.when(F.col("m").isNull(), F.col("h")).otherwise(F.col("h") * (1 - mix) + F.col("m") * mix).alias("h"))


def attention_pass(edges: DataFrame, states: DataFrame, slope: float = 0.2) -> DataFrame:
    """One layer of attention: softmax over a target's in-edges of the leaky sum
    of both states, then the weighted sum. Maxima and sums are folds."""
    from flowmill.operators.robust import segment_softmax_by_join

    e = edges.join(states.select(F.col("node").alias("src"), F.col("h").alias("hs")), "src").join(states.select(F.col("node").alias("dst"), F.col("h").alias("hd")), "dst")
    s = F.col("hs") + F.col("hd")
    scored = e.withColumn("score", F.when(s > 0, s).otherwise(s * slope))
    told = segment_softmax_by_join(scored, ["dst"], "score").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("hs")).alias("m"))
    return states.join(told, "node", "left").select("node", F.coalesce("m", "h").alias("h"))


def fuse_scales(df: DataFrame, scales: dict[str, Column], gates: dict[str, float]) -> DataFrame:
    """``fused`` and the gate of each scale: softmax-gated sum of per-scale values."""
    g = {n: F.exp(F.lit(gates[n]) * c) for n, c in scales.items()}
    names = list(scales)
    total = sum((g[n] for n in names[1:]), g[names[0]])
    out = df.withColumns({f"gate_{n}": g[n] / total for n in names})
    return out.withColumn("fused", sum((F.col(f"gate_{n}") * scales[n] for n in names[1:]), F.col(f"gate_{names[0]}") * scales[names[0]]))
