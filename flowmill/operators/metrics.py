"""Evaluation: closed set, open set, calibration, selective prediction,
continual learning, bootstrap, clusters.

Curves need rows in score order. Rows are first folded to distinct scores and
then ranked in balanced slices (:func:`ranked`), so a curve over any number of
rows is never sorted in one task. Everything after the first fold is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.operators.ranking import mixed, mixed_number, quantiles, ranked


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(other))


# --- closed set ---------------------------------------------------------------


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``y, pred, n``: rows of each pair that occurs."""
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """``cls, support, predicted, tp, precision, recall, f1`` of every class
    that occurs on either side; empty denominators give 0."""
    true = conf.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    made = conf.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = true.join(made, "cls", "full").na.fill(0, ["support", "tp", "predicted"])
    return j.select(
        "cls", "support", "predicted", "tp", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def closed_set(conf: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1, weighted_f1, balanced_accuracy, mcc."""
    c = per_class(conf)
    n, hit = F.sum("support").cast("double"), F.sum("tp").cast("double")
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp, tt = F.sum(F.pow("predicted", F.lit(2))), F.sum(F.pow("support", F.lit(2)))
    s = c.agg(
        n.alias("n"), hit.alias("hit"), F.avg("f1").alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), pt.alias("pt"), pp.alias("pp"), tt.alias("tt"),
    )
    cov = F.col("hit") * F.col("n") - F.col("pt")
    scale = F.sqrt((F.col("n") * F.col("n") - F.col("pp")) * (F.col("n") * F.col("n") - F.col("tt")))
    return s.select(F.col("n").cast("bigint").alias("n"), _ratio(F.col("hit"), F.col("n")).alias("accuracy"), "macro_f1", "weighted_f1", "balanced_accuracy", F.when(scale > 0, cov / scale).otherwise(0.0).alias("mcc"))


TIERS = (("head", 1_000_000), ("body", 50_000), ("tail", 1_000))


def tier_f1(classes: DataFrame, tiers: tuple = TIERS, last: str = "extreme") -> DataFrame:
    """``tier, macro_f1, n_classes``: classes by support, above each bound."""
    tier = F.lit(last)
    for name, bound in reversed(tiers):
        tier = F.when(F.col("support") > bound, name).otherwise(tier)
    return classes.groupBy(tier.alias("tier")).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


# --- curves ---------------------------------------------------------------------


def _by_score(df: DataFrame, groups: list[str], score: str, positive: Column, descending: bool) -> DataFrame:
    folded = df.groupBy(*groups, score).agg(F.sum(positive.cast("bigint")).alias("pos"), F.sum((~positive).cast("bigint")).alias("neg"))
    g = groups or ["_all"]
    folded = folded if groups else folded.withColumn("_all", F.lit(0))
    return ranked(folded, g, [F.desc(score) if descending else F.asc(score)], {"pos": F.col("pos"), "neg": F.col("neg")})


def pr_auc(df: DataFrame, score: str, positive: Column, groups: list[str] | None = None) -> DataFrame:
    """``pr_auc``: trapezoid under precision over recall, from (0, 1); per group.
    Groups without positives get null."""
    groups = groups or []
    r = _by_score(df, groups, score, positive, True)
    recall = lambda tp: tp / F.col("all_pos")
    tp, fp = F.col("run_pos"), F.col("run_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(1.0)
    area = (recall(tp) - recall(tp0)) * (tp / (tp + fp) + before) / 2
    per = F.when(F.max("all_pos") > 0, F.sum(F.when(F.col("all_pos") > 0, area)))
    return r.groupBy(*groups).agg(per.alias("pr_auc"), F.max("all_pos").alias("n_pos"))


def roc_auc(df: DataFrame, score: str, positive: Column, groups: list[str] | None = None) -> DataFrame:
    """``auroc``: chance that a positive scores above a negative, ties half;
    null without both kinds."""
    groups = groups or []
    r = _by_score(df, groups, score, positive, False)
    wins = F.col("pos").cast("double") * (F.col("run_neg") - F.col("neg") / 2)
    both = F.max("all_pos").cast("double") * F.max("all_neg")
    return r.groupBy(*groups).agg(F.when(both > 0, F.sum(wins) / both).alias("auroc"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"))


# --- open set -----------------------------------------------------------------------


def unknown_rates(df: DataFrame, unknown: Column, flagged: Column) -> DataFrame:
    """One row: ``unknown_tpr`` (unknowns flagged) and ``unknown_fpr`` (knowns
    flagged); 0 where there are none."""
    f = lambda c: F.sum(c.cast("bigint"))
    return df.agg(f(unknown).alias("n_unknown"), f(~unknown).alias("n_known"), f(unknown & flagged).alias("a"), f(~unknown & flagged).alias("b")).select(
        "n_unknown", "n_known", _ratio(F.col("a"), F.col("n_unknown")).alias("unknown_tpr"), _ratio(F.col("b"), F.col("n_known")).alias("unknown_fpr")
    )


def openness(n_train: Column, n_test: Column, n_target: Column) -> Column:
    """1 - sqrt(2 train / (test + target)), the ratio capped at 1; 1 for no classes."""
    total = n_test + n_target
    return F.when(total == 0, 1.0).otherwise(1 - F.sqrt(F.least(_ratio(2 * n_train, total), F.lit(1.0))))


# --- calibration ----------------------------------------------------------------------


def equal_mass_bins(df: DataFrame, confidence: str, key: str, hit: Column, bins: int = 15) -> DataFrame:
    """``bin, n, conf, acc``: bins of equal count in confidence order, bounds
    ``round_half_even(b * n / bins)`` (ties in confidence by key)."""
    r = ranked(df.select(F.col(confidence).alias("c"), F.col(key).alias("k"), hit.cast("double").alias("h"), F.lit(0).alias("_all")), ["_all"], [F.col("c"), F.col("k")])
    n = F.col("group_rows")
    b = F.lit(0)
    for i in range(1, bins):
        b = b + F.when(F.col("rank") > F.rint(F.lit(float(i)) * n / F.lit(float(bins))), 1).otherwise(0)
    return r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("conf"), F.avg("h").alias("acc"))


def equal_width_bins(df: DataFrame, confidence: str, hit: Column, bins: int = 15) -> DataFrame:
    """``bin, n, conf, acc``: bins of equal width on [0, 1], the last one closed."""
    b = F.greatest(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(hit.cast("double")).alias("acc"))


def calibration_error(binned: DataFrame) -> DataFrame:
    """One row: ``ece`` (weighted mean gap) and ``mce`` (largest gap)."""
    gap = F.abs(F.col("acc") - F.col("conf"))
    return binned.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(p: Column, position: Column) -> Column:
    """Aggregate: mean squared distance of p from the one-hot truth."""
    wrong = F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == position, 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return F.avg(wrong)


def nll(p_true: Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean negative log of the probability of the truth."""
    return F.avg(-F.ln(F.greatest(F.least(p_true, F.lit(1 - eps)), F.lit(eps))))


# --- selective prediction ------------------------------------------------------------------


def risk_coverage(df: DataFrame, uncertainty: str, key: str, wrong: Column, points: int = 100) -> DataFrame:
    """``i, coverage, kept, risk, threshold``: coverage from 1 down to 0; at
    each, the error rate of the ``max(1, round_half_even(c n))`` least uncertain
    rows and the uncertainty of the last of them."""
    rows = df.select(F.col(uncertainty).alias("u"), F.col(key).alias("k"), F.lit(0).alias("_all"), wrong.cast("bigint").alias("w"))
    r = ranked(rows, ["_all"], [F.col("u"), F.col("k")], {"w": F.col("w")})
    n = r.agg(F.max("group_rows").alias("n")).scalar()
    grid = df.sparkSession.range(points).select(F.col("id").alias("i"), (1 - F.col("id") / F.lit(max(points - 1, 1))).alias("coverage"))
    wanted = grid.withColumn("kept", F.greatest(F.rint(F.col("coverage") * n), F.lit(1)).cast("bigint"))
    return r.join(F.broadcast(wanted), F.col("rank") == F.col("kept")).select("i", "coverage", "kept", (F.col("run_w") / F.col("kept")).alias("risk"), F.col("u").alias("threshold"))


def area_under_risk(curve: DataFrame) -> DataFrame:
    """One row: ``aurc`` (over ascending coverage, so positive), ``e_aurc`` (over
    the linear oracle's), ``risk_at_90``. The curve has a fixed number of points."""
    w = Window.orderBy("coverage")
    step = curve.withColumn("_c", F.lag("coverage").over(w)).withColumn("_r", F.lag("risk").over(w)).withColumn("_full", F.max_by("risk", "coverage").over(Window.partitionBy(F.lit(0))))
    width = F.col("coverage") - F.col("_c")
    ideal = lambda c: F.col("_full") * (1 - c)
    return step.agg(
        F.sum(width * (F.col("risk") + F.col("_r")) / 2).alias("aurc"), F.sum(width * (ideal(F.col("coverage")) + ideal(F.col("_c"))) / 2).alias("_o"),
        F.min_by("risk", F.struct(F.round(F.abs(F.col("coverage") - 0.9), 9), -F.col("coverage"))).alias("risk_at_90"),
    ).select("aurc", (F.col("aurc") - F.col("_o")).alias("e_aurc"), "risk_at_90")


def risk_at(curve: DataFrame, coverage: float) -> Column:
    """Aggregate over a risk curve: the risk at the point nearest to a coverage
    (of two, the one of larger coverage)."""
    return F.min_by("risk", F.struct(F.round(F.abs(F.col("coverage") - coverage), 9), -F.col("coverage")))


def selective_report(df: DataFrame, uncertainty: str, key: str, wrong: Column, points: int = 100, deferral: float = 0.02) -> DataFrame:
    """One row: areas under the risk curve, risk at 90 % coverage and at the
    deferral point, full risk, and the precision of deferring the most uncertain."""
    curve = risk_coverage(df, uncertainty, key, wrong, points)
    from flowmill.plans.shared import materialise

    curve = materialise(curve, "risk-curve")
    cut = quantiles(df, [], F.col(uncertainty), [1 - deferral]).select("value").scalar()
    d = deferral_precision(df.withColumn("_cut", cut).withColumn("_wrong", wrong), F.col(uncertainty) > F.col("_cut"), F.col("_wrong"))
    more = curve.agg(risk_at(curve, 1 - deferral).alias("risk_at_deferral"), F.max_by("risk", "coverage").alias("full_risk"))
    return area_under_risk(curve).withColumns({"risk_at_deferral": more.select("risk_at_deferral").scalar(), "full_risk": more.select("full_risk").scalar(), "n_deferred": d.select("n_deferred").scalar(), "deferral_precision": d.select("deferral_precision").scalar()})


def calibration_report(df: DataFrame, confidence: str, key: str, hit: Column, p: Column, position: Column, bins: int = 15) -> DataFrame:
    """One row: ECE and MCE over bins of equal mass and of equal width, Brier score, NLL."""
    mass, width = calibration_error(equal_mass_bins(df, confidence, key, hit, bins)), calibration_error(equal_width_bins(df, confidence, hit, bins))
    scores = df.agg(brier(p, position).alias("brier"), nll(F.element_at(p, position + 1)).alias("nll"))
    return scores.withColumns({f"{n}_{m}": d.select(m).scalar() for n, d in (("mass", mass), ("width", width)) for m in ("ece", "mce")})


def deferral_precision(df: DataFrame, deferred: Column, wrong: Column) -> DataFrame:
    """One row: ``n_deferred`` and the share of them that were wrong (1.0 if none)."""
    return df.agg(F.sum(deferred.cast("bigint")).alias("n_deferred"), F.sum((deferred & wrong).cast("bigint")).alias("w")).select("n_deferred", _ratio(F.col("w"), F.col("n_deferred"), 1.0).alias("deferral_precision"))


# --- continual learning -------------------------------------------------------------------


def forgetting(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ``forgetting`` (largest loss of F1 of a class known before, 0 if
    none) and ``backward_transfer`` (mean change)."""
    j = before.select("cls", F.col("f1").alias("a")).join(after.select("cls", F.col("f1").alias("b")), "cls")
    return j.agg(F.coalesce(F.max(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))), F.lit(0.0)).alias("forgetting"), F.coalesce(F.avg(F.col("b") - F.col("a")), F.lit(0.0)).alias("backward_transfer"))


# --- bootstrap, latency, seeds ----------------------------------------------------------------


_PRIME = (1 << 31) - 1
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def _draws(resamples: int, seed: int) -> list[tuple[int, int]]:
    """Per resample the two numbers of its hash function of keys."""
    return [(1 + mixed_number(b, "a", seed=seed) % (_PRIME - 1), mixed_number(b, "c", seed=seed) % _PRIME) for b in range(1, resamples + 1)]


def _weights(keys: np.ndarray, a: int, c: int) -> np.ndarray:
    """Poisson(1) weights: a row decides alone how often it is in a resample."""
    u = ((keys * a + c) % _PRIME) / float(_PRIME)
    return np.searchsorted(np.array(_POISSON), u, side="right")


def bootstrap_means(df: DataFrame, values: dict[str, Column], key: str, resamples: int = 200, seed: int = 5) -> DataFrame:
    """``resample, n, <name>...``: the mean of each value in each resample, all on the
    same draws (so differences are paired); null values count as 0.

    Poisson(1) weights by hash instead of drawn indices: rows are neither moved
    nor multiplied. Each batch adds its weighted sums to those of its partition,
    which leaves one row per resample.
    """
    pairs, names = _draws(resamples, seed), list(values)
    rows = df.select((mixed(F.col(key), seed=seed) % F.lit(_PRIME)).alias("_k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((resamples, len(names) + 1))
        for b in batches:
            keys = b.column(0).to_numpy()
            held = np.column_stack([np.ones(len(keys)), *[b.column(i + 1).to_numpy() for i in range(len(names))]])
            for i, (a, c) in enumerate(pairs):
                sums[i] += _weights(keys, a, c) @ held
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1, dtype=np.int32)), *[pa.array(sums[:, i]) for i in range(len(names) + 1)]], ["resample", "n", *names])

    parts = rows.mapInArrow(run, ", ".join(["resample int, n double", *[f"`{n}` double" for n in names]]))
    return parts.groupBy("resample").agg(F.sum("n").cast("bigint").alias("n"), *[_ratio(F.sum(n), F.sum("n")).alias(n) for n in names])


def bootstrap_counts(df: DataFrame, groups: list[str], key: str, resamples: int = 200, seed: int = 5, max_groups: int = 10_000) -> DataFrame:
    """``resample, groups..., n``: weighted rows of each tuple of ``groups`` (few:
    truths and predictions) in each resample, for any metric of such counts."""
    pairs = _draws(resamples, seed)
    kinds = [F.col(g) for g in groups]
    tuples = df.select(*kinds).distinct()
    told = tuples.limit(max_groups + 1).collect()
    if len(told) > max_groups:
        raise ValueError(f"more than {max_groups} tuples of groups")
    names = df.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(told)], "_g int, " + ", ".join(f"`_n_{f.name}` {f.dataType.simpleString()}" for f in tuples.schema.fields))
    same = [F.col(g).eqNullSafe(F.col(f"_n_{g}")) for g in groups]
    rows = df.join(F.broadcast(names), same).select((mixed(F.col(key), seed=seed) % F.lit(_PRIME)).alias("_k"), "_g")
    size = len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((resamples, size))
        for b in batches:
            keys, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, (a, c) in enumerate(pairs):
                sums[i] += np.bincount(g, weights=_weights(keys, a, c), minlength=size)
        for i in range(resamples):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i + 1, dtype=np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(sums[i])], ["resample", "_g", "n"])

    folded = rows.mapInArrow(run, "resample int, _g int, n double").groupBy("resample", "_g").agg(F.sum("n").cast("bigint").alias("n")).filter("n > 0")
    return folded.join(F.broadcast(names), "_g").select("resample", *[F.col(f"_n_{g}").alias(g) for g in groups], "n")


def macro_f1(counts: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """``by, macro_f1``: mean F1 over the classes of either side, per value of ``by``."""
    true = counts.groupBy(*by, F.col(y).alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    made = counts.groupBy(*by, F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    j = true.join(made, [*by, "cls"], "full").na.fill(0, ["support", "tp", "predicted"])
    return j.groupBy(*by).agg(F.avg(_ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("macro_f1"))


def interval(means: DataFrame, name: str, level: float = 0.95) -> DataFrame:
    """One row: mean, deviation and quantile bounds of the resampled means (one row
    per resample, so few)."""
    a = (1 - level) / 2
    q = F.percentile(name, F.array(F.lit(a), F.lit(1 - a)))
    return means.agg(F.avg(name).alias("mean"), F.stddev_samp(name).alias("std"), q[0].alias("ci_lower"), q[1].alias("ci_upper"))


def latency_percentiles(df: DataFrame, ms: str, groups: list[str] | None = None) -> DataFrame:
    """p50, p90, p95, p99, mean and max; exact (see :func:`ranking.quantiles`)."""
    g = groups or []
    marks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = quantiles(df, g, F.col(ms), list(marks.values())).groupBy(*g).agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for n, v in marks.items()])
    rest = df.groupBy(*g).agg(F.avg(ms).alias("mean"), F.max(ms).alias("max"), F.count(ms).alias("n"))
    if not g:  # one row each
        return rest.withColumns({n: q.select(n).scalar() for n in marks}).select(*marks, "mean", "max", "n")
    joined = rest.withColumnsRenamed({x: f"_r_{x}" for x in g}).join(q, [F.col(f"_r_{x}").eqNullSafe(F.col(x)) for x in g], "left")
    return joined.select(*[F.col(f"_r_{x}").alias(x) for x in g], *marks, "mean", "max", "n")


def recent(df: DataFrame, order: list[Column], n: int = 100_000) -> DataFrame:
    """The latest ``n`` rows (a local top n in each partition, then one merge), for
    latencies over a bounded history."""
    return df.orderBy(*order).limit(n)


def over_seeds(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and sample deviation of each metric over seeds."""
    return df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def threshold(df: DataFrame, value: str, q: float) -> DataFrame:
    """The q-quantile (linear between rows) for a cut-off; 0 for no rows."""
    return quantiles(df, [], F.col(value), [q]).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("theta"))


# --- clusters ---------------------------------------------------------------------------------


def clusters(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """One row: purity, nmi (arithmetic mean), ari; from the contingency counts."""
    t = confusion(df, y, cluster)
    rows, cols = t.groupBy("y").agg(F.sum("n").alias("a")), t.groupBy("pred").agg(F.sum("n").alias("b"))
    n = t.agg(F.sum("n").cast("double")).scalar()
    full = t.join(rows, "y").join(cols, "pred").withColumn("all_rows", n)
    pair = lambda c: c * (c - 1) / 2
    mi = full.agg(F.sum(F.col("n") / F.col("all_rows") * F.ln(F.col("all_rows") * F.col("n") / (F.col("a").cast("double") * F.col("b")))).alias("mi"), F.sum(pair(F.col("n").cast("double"))).alias("s"), F.max("all_rows").alias("all_rows"))
    side = lambda d, c, h, s: d.agg((-F.sum(F.col(c) / n * F.ln(F.col(c) / n))).alias(h), F.sum(pair(F.col(c).cast("double"))).alias(s))
    hr, hc = side(rows, "a", "h1", "s1"), side(cols, "b", "h2", "s2")
    best = t.groupBy("pred").agg(F.max("n").alias("m")).agg(F.sum("m").alias("m"))
    one = mi.withColumns({"h1": hr.select("h1").scalar(), "h2": hc.select("h2").scalar(), "s1": hr.select("s1").scalar(), "s2": hc.select("s2").scalar(), "m": best.scalar()})
    expected = F.col("s1") * F.col("s2") / F.nullif(pair(F.col("all_rows")), F.lit(0.0))
    top = (F.col("s1") + F.col("s2")) / 2 - expected
    return one.select(
        (F.col("m") / F.col("all_rows")).alias("purity"), F.when(F.col("h1") + F.col("h2") > 0, 2 * F.col("mi") / (F.col("h1") + F.col("h2"))).otherwise(1.0).alias("nmi"),
        F.when(top != 0, (F.col("s") - expected) / top).otherwise(1.0).alias("ari"),
    )


def gates(summary: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """``gate, value, limit, passed`` for rules ``name: (column, '>=' or '<=', limit)``
    over a one-row summary. NaN and null fail."""
    made = [F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(v)).alias("limit"),
                     F.coalesce(((F.col(c) >= v) if op == ">=" else (F.col(c) <= v)) & ~F.isnan(F.col(c).cast("double")), F.lit(False)).alias("passed")) for g, (c, op, v) in rules.items()]
    return summary.select(F.inline(F.array(*made)))


