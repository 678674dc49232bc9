"""Prototypes, decisions, metrics, attributions: queries and their SQL.

Embeddings of labels 0 to 7 are the known classes, 8 and 9 the unknown ones.
Scores are rounded to nine digits before they are ordered or counted, so that
both engines order them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators import baselines, explain, metrics, prototypes
from flowmill.operators.ranking import hash_order_sql, mixed_sql, uniform_sql
from flowmill.sources.tables import flows_events, table

DIM, KNOWN, MARGIN, TAU = 64, 8, 0.2, 0.1


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("z"))


def _bank(e: DataFrame, known: int = KNOWN) -> DataFrame:
    return prototypes.class_means(e.filter(F.col("y") < known), "y", "z", DIM)


def _evidence(spark: SparkSession, d: str, known: int = KNOWN) -> DataFrame:
    e = _emb(spark, d)
    return prototypes.decide(prototypes.evidence(prototypes.cosines(e, _bank(e, known), "z"), MARGIN, TAU), 0.05, 0.0005)


def _scored(spark: SparkSession, d: str, known: int = KNOWN) -> DataFrame:
    s = _evidence(spark, d, known)
    return s.select("vec_id", "y", "predicted", "decision", "cos", "classes", "p", F.round(F.array_max("p"), 9).alias("conf"), F.round("vacuity", 9).alias("vac"), F.round("evidence_total", 9).alias("et"), F.round("gap", 9).alias("gap"))



def _w():
    return F.col("predicted") != F.col("y")


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def proto_bank(spark: SparkSession, d: str) -> DataFrame:
    return _bank(_emb(spark, d)).select("class_id", F.posexplode("proto").alias("i", "v")).select("class_id", "i", F.round("v", 6).alias("v"))


def cosine_top2(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    two = vec.top_two(F.col("cos"))
    return s.select("vec_id", F.round(two[0], 6).alias("first"), F.round(two[1], 6).alias("second"))


def evidence_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", "predicted", "decision", F.round("et", 6).alias("evidence"), F.round("vac", 6).alias("vacuity"), F.round("gap", 6).alias("gap"))


def softmax_verdict(spark: SparkSession, d: str) -> DataFrame:
    s = prototypes.softmax_head(_scored(spark, d), 0.1)
    return s.select("vec_id", F.round(F.array_max("p"), 6).alias("p"), F.element_at("classes", vec.argmax(F.col("p")) + 1).alias("predicted"))


def distance_verdict(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.distance_head(_scored(spark, d), 0.7).select("vec_id", F.round("distance", 6).alias("distance"), "decision")


def register_class(spark: SparkSession, d: str) -> DataFrame:
    """Scores before and after class 8 is registered: old cosines do not move."""
    e = _emb(spark, d)
    old = _bank(e)
    new = prototypes.register_class(old, e.filter("y = 8"), "z", 8, DIM)
    a = prototypes.cosines(e, old, "z").select("vec_id", "y", F.array_max("cos").alias("before"))
    b = prototypes.cosines(e, new, "z").select("vec_id", F.array_max("cos").alias("after"), F.element_at("cos", 9).alias("to_new"))
    return a.join(b, "vec_id").select("vec_id", "y", *[F.round(c, 6).alias(c) for c in ("before", "after", "to_new")])


def ema_drift(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    old = _bank(e)
    new = prototypes.drift(old, e.withColumn("y", F.when(F.col("y") == 0, 1).otherwise(F.col("y"))).filter("y = 1"), "y", "z", DIM, 0.9)
    j = old.join(new.select("class_id", F.col("proto").alias("q")), "class_id")
    return j.select("class_id", F.round(1 - vec.dot(F.col("proto"), F.col("q")), 6).alias("moved"))


def sub_prototypes(spark: SparkSession, d: str) -> DataFrame:
    bank = prototypes.sub_prototypes(_emb(spark, d), "y", "z", DIM, 2)
    return bank.select("class_id", "sub_id", F.size("proto").alias("dim"), F.round(vec.norm(F.col("proto")), 6).alias("norm"))


def diversity_penalty(spark: SparkSession, d: str) -> DataFrame:
    return prototypes.diversity_penalty(prototypes.sub_prototypes(_emb(spark, d), "y", "z", DIM, 2))


def proto_allocation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "nf_ton_iot_v3").groupBy("Attack").agg(F.count(F.lit(1)).alias("n"))
    return prototypes.allocation(c, "Attack", large=1000)


def mixup_unknowns(spark: SparkSession, d: str) -> DataFrame:
    m = prototypes.mixed_unknowns(_emb(spark, d), "vec_id", "y", "z")
    return m.select("vec_id", "partner", F.round("mu", 6).alias("mu"), F.round("nearest", 6).alias("nearest"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_scored(spark, d, 10), "y", "predicted")


def per_class_f1(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.per_class(confusion_matrix(spark, d)), "precision", "recall", "f1", digits=9)


def closed_set_f1(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.closed_set(confusion_matrix(spark, d)), "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "mcc", digits=9)


def tier_f1(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.tier_f1(metrics.per_class(confusion_matrix(spark, d)), (("head", 54), ("body", 50), ("tail", 47)))
    return _r(t, "macro_f1", digits=9)


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, 10).select("y", F.posexplode("cos").alias("c", "s")).select("y", "c", F.round("s", 9).alias("s"))
    return metrics.pr_auc(s, "s", F.col("y") == F.col("c"), ["c"]).select("c", F.round("pr_auc", 6).alias("pr_auc"), "n_pos")


def auroc_known_unknown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d), "vac", F.col("y") >= KNOWN).select(F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")


def unknown_tpr_fpr(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.unknown_rates(_scored(spark, d), F.col("y") >= KNOWN, F.col("decision") == -1), "unknown_tpr", "unknown_fpr", digits=9)


def openness(spark: SparkSession, d: str) -> DataFrame:
    c = _emb(spark, d).agg(F.countDistinct(F.when(F.col("y") < KNOWN, F.col("y"))).alias("a"), F.countDistinct("y").alias("b"))
    return c.select(F.round(metrics.openness(F.col("a"), F.col("b"), F.col("a")), 9).alias("openness"))


def open_set_report(spark: SparkSession, d: str) -> DataFrame:
    """Known rows' F1, unknown rates and AUROC in one row."""
    s = _scored(spark, d)
    known = metrics.closed_set(metrics.confusion(s.filter(F.col("y") < KNOWN), "y", "predicted")).select("macro_f1").scalar()
    auc = metrics.roc_auc(s, "vac", F.col("y") >= KNOWN).select("auroc").scalar()
    u = metrics.unknown_rates(s, F.col("y") >= KNOWN, F.col("decision") == -1)
    return u.select(F.round(known, 9).alias("known_macro_f1"), F.round(auc, 9).alias("auroc"), F.round("unknown_tpr", 9).alias("unknown_tpr"), F.round("unknown_fpr", 9).alias("unknown_fpr"))


def ece_equal_mass(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.calibration_error(metrics.equal_mass_bins(_scored(spark, d, 10), "conf", "vec_id", ~_w())), "ece", "mce", digits=8)


def ece_equal_width(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.calibration_error(metrics.equal_width_bins(_scored(spark, d, 10), "conf", ~_w())), "ece", "mce", digits=8)


def reliability(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.equal_mass_bins(_scored(spark, d, 10), "conf", "vec_id", ~_w()), "conf", "acc", digits=8)


def brier(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, 10).agg(F.round(metrics.brier(F.col("p"), F.col("y")), 8).alias("brier"))


def nll(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, 10).agg(F.round(metrics.nll(F.element_at("p", F.col("y") + 1)), 8).alias("nll"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.risk_coverage(_scored(spark, d, 10), "vac", "vec_id", _w(), 50)


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _r(_curve(spark, d), "coverage", "risk", "threshold", digits=8)


def aurc(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.area_under_risk(_curve(spark, d)), "aurc", "e_aurc", "risk_at_90", digits=8)


def calibration_suite(spark: SparkSession, d: str) -> DataFrame:
    """All calibration figures in one row."""
    s = _scored(spark, d, 10)
    return _r(metrics.calibration_report(s, "conf", "vec_id", ~_w(), F.col("p"), F.col("y")), "brier", "nll", "mass_ece", "mass_mce", "width_ece", "width_mce", digits=8)


def selective_suite(spark: SparkSession, d: str) -> DataFrame:
    """All figures of selective prediction in one row, with the 2 % deferral point."""
    s = metrics.selective_report(_scored(spark, d, 10), "vac", "vec_id", _w(), 50)
    return _r(s, "aurc", "e_aurc", "risk_at_90", "risk_at_deferral", "full_risk", "deferral_precision", digits=8)


def latency_recent(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over the latest 3,000 events only."""
    e = metrics.recent(flows_events(spark, d), [F.desc("ms"), F.desc("flow_id")], 3000)
    return _r(metrics.latency_percentiles(e, "bytes"), "p50", "p90", "p95", "p99", "mean", "max", digits=6)


def register_sub_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """The bank after class 8 is registered with two prototypes."""
    e = _emb(spark, d)
    new = prototypes.register_class(_bank(e), e.filter("y = 8"), "z", 8, DIM, 2)
    return new.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_sub"), F.round(F.max(F.abs(vec.norm(F.col("proto")) - 1)), 6).alias("off_unit"))


def deferral_precision(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.deferral_precision(_scored(spark, d, 10), F.col("decision") == -2, _w()), "deferral_precision", digits=9)


def forgetting_bwt(spark: SparkSession, d: str) -> DataFrame:
    """F1 of classes 0 to 7 before and after classes 8 and 9 are registered."""
    keep = lambda k: metrics.per_class(metrics.confusion(_scored(spark, d, k).filter(F.col("y") < KNOWN), "y", "predicted")).filter(F.col("cls") < KNOWN)
    return _r(metrics.forgetting(keep(KNOWN), keep(10)), "forgetting", "backward_transfer", digits=9)


def few_shot(spark: SparkSession, d: str) -> DataFrame:
    """Recall of classes 8 and 9 after registration."""
    s = _scored(spark, d, 10).filter(F.col("y") >= KNOWN)
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~_w()).cast("double")), 9).alias("recall"))


RESAMPLES = 1000


def _boot(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, 10)
    return metrics.bootstrap_means(s, {"a": (~_w()).cast("double"), "b": (F.col("conf") > 0.11).cast("double")}, "vec_id", RESAMPLES)


def bootstrap_resamples(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each resample."""
    return _r(_boot(spark, d), "a", "b", digits=9)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.interval(_boot(spark, d), "a"), "mean", "std", "ci_lower", "ci_upper", digits=8)


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = _boot(spark, d).withColumn("diff", F.col("a") - F.col("b"))
    return _r(metrics.interval(b, "diff"), "mean", "std", "ci_lower", "ci_upper", digits=8)


def paired_bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference in macro F1 of two models on the same draws: the
    prediction, and the one that names class 0 where it is not confident."""
    s = _scored(spark, d, 10).select("vec_id", "y", "predicted", F.when(F.col("conf") > 0.11, F.col("predicted")).otherwise(0).alias("other"))
    c = metrics.bootstrap_counts(s, ["y", "predicted", "other"], "vec_id", 200)
    a, b = metrics.macro_f1(c, ["resample"], "y", "predicted"), metrics.macro_f1(c, ["resample"], "y", "other").withColumnRenamed("macro_f1", "b")
    return _r(metrics.interval(a.join(b, "resample").withColumn("diff", F.col("macro_f1") - F.col("b")), "diff"), "mean", "std", "ci_lower", "ci_upper", digits=8)


def over_seeds(spark: SparkSession, d: str) -> DataFrame:
    e = flows_events(spark, d)
    return _r(metrics.over_seeds(e, "dst", "bytes").withColumnRenamed("dst", "metric"), "mean", "std", digits=6)


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.latency_percentiles(flows_events(spark, d), "bytes", ["dst"]), "p50", "p90", "p95", "p99", "mean", "max", digits=6)


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).filter(F.col("y") < KNOWN)
    return metrics.threshold(s, "et", 0.05).select(F.round("theta", 8).alias("theta_unknown"), F.lit(0.05).alias("q")).join(metrics.threshold(s, "gap", 0.02).select(F.round("theta", 8).alias("theta_defer"), F.lit(0.05).alias("q")), "q").drop("q")


def nmi_ari(spark: SparkSession, d: str) -> DataFrame:
    return _r(metrics.clusters(_scored(spark, d, 10), "y", "predicted"), "purity", "nmi", "ari", digits=9)


def kmeans_purity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clusters(baselines.kmeans(_emb(spark, d), "z", 10), "y", "cluster")


def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    """The class that most rows of each unknown class come nearest to."""
    c = _scored(spark, d).filter(F.col("y") >= KNOWN).groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("y").agg(F.max_by("predicted", F.struct("n", -F.col("predicted"))).alias("nearest"), F.max("n").alias("n"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    summary = s.agg(F.avg(F.when(F.col("y") < KNOWN, F.col("vac"))).alias("known_vacuity"), F.avg(F.when(F.col("y") >= KNOWN, F.col("vac"))).alias("unknown_vacuity"), F.avg((~_w()).cast("double")).alias("accuracy"))
    g = metrics.gates(summary, {"capacity": ("accuracy", ">=", 0.99), "evidence": ("known_vacuity", "<=", 0.7), "carving": ("unknown_vacuity", ">=", 0.5)})
    return _r(g, "value")


def energy_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", F.round(baselines.energy(F.transform("cos", lambda c: c * 10)), 6).alias("energy"))


def odin_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", F.round(baselines.odin(F.transform("cos", lambda c: c * 10), 10.0), 6).alias("odin"))


def openmax(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("vec_id", "y", F.transform("cos", lambda c: c * 10).alias("logits"))
    return baselines.openmax_score(s, baselines.openmax_fit(s.filter(F.col("y") < KNOWN), "y", "logits", KNOWN), "logits").select("vec_id", "unknown_score")


# --- attributions ------------------------------------------------------------------


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the prototype of its predicted class."""
    s = _evidence(spark, d).select("vec_id", "z", "predicted")
    return s.join(F.broadcast(prototypes.check_bank(_bank(_emb(spark, d)))), F.col("predicted") == F.col("class_id"))


def embed_attribution(spark: SparkSession, d: str) -> DataFrame:
    a = explain.attribution(F.col("z"), F.col("proto"), TAU)
    return _own(spark, d).select("vec_id", F.round(vec.total(a), 6).alias("total"), explain.top_k(a, 3).alias("top"), F.round(explain.completeness_gap(F.col("z"), F.col("proto"), TAU, MARGIN), 6).alias("gap")).select("vec_id", "total", F.col("top")[0].alias("top_1"), "gap")


def integrated_gradients(spark: SparkSession, d: str) -> DataFrame:
    """Their sum against the difference of scores, per vector."""
    o = _own(spark, d).withColumn("base", F.transform("proto", lambda p: p * 0.5 + 0.01))
    ig = explain.integrated_gradients(F.col("z"), F.col("base"), F.col("proto"), TAU)
    score = lambda v: vec.cosine(v, F.col("proto")) / TAU
    return o.select("vec_id", vec.total(ig).alias("attributed"), (score(F.col("z")) - score(F.col("base"))).alias("difference"))


def fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Loss of cosine when the 8 top dimensions are removed, or alone kept."""
    o = _own(spark, d).withColumn("zero", F.transform("z", lambda x: F.lit(0.0))).withColumn("top", explain.top_k(explain.attribution(F.col("z"), F.col("proto"), TAU), 8))
    part = lambda keep: vec.dot(explain.masked(F.col("z"), F.col("top"), F.col("zero"), keep), F.col("proto"))
    whole = vec.dot(F.col("z"), F.col("proto"))
    return o.select("vec_id", F.round(whole - part(False), 6).alias("fidelity_plus"), F.round(whole - part(True), 6).alias("fidelity_minus"), F.lit(1 - 8 / DIM).alias("sparsity"))


def stability_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement of attributions towards the prototypes of classes 0, 1 and 2, as its SQL has it."""
    return _stability(spark, d, 3)


def stability_spearman_known(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement of attributions towards the prototypes of all known classes."""
    return _stability(spark, d, KNOWN)


def _stability(spark: SparkSession, d: str, known: int) -> DataFrame:
    e = _emb(spark, d)
    bank = F.broadcast(prototypes.check_bank(_bank(e, known)))
    pairs = e.withColumn("class_id", F.explode(F.array(*[F.lit(i) for i in range(known)]))).join(bank, "class_id")
    a = pairs.select("vec_id", "class_id", F.transform(explain.attribution(F.col("z"), F.col("proto"), TAU), lambda x: F.round(x, 9)).alias("a"))
    return explain.stability(a, "vec_id", "class_id", "a").select("vec_id", F.round("stability", 6).alias("stability"))


def counterfactual_necessity(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions to remove until a vector's score halves."""
    a = explain.attribution(F.col("z"), F.col("proto"), 1.0)
    o = _own(spark, d).select("vec_id", (vec.dot(F.col("z"), F.col("proto")) / 2).alias("half"), F.posexplode(a).alias("i", "c")).withColumn("c", F.round("c", 9))
    halves = o.groupBy("vec_id").agg(F.round(F.sum("c") / 2, 9).alias("need"))
    o = o.join(halves, "vec_id")
    r = explain.counterfactual(o.withColumn("g", F.struct("vec_id", "need")), "g", "c", "i", F.col("g.need"))
    return r.select("g.vec_id", "needed", "flips")


def necessity_rate(spark: SparkSession, d: str) -> DataFrame:
    return counterfactual_necessity(spark, d).agg(F.round(F.avg(F.col("flips").cast("double")), 9).alias("necessity"), F.round(F.avg("needed"), 6).alias("mean_needed"))


def kernel_shap(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    p = _bank(e).filter("class_id = 0").first()["proto"]
    return explain.kernel_shap(e, "z", [0.05] * DIM, list(p)).select("vec_id", F.round(vec.total(F.col("shap")), 6).alias("total"))


def triage_report(spark: SparkSession, d: str) -> DataFrame:
    t = explain.triage(_evidence(spark, d))
    return t.select("vec_id", F.col("nearest")[0]["class_id"].alias("first"), F.col("nearest")[1]["class_id"].alias("second"), F.round(F.col("nearest")[0]["cosine"], 6).alias("cosine"))


def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    u = vec.unit(F.col("z"))
    sm = vec.softmax(F.transform("z", lambda x: x.cast("double")))
    return _emb(spark, d).select("vec_id", F.round(vec.norm(F.col("z")), 6).alias("norm"), F.round(vec.dot(u, u), 6).alias("self"), F.round(F.array_max(sm), 6).alias("softmax_top"), vec.argmax(sm).alias("argmax"))


QUERIES = {f.__name__: f for f in (
    proto_bank, cosine_top2, evidence_verdict, softmax_verdict, distance_verdict, register_class, ema_drift, sub_prototypes, diversity_penalty, proto_allocation, mixup_unknowns,
    confusion_matrix, per_class_f1, closed_set_f1, tier_f1, pr_auc, auroc_known_unknown, unknown_tpr_fpr, openness, open_set_report, ece_equal_mass, ece_equal_width, reliability, brier, nll,
    calibration_suite, selective_suite, latency_recent, register_sub_prototypes, risk_coverage, aurc, deferral_precision, forgetting_bwt, few_shot, bootstrap_resamples, bootstrap_ci, paired_bootstrap, paired_bootstrap_f1, over_seeds, latency_percentiles, thresholds, nmi_ari, kmeans_purity, nearest_prototype, gates,
    energy_score, odin_score, openmax, embed_attribution, integrated_gradients, fidelity, stability_spearman, stability_spearman_known, counterfactual_necessity, necessity_rate, kernel_shap, triage_report, vector_functions,
)}

# --- SQL ------------------------------------------------------------------------------


def _chain(known: int = KNOWN) -> str:
    """Common tables: e (vectors), p (prototypes), cs (cosines), sc (scores per row)."""
    return f"""e AS (SELECT vec_id, label y, embedding::DOUBLE[] z FROM embeddings), dm AS (SELECT y, unnest(z) v, generate_subscripts(z, 1) i FROM e),
    mn AS (SELECT y, i, avg(v) v FROM dm WHERE y < {known} GROUP BY 1, 2), p AS (SELECT y c, list(v ORDER BY i) raw, sqrt(sum(v * v)) n FROM mn GROUP BY 1), pr AS (SELECT c, list_transform(raw, lambda x: x / n) pv FROM p),
    cs AS (SELECT vec_id, y, c, list_dot_product(z, pv) / sqrt(list_dot_product(z, z)) s FROM e CROSS JOIN pr),
    ev AS (SELECT *, exp(greatest(least((s - 1 + {MARGIN}) / {TAU}, 15), -15)) ee FROM cs), tt AS (SELECT vec_id, sum(ee) et, count(*) k FROM ev GROUP BY 1),
    pp AS (SELECT ev.*, (ee + 1) / (et + k) pc, et, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) r FROM ev JOIN tt USING (vec_id)),
    s0 AS (SELECT vec_id, any_value(y) y, max(c) FILTER (r = 1) predicted, max(s) FILTER (r = 1) s1, max(s) FILTER (r = 2) s2, max(pc) FILTER (r = 1) p1, max(pc) FILTER (r = 2) p2, any_value(k / (et + k)) v, any_value(et) et0 FROM pp GROUP BY 1),
    sc AS (SELECT vec_id, y, predicted, s1, s2, p1, round(p1, 9) conf, round(v, 9) vac, round(et0, 9) et, round(p1 - p2, 9) gap, CASE WHEN et0 < 0.05 THEN -1 WHEN p1 - p2 < 0.0005 THEN -2 ELSE predicted END decision, (predicted <> y)::INT w FROM s0)"""


_K, _A = f"WITH {_chain()}", f"WITH {_chain(10)}"
_CONF = "cf AS (SELECT y, predicted pred, count(*) n FROM sc GROUP BY 1, 2)"


def _per(conf: str, name: str = "pc2") -> str:
    return f"""{name} AS (SELECT coalesce(a.y, b.pred) cls, coalesce(support, 0)::BIGINT support, coalesce(predicted, 0)::BIGINT predicted, coalesce(tp, 0)::BIGINT tp, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) recall,
    coalesce(2 * tp / nullif(coalesce(support, 0) + coalesce(predicted, 0), 0), 0) f1 FROM (SELECT y, sum(n) support, coalesce(sum(n) FILTER (y = pred), 0) tp FROM {conf} GROUP BY 1) a FULL JOIN (SELECT pred, sum(n) predicted FROM {conf} GROUP BY 1) b ON a.y = b.pred)"""


_CLOSED = """SELECT sum(support)::BIGINT n, round(sum(tp) / sum(support), 9) accuracy, round(avg(f1), 9) macro_f1, round(sum(f1 * support) / sum(support), 9) weighted_f1, round(avg(recall) FILTER (support > 0), 9) balanced_accuracy,
    round((sum(tp)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support)) / sqrt((pow(sum(support), 2) - sum(pow(predicted, 2))) * (pow(sum(support), 2) - sum(pow(support, 2)))), 9) mcc FROM pc2"""
_AUC = f"SELECT (sum(rk) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)) auroc, max(np) n_pos, max(nn) n_neg FROM (SELECT y >= {KNOWN} u, rank() OVER (ORDER BY vac) + (count(*) OVER (PARTITION BY vac) - 1) / 2.0 rk, count(*) FILTER (y >= {KNOWN}) OVER () np, count(*) FILTER (y < {KNOWN}) OVER () nn FROM sc) WHERE u"
_RATES = f"SELECT count(*) FILTER (y >= {KNOWN}) n_unknown, count(*) FILTER (y < {KNOWN}) n_known, round(count(*) FILTER (y >= {KNOWN} AND decision = -1) / count(*) FILTER (y >= {KNOWN}), 9) unknown_tpr, round(count(*) FILTER (y < {KNOWN} AND decision = -1) / count(*) FILTER (y < {KNOWN}), 9) unknown_fpr FROM sc"
_EQM = "bn AS (SELECT (" + " + ".join(f"(r > round_even({float(i)}::DOUBLE * n / 15.0::DOUBLE, 0))::INT" for i in range(1, 15)) + ") bin, count(*) n, avg(conf) conf, avg(1 - w) acc FROM (SELECT *, row_number() OVER (ORDER BY conf, vec_id) r, count(*) OVER () n FROM sc) GROUP BY 1)"
_EQW = "bn AS (SELECT greatest(least(floor(conf * 15), 14), 0) bin, count(*) n, avg(conf) conf, avg(1 - w) acc FROM sc GROUP BY 1)"
_ECE = "SELECT round(sum(n * abs(acc - conf)) / sum(n), 8) ece, round(max(abs(acc - conf)), 8) mce FROM bn"
_CURVE = """rc AS (SELECT i, 1 - i / 49.0::DOUBLE coverage, r kept, rw / r risk, vac threshold FROM (SELECT *, row_number() OVER (ORDER BY vac, vec_id) r, sum(w) OVER (ORDER BY vac, vec_id ROWS UNBOUNDED PRECEDING) rw, count(*) OVER () n FROM sc) x
    JOIN range(50) g(i) ON r = greatest(round_even((1 - i / 49.0::DOUBLE) * n, 0), 1))"""
_WT = " + ".join(f"(u >= {c!r})::INT" for c in metrics._POISSON)
_DRAW = lambda n: f"""dr AS (SELECT b, 1 + {mixed_sql("b", "'a'", seed=5)} % 2147483646 da, {mixed_sql("b", "'c'", seed=5)} % 2147483647 dc FROM range(1, {n + 1}) t(b)),
    wt AS (SELECT *, {_WT} wt FROM (SELECT sc.*, b, ((({mixed_sql("vec_id", seed=5)} % 2147483647) * da + dc) % 2147483647) / 2147483647.0::DOUBLE u FROM sc CROSS JOIN dr))"""  # noqa: E731
_BOOT = f"{_DRAW(RESAMPLES)}, bt AS (SELECT b, sum(wt) n, coalesce(sum(wt * (1 - w)) / nullif(sum(wt), 0), 0) a, coalesce(sum(wt * (conf > 0.11)::INT) / nullif(sum(wt), 0), 0) bb FROM wt GROUP BY 1)"
_ci = lambda e: f"SELECT round(avg({e}), 8) mean, round(stddev_samp({e}), 8) std, round(quantile_cont({e}, {(1 - 0.95) / 2!r}), 8) ci_lower, round(quantile_cont({e}, {1 - (1 - 0.95) / 2!r}), 8) ci_upper FROM bt"
_F1 = lambda p, n: f"""{n} AS (SELECT b, avg(coalesce(2 * tp / nullif(coalesce(support, 0) + coalesce(made, 0), 0), 0)) f FROM (SELECT b, y k, sum(wt) support, coalesce(sum(wt) FILTER (y = {p}), 0) tp FROM pv GROUP BY 1, 2) FULL JOIN (SELECT b, {p} k, sum(wt) made FROM pv GROUP BY 1, 2) USING (b, k) GROUP BY 1)"""
_OWN = "ow AS (SELECT vec_id, z, pv FROM s0 JOIN e USING (vec_id) JOIN pr ON pr.c = s0.predicted), att AS (SELECT vec_id, unnest(z) zz, unnest(pv) pz, generate_subscripts(z, 1) i FROM ow)"

SQL = {
    "proto_bank": f"{_K} SELECT c::INT class_id, (generate_subscripts(pv, 1) - 1)::INT i, round(unnest(pv), 6) v FROM pr",
    "cosine_top2": f"{_K} SELECT vec_id, round(s1, 6) AS \"first\", round(s2, 6) AS second FROM sc",
    "evidence_verdict": f"{_K} SELECT vec_id, predicted, decision, round(et, 6) evidence, round(vac, 6) vacuity, round(gap, 6) gap FROM sc",
    "softmax_verdict": f"{_K} SELECT vec_id, round(max(x) / sum(x), 6) p, max(c) FILTER (r = 1) predicted FROM (SELECT *, exp(s / 0.1) x FROM pp) GROUP BY 1",
    "distance_verdict": f"{_K} SELECT vec_id, round(1 - s1, 6) distance, CASE WHEN 1 - s1 > 0.7 THEN -1 ELSE predicted END decision FROM sc",
    "register_class": f"WITH {_chain(9)} SELECT vec_id, any_value(y) y, round(max(s) FILTER (c < 8), 6) AS before, round(max(s), 6) AS after, round(max(s) FILTER (c = 8), 6) to_new FROM cs GROUP BY 1",
    "ema_drift": f"""{_K}, bm AS (SELECT i, avg(v) v FROM dm WHERE y IN (0, 1) GROUP BY 1), bu AS (SELECT list(v / nn ORDER BY i) m FROM bm, (SELECT sqrt(sum(v * v)) nn FROM bm)),
        q AS (SELECT c, pv, list_transform(list_zip(pv, m), lambda t: t[1] * 0.9 + t[2] * 0.1) qv FROM pr, bu) SELECT c::INT class_id, CASE WHEN c = 1 THEN round(1 - list_dot_product(pv, qv) / sqrt(list_dot_product(qv, qv)), 6) ELSE round(1 - list_dot_product(pv, pv), 6) END moved FROM q""",
    "proto_allocation": "SELECT Attack, count(*) n, CASE WHEN lower(Attack) = 'benign' THEN 4 WHEN count(*) >= 1000 THEN 2 ELSE 1 END n_sub FROM nf_ton_iot_v3 GROUP BY 1",
    "mixup_unknowns": f"""WITH e AS (SELECT vec_id, label y, embedding::DOUBLE[] z, row_number() OVER (ORDER BY {hash_order_sql("vec_id", 13)}, vec_id) r FROM embeddings),
        m AS (SELECT a.vec_id, b.vec_id partner, 0.35::DOUBLE + {uniform_sql("a.vec_id", seed=17)} * (0.65::DOUBLE - 0.35::DOUBLE) mu, a.z za, b.z zb FROM e a JOIN e b ON b.r = a.r + 1 AND a.y <> b.y),
        x AS (SELECT *, list_transform(list_zip(za, zb), lambda t: t[1] * mu + t[2] * (1 - mu)) x FROM m), c AS (SELECT *, greatest(list_cosine_similarity(x, za), list_cosine_similarity(x, zb)) near FROM x)
        SELECT vec_id, partner, round(mu, 6) mu, round(near, 6) nearest FROM c WHERE near <= 0.9""",
    "confusion_matrix": f"{_A} SELECT y, predicted pred, count(*) n FROM sc GROUP BY 1, 2",
    "per_class_f1": f"{_A}, {_CONF}, {_per('cf')} SELECT cls, support, predicted, tp, round(\"precision\", 9) AS \"precision\", round(recall, 9) recall, round(f1, 9) f1 FROM pc2",
    "closed_set_f1": f"{_A}, {_CONF}, {_per('cf')} {_CLOSED}",
    "tier_f1": f"{_A}, {_CONF}, {_per('cf')} SELECT CASE WHEN support > 54 THEN 'head' WHEN support > 50 THEN 'body' WHEN support > 47 THEN 'tail' ELSE 'extreme' END tier, round(avg(f1), 9) macro_f1, count(*) n_classes FROM pc2 GROUP BY 1",
    "pr_auc": f"""{_A}, x AS (SELECT c, round(s, 9) s, count(*) FILTER (y = c) a, count(*) FILTER (y <> c) b FROM cs GROUP BY 1, 2), y AS (SELECT *, sum(a) OVER w tp, sum(b) OVER w fp, sum(a) OVER (PARTITION BY c) P FROM x WINDOW w AS (PARTITION BY c ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
        SELECT c::INT c, round(sum(a / P * (tp / (tp + fp) + CASE WHEN tp - a + fp - b > 0 THEN (tp - a) / (tp - a + fp - b) ELSE 1.0 END) / 2), 6) pr_auc, max(P)::BIGINT n_pos FROM y GROUP BY 1""",
    "auroc_known_unknown": f"{_K} SELECT round(auroc, 9) auroc, n_pos, n_neg FROM ({_AUC})",
    "unknown_tpr_fpr": f"{_K} {_RATES}",
    "openness": f"SELECT round(1 - sqrt(least(2 * a / (b + a), 1)), 9) openness FROM (SELECT count(DISTINCT label) FILTER (label < {KNOWN}) a, count(DISTINCT label) b FROM embeddings)",
    "open_set_report": f"{_K}, cf AS (SELECT y, predicted pred, count(*) n FROM sc WHERE y < {KNOWN} GROUP BY 1, 2), {_per('cf')} SELECT (SELECT round(avg(f1), 9) FROM pc2) known_macro_f1, (SELECT round(auroc, 9) FROM ({_AUC})) auroc, unknown_tpr, unknown_fpr FROM ({_RATES})",
    "ece_equal_mass": f"{_A}, {_EQM} {_ECE}", "ece_equal_width": f"{_A}, {_EQW} {_ECE}",
    "reliability": f"{_A}, {_EQM} SELECT bin, n, round(conf, 8) conf, round(acc, 8) acc FROM bn",
    "brier": f"{_A} SELECT round(avg(b), 8) brier FROM (SELECT vec_id, sum(pow(pc - (c = y)::INT, 2)) b FROM pp GROUP BY 1)",
    "nll": f"{_A} SELECT round(avg(-ln(pc)), 8) nll FROM pp WHERE c = y",
    "risk_coverage": f"{_A}, {_CURVE} SELECT i, round(coverage, 8) coverage, kept, round(risk, 8) risk, round(threshold, 8) threshold FROM rc",
    "aurc": f"""{_A}, {_CURVE}, st AS (SELECT *, lag(coverage) OVER o c0, lag(risk) OVER o r0, first_value(risk) OVER (ORDER BY i) fr FROM rc WINDOW o AS (ORDER BY coverage)) SELECT round(sum((coverage - c0) * (risk + r0) / 2), 8) aurc,
        round(sum((coverage - c0) * (risk + r0) / 2) - sum((coverage - c0) * fr * (1 - coverage + 1 - c0) / 2), 8) e_aurc, (SELECT round(risk, 8) FROM rc ORDER BY round(abs(coverage - 0.9), 9), coverage DESC LIMIT 1) risk_at_90 FROM st""",
    "calibration_suite": f"""{_A}, {_EQM}, {_EQW.replace("bn AS", "bw AS")} SELECT (SELECT round(avg(b), 8) FROM (SELECT sum(pow(pc - (c = y)::INT, 2)) b FROM pp GROUP BY vec_id)) brier, (SELECT round(avg(-ln(pc)), 8) FROM pp WHERE c = y) nll,
        {", ".join(f"(SELECT round(sum(n * abs(acc - conf)) / sum(n), 8) FROM {t}) {m}_ece, (SELECT round(max(abs(acc - conf)), 8) FROM {t}) {m}_mce" for m, t in (("mass", "bn"), ("width", "bw")))}""",
    "selective_suite": f"""{_A}, {_CURVE}, st AS (SELECT *, lag(coverage) OVER o c0, lag(risk) OVER o r0, first_value(risk) OVER (ORDER BY i) fr FROM rc WINDOW o AS (ORDER BY coverage)), ct AS (SELECT quantile_cont(vac, 0.98) q FROM sc)
        SELECT round(sum((coverage - c0) * (risk + r0) / 2), 8) aurc, round(sum((coverage - c0) * (risk + r0) / 2) - sum((coverage - c0) * fr * (1 - coverage + 1 - c0) / 2), 8) e_aurc,
        {", ".join(f"(SELECT round(risk, 8) FROM rc ORDER BY round(abs(coverage - {c}), 9), coverage DESC LIMIT 1) {n}" for c, n in ((0.9, "risk_at_90"), (0.98, "risk_at_deferral")))}, round(any_value(fr), 8) full_risk,
        (SELECT count(*) FROM sc, ct WHERE vac > q) n_deferred, (SELECT round(coalesce(avg(w), 1), 8) FROM sc, ct WHERE vac > q) deferral_precision FROM st""",
    "latency_recent": "WITH l AS (SELECT value v FROM events ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 3000) SELECT " + ", ".join(f"round(quantile_cont(v, {q}), 6) p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", round(avg(v), 6) mean, round(max(v), 6) AS max, count(v) n FROM l",
    "deferral_precision": f"{_A} SELECT count(*) FILTER (decision = -2) n_deferred, round(coalesce(count(*) FILTER (decision = -2 AND w = 1) / nullif(count(*) FILTER (decision = -2), 0), 1), 9) deferral_precision FROM sc",
    "few_shot": f"{_A} SELECT y, count(*) n, round(avg(1 - w), 9) recall FROM sc WHERE y >= {KNOWN} GROUP BY 1",
    "bootstrap_resamples": f"{_A}, {_BOOT} SELECT b::INT resample, n::BIGINT n, round(a, 9) a, round(bb, 9) b FROM bt",
    "paired_bootstrap_f1": f"{_A}, {_DRAW(200)}, pv AS (SELECT b, wt, y, predicted, CASE WHEN conf > 0.11 THEN predicted ELSE 0 END other FROM wt WHERE wt > 0), {_F1('predicted', 'fa')}, {_F1('other', 'fb')}, bt AS (SELECT fa.f - fb.f x FROM fa JOIN fb USING (b)) {_ci('x')}",
    "bootstrap_ci": f"{_A}, {_BOOT} {_ci('a')}", "paired_bootstrap": f"{_A}, {_BOOT} {_ci('(a - bb)')}",
    "over_seeds": "SELECT event_type metric, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, count(value) n FROM events GROUP BY 1",
    "latency_percentiles": "SELECT event_type dst, " + ", ".join(f"round(quantile_cont(value, {q}), 6) p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", round(avg(value), 6) mean, round(max(value), 6) AS max, count(value) n FROM events GROUP BY 1",
    "thresholds": f"{_K} SELECT round(quantile_cont(et, 0.05), 8) theta_unknown, round(quantile_cont(gap, 0.02), 8) theta_defer FROM sc WHERE y < {KNOWN}",
    "nmi_ari": f"""{_A}, {_CONF}, a AS (SELECT y, sum(n)::DOUBLE a FROM cf GROUP BY 1), b AS (SELECT pred, sum(n)::DOUBLE b, max(n) m FROM cf GROUP BY 1), N AS (SELECT sum(n)::DOUBLE nn FROM cf),
        x AS (SELECT (SELECT sum(m / nn) FROM b, N) purity, (SELECT sum(n / nn * ln(nn * n / (a * b))) FROM cf JOIN a USING (y) JOIN b USING (pred), N) mi, (SELECT -sum(a / nn * ln(a / nn)) FROM a, N) h1, (SELECT -sum(b / nn * ln(b / nn)) FROM b, N) h2,
          (SELECT sum(n * (n - 1) / 2) FROM cf) s, (SELECT sum(a * (a - 1) / 2) FROM a) s1, (SELECT sum(b * (b - 1) / 2) FROM b) s2, (SELECT nn * (nn - 1) / 2 FROM N) t)
        SELECT round(purity, 9) purity, round(2 * mi / (h1 + h2), 9) nmi, round((s - s1 * s2 / t) / ((s1 + s2) / 2 - s1 * s2 / t), 9) ari FROM x""",
    "nearest_prototype": f"{_K}, c AS (SELECT y, predicted, count(*) n FROM sc WHERE y >= {KNOWN} GROUP BY 1, 2) SELECT y, predicted nearest, n FROM c QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, predicted) = 1",
    "gates": f"""{_K}, g AS (SELECT avg(1 - w) a, avg(vac) FILTER (y < {KNOWN}) b, avg(vac) FILTER (y >= {KNOWN}) c FROM sc) SELECT 'capacity' gate, round(a, 6) AS "value", 0.99::DOUBLE AS "limit", a >= 0.99 passed FROM g
        UNION ALL SELECT 'evidence', round(b, 6), 0.7, b <= 0.7 FROM g UNION ALL SELECT 'carving', round(c, 6), 0.5, c >= 0.5 FROM g""",
    "energy_score": f"{_K} SELECT vec_id, round(-ln(sum(exp(s * 10))), 6) energy FROM cs GROUP BY 1",
    "odin_score": f"{_K} SELECT vec_id, round(1 - max(exp(s)) / sum(exp(s)), 6) odin FROM cs GROUP BY 1",
    "embed_attribution": f"""{_K}, {_OWN}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(zz * pz / {TAU}) DESC, i) r FROM att) SELECT vec_id, round(sum(zz * pz / {TAU}), 6) total, (max(i) FILTER (r = 1))::INT top_1, 0.0::DOUBLE gap FROM rk GROUP BY 1""",
    "fidelity": f"""{_K}, {_OWN}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(zz * pz / {TAU}) DESC, i) r FROM att) SELECT vec_id, round(sum(zz * pz) - coalesce(sum(zz * pz) FILTER (r > 8), 0), 6) fidelity_plus, round(sum(zz * pz) - sum(zz * pz) FILTER (r <= 8), 6) fidelity_minus, 0.875::DOUBLE sparsity FROM rk GROUP BY 1""",
    "stability_spearman": f"""WITH {_chain(3)}, a AS (SELECT vec_id, c, generate_subscripts(z, 1) i, unnest(z) zz, unnest(pv) pz FROM e CROSS JOIN pr), x AS (SELECT vec_id, c, i, round(zz * pz / {TAU}, 9) x FROM a),
        r AS (SELECT vec_id, c, i, rank() OVER (PARTITION BY vec_id, c ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, c, x) - 1) / 2.0 r FROM x),
        k AS (SELECT a.vec_id, a.c, b.c c2, corr(a.r, b.r) rho FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.i = b.i AND a.c < b.c GROUP BY 1, 2, 3) SELECT vec_id, round(avg(rho), 6) stability FROM k GROUP BY 1""",
    "triage_report": f"{_K}, u AS (SELECT vec_id FROM sc WHERE decision = -1) SELECT vec_id, max(c) FILTER (r = 1) AS \"first\", max(c) FILTER (r = 2) AS second, round(max(s) FILTER (r = 1), 6) cosine FROM pp JOIN u USING (vec_id) GROUP BY 1",
    "vector_functions": """WITH d AS (SELECT vec_id, unnest(embedding::DOUBLE[]) v, generate_subscripts(embedding, 1) i FROM embeddings) SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm, round(sum(v * v) / sum(v * v), 6) AS self, round(max(exp(v)) / sum(exp(v)), 6) softmax_top,
        (arg_min(i, (-v, i)) - 1)::INT AS argmax FROM d GROUP BY 1""",
}


def _necessity() -> str:
    return f"""{_K}, {_OWN}, ct AS (SELECT vec_id, i, round(zz * pz, 9) c FROM att), hv AS (SELECT vec_id, round(sum(c) / 2, 9) need, sum(c) t FROM ct GROUP BY 1),
        rn AS (SELECT ct.vec_id, need, row_number() OVER w k, round(t - sum(c) OVER (PARTITION BY ct.vec_id ORDER BY c DESC, i ROWS UNBOUNDED PRECEDING), 9) lf FROM ct JOIN hv USING (vec_id) WINDOW w AS (PARTITION BY ct.vec_id ORDER BY c DESC, i)),
        nd AS (SELECT vec_id, min(k) FILTER (lf < need) needed FROM rn GROUP BY 1)"""


def _forget() -> str:
    one = lambda k, t: f"{t} AS (WITH {_chain(k)}, cf AS (SELECT y, predicted pred, count(*) n FROM sc WHERE y < {KNOWN} GROUP BY 1, 2), {_per('cf')} SELECT cls, f1 FROM pc2 WHERE cls < {KNOWN})"
    return f"WITH {one(KNOWN, 'bf')}, {one(10, 'af')} SELECT round(max(greatest(bf.f1 - af.f1, 0)), 9) forgetting, round(avg(af.f1 - bf.f1), 9) backward_transfer FROM bf JOIN af USING (cls)"


SQL |= {
    "counterfactual_necessity": f"{_necessity()} SELECT vec_id, needed::INT needed, needed IS NOT NULL flips FROM nd",
    "necessity_rate": f"{_necessity()} SELECT round(avg((needed IS NOT NULL)::INT), 9) necessity, round(avg(needed), 6) mean_needed FROM nd",
    "forgetting_bwt": _forget(),
}
