"""Attacks and baseline models: queries and, where it can say them, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import label_key
from flowmill.operators import adversarial, baselines, clean, metrics, prototypes, splits
from flowmill.sources.tables import feature_columns, flows_events, table

T = "nf_cicids2018_v3"
DAY = 86_400_000
_JITTER = ["FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", *(f"{d}_IAT_{s}" for d in ("SRC_TO_DST", "DST_TO_SRC") for s in ("MIN", "MAX", "AVG", "STDDEV"))]


def inject_edges_budget(spark: SparkSession, d: str) -> DataFrame:
    """Edges injected before every purchase, for each budget."""
    e = flows_events(spark, d)
    out = adversarial.inject_edges(e.filter("dst = 'purchase'").select("flow_id", "ms", "src", "dst"), e.filter("dst = 'view'"), DAY)
    return out.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"), F.sum((F.col("is_injected")).cast("bigint")).alias("injected"))


def inject_context(spark: SparkSession, d: str) -> DataFrame:
    """Degree of each event type with injected context and without: targets stay as many."""
    e = flows_events(spark, d)
    inj = adversarial.inject_edges(e.filter("dst = 'purchase'").select("flow_id", "ms", "src", "dst"), e.filter("dst = 'view'"), DAY, (8,), "single_stratum")
    both = adversarial.with_injected(e, inj)
    return both.groupBy("dst").agg(F.sum((~F.col("is_injected")).cast("bigint")).alias("targets"), F.count(F.lit(1)).alias("context"))


def jitter_cost(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T).select("flow_id", *_JITTER)
    j = adversarial.jitter(t, "flow_id")
    return j.groupBy("sigma").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_change"), 6).alias("duration_change"), F.round(F.avg("rate_change"), 6).alias("rate_change"))


def feature_evasion(spark: SparkSession, d: str) -> DataFrame:
    """Flows pushed to a corner of each relative box, made feasible, by whether
    the header rule still holds."""
    cols = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS"]
    t = table(spark, d, T).select("flow_id", *cols)
    p = adversarial.perturb(t, "flow_id", cols, (0.0, 0.1, 0.3))
    bad = clean.infeasible()["in_bytes_below_header"]
    return p.groupBy("epsilon").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(bad, F.lit(False)).cast("bigint")).alias("infeasible"))


def spsa_evasion(spark: SparkSession, d: str) -> DataFrame:
    """Cosine to class 0 before and after an attack towards it, per epsilon."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("z"))
    p = prototypes.class_means(e, "y", "z", 64).filter("class_id = 0").first()["proto"]
    out = None
    for eps in (0.0, 0.1, 0.3):
        a = adversarial.spsa_attack(e, "z", list(p), eps)
        from flowmill.functions import vec

        s = a.select(F.lit(eps).alias("epsilon"), vec.dot(F.col("z"), F.lit(list(p))).alias("before"), vec.dot(F.col("attacked"), F.lit(list(p))).alias("after"))
        r = s.groupBy("epsilon").agg(F.round(F.avg("before"), 6).alias("before"), F.round(F.avg("after"), 6).alias("after"))
        out = r if out is None else out.unionByName(r)
    return out


def poison_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("y"), F.col("embedding").alias("z"))
    bank = prototypes.class_means(e, "y", "z", 64)
    poison = bank.filter("class_id = 9").first()["proto"]
    free = adversarial.poison_drift(bank, list(poison), 0.5).withColumn("gated", F.lit(False))
    gated = adversarial.poison_drift(bank, list(poison), 0.5, gate=0.5).withColumn("gated", F.lit(True))
    return free.unionByName(gated).withColumn("drift", F.round("drift", 6))


def evasion_summary(spark: SparkSession, d: str) -> DataFrame:
    """Success rate per class and budget, and the breakdown budget, of a
    volume rule (more than the median bytes) under padding."""
    t = table(spark, d, T).filter("Attack IS NOT NULL AND IN_BYTES >= 0 AND NOT isnan(IN_BYTES)").select("Attack", "IN_BYTES", F.explode(F.array(*[F.lit(b) for b in (0, 1, 4, 16, 64)])).alias("budget"))
    s = adversarial.evasion_summary(t, ["Attack", "budget"], F.col("IN_BYTES") + F.col("budget") * 100 > 1000)
    b = adversarial.breakdown_budget(s, ["Attack"], "budget")
    return s.join(b, "Attack").withColumn("asr", F.round("asr", 9))


TREES, HIDDEN, ITERATIONS = 100, (128, 64), 200


def _feats(spark: SparkSession, d: str) -> list[str]:
    return feature_columns(table(spark, d, "train_features"))


def _plain_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows of train and test, whatever their label."""
    keep = ["row_id", "canonical_label", *_feats(spark, d), "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_DST_PORT"]
    return table(spark, d, "train_features").select(keep), table(spark, d, "test_features").select(keep)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of train and test whose label names a class, however it is written, with ``y``."""
    names = clean.label_ids(table(spark, d, "label_vocab"), "family")
    family = table(spark, d, "label_vocab").select(label_key("canonical_label").alias("_key"), "family").dropDuplicates(["_key"]).join(names, "family")
    pick = lambda t: t.withColumn("_key", label_key("canonical_label")).join(F.broadcast(family), "_key").withColumn("y", F.col("label_id").cast("double")).drop("label_id", "_key")  # noqa: E731  a fixed table
    train, test = _plain_tables(spark, d)
    return pick(train), pick(test)


def _report(out: DataFrame) -> DataFrame:
    return metrics.closed_set(metrics.confusion(out, "y", "predicted")).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def baseline_forest(spark: SparkSession, d: str) -> DataFrame:
    train, test = _tables(spark, d)
    return _report(baselines.tabular("rf", train, test, _feats(spark, d), "y", trees=TREES))


def baseline_extra_trees(spark: SparkSession, d: str) -> DataFrame:
    train, test = _tables(spark, d)
    return _report(baselines.tabular("et", train, test, _feats(spark, d), "y", trees=TREES))


def baseline_perceptron(spark: SparkSession, d: str) -> DataFrame:
    train, test = _tables(spark, d)
    return _report(baselines.tabular("mlp", train, test, _feats(spark, d), "y", hidden=HIDDEN, iterations=ITERATIONS))


def identity_floor(spark: SparkSession, d: str) -> DataFrame:
    train, test = _tables(spark, d)
    named = lambda t: t.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("IPV4_SRC_ADDR", "IPV4_DST_ADDR")})
    return _report(baselines.identity_tree(named(train), named(test), "IPV4_SRC_ADDR", "IPV4_DST_ADDR", ["L4_DST_PORT"], "y"))


def reconstruction_score(spark: SparkSession, d: str) -> DataFrame:
    train, test = _plain_tables(spark, d)
    return baselines.reconstruction_error(train, test, _feats(spark, d)).select("row_id", F.round("score", 6).alias("score"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = flows_events(spark, d).select(F.col("src").cast("string").alias("src"), "dst", "bytes")
    states = e.groupBy(F.col("src").alias("node")).agg(F.avg("bytes").alias("h")).unionByName(e.groupBy(F.col("dst").alias("node")).agg(F.lit(0.0).alias("h")))
    return e, states


def message_pass(spark: SparkSession, d: str) -> DataFrame:
    e, states = _graph(spark, d)
    return baselines.message_pass(e, states).select("node", F.round("h", 6).alias("h"))


def attention_pass(spark: SparkSession, d: str) -> DataFrame:
    e, states = _graph(spark, d)
    return baselines.attention_pass(e.select("src", "dst"), states.withColumn("h", F.col("h") / 50)).select("node", F.round("h", 6).alias("h"))


def scale_fusion(spark: SparkSession, d: str) -> DataFrame:
    from flowmill.operators.graph import node_history

    h = node_history(flows_events(spark, d), {"short": 3_600_000, "mid": 6 * 3_600_000, "long": DAY})
    f = baselines.fuse_scales(h, {s: F.log1p(F.col(f"n_{s}")) for s in ("short", "mid", "long")}, {"short": 0.5, "mid": 0.3, "long": 0.2})
    return f.select("flow_id", F.round("fused", 6).alias("fused"), F.round("gate_long", 6).alias("gate_long"))


def identity_audit(spark: SparkSession, d: str) -> DataFrame:
    """The identity floor beside the share of unseen pairs."""
    train, test = _plain_tables(spark, d)
    u = splits.unseen_pairs(test.na.drop(subset=["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]), train.na.drop(subset=["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]), "IPV4_SRC_ADDR", "IPV4_DST_ADDR")
    return u.withColumn("floor_macro_f1", F.lit(identity_floor(spark, d).first()["macro_f1"]))


QUERIES = {f.__name__: f for f in (
    inject_edges_budget, inject_context, jitter_cost, feature_evasion, spsa_evasion, poison_drift, evasion_summary, baseline_forest, baseline_extra_trees, baseline_perceptron,
    identity_floor, reconstruction_score, message_pass, attention_pass, scale_fusion, identity_audit,
)}

_G = "ev AS (SELECT epoch_us(ts) // 1000 ms, event_id flow_id, user_id::VARCHAR src, event_type dst, value bytes FROM events), st AS (SELECT src node, avg(bytes) h FROM ev GROUP BY 1 UNION ALL SELECT DISTINCT dst, 0.0 FROM ev)"
SQL = {
    "inject_edges_budget": "SELECT b::INT budget, count(*) * b n, count(*) targets, count(*) * b injected FROM events CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) b) WHERE event_type = 'purchase' GROUP BY b",
    "inject_context": "SELECT event_type dst, count(*) targets, count(*) + CASE WHEN event_type = 'purchase' THEN 8 * count(*) ELSE 0 END context FROM events GROUP BY 1",
    "evasion_summary": f"""WITH s AS (SELECT Attack, b::INT budget, round(avg((IN_BYTES + b * 100 > 1000)::INT), 9) asr, count(*) n FROM {T} CROSS JOIN (SELECT unnest([0, 1, 4, 16, 64]) b) WHERE Attack IS NOT NULL AND IN_BYTES >= 0 AND NOT isnan(IN_BYTES) GROUP BY 1, 2)
        SELECT *, min(budget) FILTER (asr >= 0.5) OVER (PARTITION BY Attack) breakdown FROM s""",
    "message_pass": f"WITH {_G}, m AS (SELECT dst node, avg(h) m FROM ev JOIN st ON st.node = ev.src GROUP BY 1) SELECT node, round(CASE WHEN m IS NULL THEN h ELSE h * 0.5 + m * 0.5 END, 6) h FROM st LEFT JOIN m USING (node)",
    "attention_pass": f"""WITH {_G}, e AS (SELECT dst, a.h / 50 hs, CASE WHEN a.h / 50 + b.h / 50 > 0 THEN a.h / 50 + b.h / 50 ELSE (a.h / 50 + b.h / 50) * 0.2 END s FROM ev JOIN st a ON a.node = src JOIN st b ON b.node = dst),
        w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY dst)) x FROM e), m AS (SELECT dst node, sum(x * hs) / sum(x) m FROM w GROUP BY 1) SELECT node, round(coalesce(m, h / 50), 6) h FROM st LEFT JOIN m USING (node)""",
    "scale_fusion": f"""WITH {_G}, c AS (SELECT flow_id, {", ".join(f"ln(1 + count(*) OVER (PARTITION BY src ORDER BY ms RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)) {n}" for n, w in (("a", 3_600_000), ("b", 21_600_000), ("c", DAY)))} FROM ev),
        g AS (SELECT *, exp(0.5 * a) ga, exp(0.3 * b) gb, exp(0.2 * c) gc FROM c) SELECT flow_id, round((ga * a + gb * b + gc * c) / (ga + gb + gc), 6) fused, round(gc / (ga + gb + gc), 6) gate_long FROM g""",
}
