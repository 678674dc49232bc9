"""Attacks on raw flows, training, and explanations of neighbour lists: queries
and, where it can say them, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators import adversarial, explain, prototypes, robust, train
from flowmill.operators.features import FeaturePipeline
from flowmill.operators.ranking import uniform_sql
from flowmill.plans.flow_queries import _C, CAP, LONG, _capped, _ev, edges
from flowmill.plans.shared import materialise, new_path
from flowmill.sources.tables import feature_columns, table

FLOWS = "nf_unsw_nb15_v3"
ATTACKED = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, FLOWS).join(table(spark, d, FLOWS).select("flow_id", F.col("Label").alias("y")), "flow_id")


def inject_edges_rows(spark: SparkSession, d: str) -> DataFrame:
    """Where every injected edge of every budget lies before each attack flow, and
    the bytes it copies from a benign one."""
    e = _labelled(spark, d)
    out = adversarial.inject_edges(e.filter("y = 1").select("flow_id", "ms", "src", "dst"), e.filter("y = 0"), LONG)
    return out.select("target_id", "budget", "i", "ms", F.round("bytes", 6).alias("bytes"))


def _shifts(spark: SparkSession, d: str) -> DataFrame:
    e = _labelled(spark, d)
    targets = e.filter("y = 1").select("flow_id", "ms", "src", "dst")
    injected = adversarial.inject_edges(targets, e.filter("y = 0"), LONG, (1, 8, 64)).select("target_id", "budget", "i", (F.log1p("bytes") / 10).alias("value"))
    from flowmill.operators import graph

    binned = graph.anchor_bins(e, LONG)
    lists = graph.neighbours_recent(binned, ["bin", "dst"], CAP).select("bin", "dst", "flow_id", (F.log1p("bytes") / 10).alias("value"))
    own = binned.filter("y = 1").select(F.col("flow_id").alias("target_id"), "bin", "dst").join(lists, ["bin", "dst"])
    return adversarial.injection_shift(own, injected)


def injection_shift(spark: SparkSession, d: str) -> DataFrame:
    """Per attack flow and budget: how far injection moves the mean and the trimmed
    mean of its neighbour list."""
    return _shifts(spark, d).select("target_id", "budget", F.round("mean_shift", 6).alias("mean_shift"), F.round("trimmed_shift", 6).alias("trimmed_shift"))


def injection_success(spark: SparkSession, d: str) -> DataFrame:
    """Share of attack flows per budget whose verdict turns, i.e. whose aggregate
    moves by more than 0.1, under either aggregate; and the breakdown budgets."""
    s = materialise(injection_shift(spark, d), "shifts")
    out = None
    for kind in ("mean", "trimmed"):
        one = adversarial.evasion_summary(s.withColumn("aggregate", F.lit(kind)), ["aggregate", "budget"], F.col(f"{kind}_shift") > 0.1)
        one = one.join(adversarial.breakdown_budget(one, ["aggregate"], "budget"), "aggregate")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("asr", F.round("asr", 9))


def _judge(spark: SparkSession, d: str) -> tuple[adversarial.Judge, DataFrame]:
    """A detector fitted on the raw flows: a prototype for benign (0) and attack (1)."""
    raw = table(spark, d, FLOWS).filter("Label IS NOT NULL")
    pipe = FeaturePipeline(quantiles=200).fit(raw)
    judge = adversarial.Judge(pipe, spark.createDataFrame([], "class_id int, sub_id int, proto array<double>, trained boolean"), theta_unknown=0.001, theta_defer=0.0)
    z = materialise(judge.vectors(raw, ["flow_id", "Label"]), "raw-vectors")
    judge.bank = materialise(prototypes.class_means(z, "Label", "z", len(pipe.columns())), "raw-bank")
    return judge, raw


def raw_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of raw flows, transformed anew: rows per label and decision."""
    judge, raw = _judge(spark, d)
    return judge.verdicts(raw, ["Label"]).groupBy("Label", "decision").agg(F.count(F.lit(1)).alias("n"))


def feature_attack(spark: SparkSession, d: str) -> DataFrame:
    """All attack flows moved towards benign inside boxes of 10 and 30 %: how many
    pass as benign before and after, and the mean gain of the objective."""
    judge, raw = _judge(spark, d)
    out = None
    for eps in (0.1, 0.3):
        a = adversarial.search_attack(raw.filter("Label = 1"), "flow_id", ATTACKED, eps, judge, lambda: adversarial.evade(0), rounds=2, candidates=4)
        one = a.agg(F.lit(eps).alias("epsilon"), F.count(F.lit(1)).alias("n"), F.avg((F.col("decision_before") == 0).cast("double")).alias("benign_before"), F.avg((F.col("decision") == 0).cast("double")).alias("benign_after"),
                    F.round(F.avg(F.col("score") - F.col("score_before")), 9).alias("gain"), F.sum((F.col("score") < F.col("score_before")).cast("bigint")).alias("fell"))
        out = one if out is None else out.unionByName(one)
    return out


def feature_attack_facts(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the attack: every attack flow has a result, none scores lower."""
    return feature_attack(spark, d).select("epsilon", "n", "fell")


def adaptive_attack(spark: SparkSession, d: str) -> DataFrame:
    """The attacker who knows the detector, under both objectives: passing as
    benign, and not being held for unknown."""
    judge, raw = _judge(spark, d)
    out = None
    for name, goal in (("evade", lambda: adversarial.evade(0)), ("avoid_unknown", adversarial.avoid_unknown)):
        a = adversarial.search_attack(raw.filter("Label = 1"), "flow_id", ATTACKED, 0.3, judge, goal, rounds=2, candidates=4)
        one = a.agg(F.lit(name).alias("objective"), F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") == 0).cast("double")).alias("evaded"), F.avg((F.col("decision") == -1).cast("double")).alias("unknown"),
                    F.avg((F.col("decision_before") == -1).cast("double")).alias("unknown_before"), F.round(F.avg(F.col("score") - F.col("score_before")), 9).alias("gain"))
        out = one if out is None else out.unionByName(one)
    return out


# --- training -----------------------------------------------------------------------


def train_head(spark: SparkSession, d: str) -> DataFrame:
    """Losses per epoch of a learned prototype head (a fifth of rows, by id, for
    validation), with a checkpoint after each."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("z"))
    own, held = e.filter("vec_id % 5 > 0"), e.filter("vec_id % 5 = 0")
    fit = train.fit_head(own, held, "z", "y", 10, 64, epochs=8, rate=0.1, path=new_path(spark, "head"))
    return spark.createDataFrame([(h["epoch"], round(h["train_loss"], 6), round(h["val_loss"], 6)) for h in fit.history], "epoch int, train_loss double, val_loss double")


def train_head_f1(spark: SparkSession, d: str) -> DataFrame:
    """How the learned head does on all rows."""
    from flowmill.operators import metrics

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("z"))
    fit = train.fit_head(e.filter("vec_id % 5 > 0"), e.filter("vec_id % 5 = 0"), "z", "y", 10, 64, epochs=8, rate=0.1)
    bank = spark.createDataFrame([(i, 0, [float(x) for x in w], True) for i, w in enumerate(fit.parameters["w"])], "class_id int, sub_id int, proto array<double>, trained boolean").withColumn("proto", vec.unit(F.col("proto")))
    s = prototypes.decide(prototypes.evidence(prototypes.cosines(e, bank, "z")))
    return metrics.closed_set(metrics.confusion(s, "y", "predicted")).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def autoencoder_score(spark: SparkSession, d: str) -> DataFrame:
    """Reconstruction error of every test record by an autoencoder of train."""
    t, v, e = (table(spark, d, f"{s}_features") for s in ("train", "val", "test"))
    names = feature_columns(t)
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in names])
    fit = train.fit_autoencoder(t, v, x, len(names), 16, epochs=10, rate=0.02)
    return e.select("row_id", F.round(train.reconstruction_error(x, fit), 6).alias("score"))


# --- explanations ---------------------------------------------------------------------


def attention_importance(spark: SparkSession, d: str) -> DataFrame:
    """The three edges of each neighbour list that decay weighs most."""
    w = robust.decay_weights(_capped(spark, d).select("bin", "dst", "flow_id", "dt_s"), ["bin", "dst"], LONG / 4000.0)
    return explain.attention_ranking(w, ["bin", "dst"], "weight").select("bin", "dst", "flow_id", "place", F.round("weight", 9).alias("weight"))


def counterfactual_scales(spark: SparkSession, d: str) -> DataFrame:
    """Edges to remove, in turn over the scales, until a list's bytes halve."""
    scale = F.when(F.col("dt_s") <= 1, "short").when(F.col("dt_s") <= 30, "mid").otherwise("long")
    c = _capped(spark, d).select("bin", "dst", "flow_id", scale.alias("scale"), F.round(F.log1p("bytes"), 9).alias("c"))
    need = c.groupBy("bin", "dst").agg(F.round(F.sum("c") / 2, 9).alias("need"))
    g = c.join(need, ["bin", "dst"]).withColumn("g", F.struct("bin", "dst", "need"))
    return explain.counterfactual_round_robin(g, "g", "scale", "c", "flow_id", F.col("g.need")).select("g.bin", "g.dst", "needed", "n_edges", "flips")


def edge_masks(spark: SparkSession, d: str) -> DataFrame:
    """Learned masks of every neighbour list: its edges, those kept, and both scores."""
    e = robust.decay_weights(_capped(spark, d), ["bin", "dst"], LONG / 4000.0)
    lists = e.groupBy(F.concat_ws("|", "bin", "dst").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("flow_id", F.col("weight").alias("w"), F.col("e").alias("m")))).alias("l"))
    m = explain.edge_masks(lists, "grp", [1.0, 0.2])
    return m.select("grp", F.size("masks").alias("n_edges"), F.size(F.filter("masks", lambda x: x > 0.5)).alias("n_kept"), F.round("score", 6).alias("score"), F.round("masked_score", 6).alias("masked_score"))


QUERIES = {f.__name__: f for f in (
    inject_edges_rows, injection_shift, injection_success, raw_verdicts, feature_attack, feature_attack_facts, adaptive_attack, train_head, train_head_f1, autoencoder_score,
    attention_importance, counterfactual_scales, edge_masks,
)}

_L = f"{_ev(FLOWS)}, l AS (SELECT ev.*, Label y FROM ev JOIN (SELECT flow_id, Label FROM {FLOWS}) USING (flow_id)), n AS (SELECT flow_id, bytes v, row_number() OVER (ORDER BY flow_id) k, count(*) OVER () n FROM l WHERE y = 0)"
_INJ = lambda budgets: f"""j AS (SELECT flow_id target_id, ms AS t0, b AS budget, unnest(range(b)) i FROM l CROSS JOIN (SELECT unnest({list(budgets)}) b) WHERE y = 1 AND b > 0),
    p AS (SELECT target_id, budget, i, least(floor((t0 - {LONG} + (i % 4) * {LONG / 4}::DOUBLE) + {uniform_sql("target_id", "budget", "i")} * {LONG / 4}::DOUBLE), t0 - 1)::BIGINT ms, floor({uniform_sql("i", "target_id", seed=1)} * (SELECT count(*) FROM n))::BIGINT + 1 k FROM j)"""  # noqa: E731
_SHIFT = f"""WITH {_L}, {_INJ((1, 8, 64))}, q AS (SELECT target_id, budget, -1 - i fid, ln(1 + v) / 10 x FROM p JOIN n USING (k)), b AS (SELECT *, (ms - (SELECT min(ms) FROM l)) // {LONG} bin FROM l),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bin, dst ORDER BY ms DESC, flow_id DESC) <= {CAP}), o AS (SELECT t.flow_id target_id, c.flow_id fid, ln(1 + c.bytes) / 10 x FROM b t JOIN c ON c.bin = t.bin AND c.dst = t.dst WHERE t.y = 1),
    u AS (SELECT target_id, 0 budget, fid, x FROM o UNION ALL SELECT o.target_id, budget, fid, x FROM o JOIN (SELECT DISTINCT target_id, budget FROM q) USING (target_id) UNION ALL SELECT * FROM q),
    r AS (SELECT *, row_number() OVER w r, count(*) OVER (PARTITION BY target_id, budget) n FROM u WINDOW w AS (PARTITION BY target_id, budget ORDER BY x, fid)),
    a AS (SELECT target_id, budget, avg(x) m, avg(x) FILTER (r > floor(n * 0.2::DOUBLE) AND r <= n - floor(n * 0.2::DOUBLE)) t FROM r GROUP BY 1, 2),
    s AS (SELECT x.target_id, x.budget::INT budget, round(abs(x.m - z.m), 6) mean_shift, round(abs(x.t - z.t), 6) trimmed_shift FROM a x JOIN a z ON z.target_id = x.target_id AND z.budget = 0 WHERE x.budget > 0)"""
_asr = lambda k: f"SELECT '{k}' AS aggregate, budget, round(avg(({k}_shift > 0.1)::INT), 9) asr, count(*) n FROM s GROUP BY 2"

SQL = {
    "inject_edges_rows": f"WITH {_L}, {_INJ((1, 2, 4, 8, 16, 32, 64))} SELECT target_id, budget::INT budget, i::INT i, ms, round(v, 6) AS bytes FROM p JOIN n USING (k)",
    "injection_shift": f"{_SHIFT} SELECT * FROM s",
    "injection_success": f"{_SHIFT} SELECT *, min(budget) FILTER (asr >= 0.5) OVER (PARTITION BY aggregate) breakdown FROM ({_asr('mean')} UNION ALL {_asr('trimmed')})",
    "feature_attack_facts": f"SELECT epsilon, count(*) n, 0::BIGINT fell FROM {FLOWS} CROSS JOIN (SELECT unnest([0.1, 0.3])::DOUBLE epsilon) WHERE Label = 1 GROUP BY 1",
    "attention_importance": f"""WITH {_C}, w AS (SELECT bin, dst, flow_id, pow(2.0, -dt / {LONG / 4000}) / sum(pow(2.0, -dt / {LONG / 4000})) OVER (PARTITION BY bin, dst) w FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY bin, dst ORDER BY w DESC, flow_id) k FROM w)
        SELECT bin, dst, flow_id, k::INT place, round(w, 9) weight FROM r WHERE k <= 3""",
    "counterfactual_scales": f"""WITH {_C}, s AS (SELECT bin, dst, flow_id, CASE WHEN dt <= 1 THEN 'short' WHEN dt <= 30 THEN 'mid' ELSE 'long' END scale, round(ln(1 + bytes), 9) c FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY bin, dst, scale ORDER BY c DESC, flow_id) turn FROM s),
        k AS (SELECT bin, dst, row_number() OVER w k, round(sum(c) OVER (PARTITION BY bin, dst) - sum(c) OVER (PARTITION BY bin, dst ORDER BY turn, scale ROWS UNBOUNDED PRECEDING), 9) rest, round(sum(c) OVER (PARTITION BY bin, dst) / 2, 9) need FROM t WINDOW w AS (PARTITION BY bin, dst ORDER BY turn, scale))
        SELECT bin, dst, min(k) FILTER (rest < need)::INT needed, count(*) n_edges, min(k) FILTER (rest < need) IS NOT NULL flips FROM k GROUP BY 1, 2""",
}
