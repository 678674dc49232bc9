"""Objectives and norms: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators import explain, losses
from flowmill.plans.eval_queries import KNOWN, _chain, _evidence, _own
from flowmill.sources.tables import table


def am_softmax_loss(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d, 10)
    return e.agg(F.round(F.avg(losses.am_softmax(F.col("cos"), F.col("y"))), 6).alias("am_softmax"), F.round(F.avg(losses.compactness(F.col("cos"), F.col("y"))), 6).alias("compactness"))


def evidential_loss(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, 10).select("vec_id", F.round(losses.evidential(F.col("log_e"), F.col("y")), 6).alias("loss"))


def unknown_penalty(spark: SparkSession, d: str) -> DataFrame:
    """What each row would cost as a synthetic unknown, and its compactness."""
    e = _evidence(spark, d, 10)
    return e.select("vec_id", F.round(losses.unknown_penalty(F.col("log_e")), 6).alias("penalty"), F.round(losses.compactness(F.col("cos"), F.col("y")), 6).alias("compactness"))


def channel_reliance(spark: SparkSession, d: str) -> DataFrame:
    """Share of attribution on the first half of the dimensions."""
    a = explain.attribution(F.col("z"), F.col("proto"), 0.1)
    return losses.channel_ratio(_own(spark, d), a, list(range(32))).select(F.round("ratio", 9).alias("ratio"))


def sibling_absorption(spark: SparkSession, d: str) -> DataFrame:
    """Rows of unknown class 9 that are named class 7."""
    r = losses.sibling_absorption(_evidence(spark, d), F.col("y") == 9, F.col("decision") == 7)
    return r.withColumn("rate", F.round("rate", 9))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vec.layer_norm(F.col("embedding"))[0], 6).alias("layer"), F.round(vec.rms_norm(F.col("embedding"))[0], 6).alias("rms"))


QUERIES = {f.__name__: f for f in (am_softmax_loss, evidential_loss, unknown_penalty, channel_reliance, sibling_absorption, vector_norms)}

def _digamma(x: str) -> str:
    z = f"(1 / (({x} + 6) * ({x} + 6)))"
    up = " + ".join(f"1 / ({x} + {k})" for k in range(6))
    return f"(ln({x} + 6) - 0.5 / ({x} + 6) - {z} * ({1 / 12!r}::DOUBLE - {z} * ({1 / 120!r}::DOUBLE - {z} * ({1 / 252!r}::DOUBLE - {z} / 240))) - ({up}))"


SQL = {
    "unknown_penalty": f"WITH {_chain(10)} SELECT tt.vec_id, round(ln(1 + et), 6) penalty, round(1 - s, 6) compactness FROM tt JOIN cs ON cs.vec_id = tt.vec_id AND cs.c = cs.y",
    "evidential_loss": f"""WITH {_chain(10)}, a AS (SELECT vec_id, c = y own, ee + 1 a, CASE WHEN c = y THEN 1.0::DOUBLE ELSE ee + 1 END o FROM ev), t AS (SELECT vec_id, sum(a) sa, sum(o) so, max(a) FILTER (own) ay, count(*) n, sum(lgamma(o)) lg FROM a GROUP BY 1),
        k AS (SELECT a.vec_id, sum((o - 1) * ({_digamma("o")} - {_digamma("so")})) d FROM a JOIN t USING (vec_id) GROUP BY 1)
        SELECT vec_id, round({_digamma("sa")} - {_digamma("ay")} + 0.1 * (lgamma(so) - lgamma(n) - lg + d), 6) loss FROM t JOIN k USING (vec_id)""",
    "am_softmax_loss": f"WITH {_chain(10)}, x AS (SELECT vec_id, c = y own, s, (s - CASE WHEN c = y THEN 0.35 ELSE 0 END) * 30 v FROM cs) SELECT round(avg(l), 6) am_softmax, round(avg(k), 6) compactness FROM (SELECT vec_id, ln(sum(exp(v))) - max(v) FILTER (own) l, 1 - max(s) FILTER (own) k FROM x GROUP BY 1)",
    "channel_reliance": f"WITH {_chain()}, ow AS (SELECT vec_id, z, pv FROM s0 JOIN e USING (vec_id) JOIN pr ON pr.c = s0.predicted), att AS (SELECT unnest(z) zz, unnest(pv) pz, generate_subscripts(z, 1) i FROM ow) SELECT round(sum(abs(zz * pz / 0.1)) FILTER (i <= 32) / sum(abs(zz * pz / 0.1)), 9) ratio FROM att",
    "sibling_absorption": f"WITH {_chain()} SELECT count(*) FILTER (y = 9) n_held, count(*) FILTER (y = 9 AND decision = 7) n_absorbed, round(count(*) FILTER (y = 9 AND decision = 7) / count(*) FILTER (y = 9), 9) rate FROM sc WHERE y >= {KNOWN}",
    "vector_norms": """WITH d AS (SELECT vec_id, unnest(embedding::DOUBLE[]) v, generate_subscripts(embedding, 1) i FROM embeddings), s AS (SELECT vec_id, avg(v) m, var_pop(v) q, avg(v * v) r, max(v) FILTER (i = 1) f FROM d GROUP BY 1)
        SELECT vec_id, round((f - m) / sqrt(q + 1e-5), 6) layer, round(f / sqrt(r + 1e-6), 6) rms FROM s""",
}
