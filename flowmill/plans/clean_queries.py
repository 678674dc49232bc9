"""Cleaning, labels, features: queries on the raw flow tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill import schema
from flowmill.functions.text import label_key, label_key_sql
from flowmill.operators import clean, features
from flowmill.plans.shared import broadcast_if_small
from flowmill.operators.ranking import quantiles
from flowmill.sources.tables import feature_columns, table

T = "nf_cicids2018_v3"
LOW, HIGH = schema.VALID_MS
TO_MS = 4_102_444_800_000  # the test tables lie after the documented range, so a wider one is asked for
CLIPPED = ["IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS"]
FEATS = list(schema.RAW_FEATURES)
_F = ", ".join(FEATS)


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def drop_unusable(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T).select("flow_id", "Attack", "FLOW_START_MILLISECONDS")
    return clean.drop_unusable(t, LOW, TO_MS)


def clip_negative(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T).select("flow_id", *CLIPPED)
    return clean.clip_negative(t, CLIPPED)


def clean_report(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_report(table(spark, d, T))


def dedup_flows(spark: SparkSession, d: str) -> DataFrame:
    return clean.deduplicate(table(spark, d, T)).select("flow_id", "IPV4_SRC_ADDR", "FLOW_START_MILLISECONDS")


def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T).select("flow_id", "Attack")
    return clean.canonical_labels(t, table(spark, d, "label_vocab"), "cicids2018").select("flow_id", "canonical_label", "family")


def canonical_labels_strict(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nf_bot_iot_v3").filter("Attack IN ('DoS', 'DDoS', 'Reconnaissance', 'Theft', 'Benign')").select("flow_id", "Attack")
    return clean.canonical_labels(t, table(spark, d, "label_vocab"), "bot_iot", strict=True, exact=True).select("flow_id", "canonical_label")


def canonical_labels_strict_all(spark: SparkSession, d: str) -> DataFrame:
    """All rows that name a class in any writing; an unknown label raises."""
    t = table(spark, d, "nf_bot_iot_v3").select("flow_id", "Attack")
    vocab = table(spark, d, "label_vocab")
    names = vocab.filter("dataset = 'bot_iot'").select(label_key("raw_label").alias("_key")).distinct()
    named = t.withColumn("_key", label_key("Attack")).join(broadcast_if_small(names, 100_000), "_key", "left_semi").drop("_key")
    return clean.canonical_labels(named, vocab, "bot_iot", strict=True).select("flow_id", "canonical_label")


def family_counts(spark: SparkSession, d: str) -> DataFrame:
    c = clean.canonical_labels(table(spark, d, T).select("Attack"), table(spark, d, "label_vocab"), "cicids2018")
    return c.groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, T).groupBy("Attack", "Label").agg(F.count(F.lit(1)).alias("n"))


def label_ids(spark: SparkSession, d: str) -> DataFrame:
    vocab = table(spark, d, "label_vocab").filter("dataset = 'cicids2018'")
    return clean.label_ids(vocab, "canonical_label").select("canonical_label", F.col("label_id").cast("bigint").alias("label_id"))


def project_feasible(spark: SparkSession, d: str) -> DataFrame:
    cols = ["IN_PKTS", "OUT_PKTS", "IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "SHORTEST_FLOW_PKT", "LONGEST_FLOW_PKT",
            "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_STDDEV", "L4_DST_PORT"]
    t = table(spark, d, T).select("flow_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in _NAN else F.col(c) for c in cols])
    return _round(clean.feasible(t), ["DURATION_IN", "DURATION_OUT"], 9).withColumns({c: F.col(c).cast("double") for c in cols})


_NAN = {c for c in ("IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_STDDEV")}
_nn = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"


def feasibility_violations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T)
    return t.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(n) for n, c in clean.infeasible().items()])


def source_guard(spark: SparkSession, d: str) -> DataFrame:
    made = [clean.source_guard(table(spark, d, t), "IPV4_SRC_ADDR").withColumn("flow_table", F.lit(t)) for t in ("nf_cicids2018_v3", "nf_unsw_nb15_v3")]
    return made[0].unionByName(made[1])


def te2_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, T).select("flow_id", *[F.round(c, 6).alias(n) for n, c in features.rhythm().items()])


def flag_bits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, T).select("flow_id", *[c.alias(n) for n, c in features.flag_bits().items()])


def port_features(spark: SparkSession, d: str) -> DataFrame:
    both = features.port_features("L4_SRC_PORT") | features.port_features("L4_DST_PORT")
    return table(spark, d, T).select("flow_id", *[F.round(c, 6).alias(n) for n, c in both.items()])


def port_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, T).groupBy(features.port_bucket("L4_DST_PORT").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hist_simplex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, T).select("flow_id", *[F.round(c, 6).alias(n) for n, c in features.histogram().items()])


def topk_categories(spark: SparkSession, d: str) -> DataFrame:
    return features.top_categories(table(spark, d, T), "L4_DST_PORT", 32)


def topk_onehot(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T)
    top = [r["PROTOCOL"] for r in features.top_categories(t, "PROTOCOL", 3).collect()]
    hot = features.one_hot("PROTOCOL", top)
    named = [f"top_{i}" for i in range(len(top))] + ["other"]
    return t.select("flow_id", *[c.alias(n) for n, c in zip(named, hot.values(), strict=True)])


def topk_onehot_other_rate(spark: SparkSession, d: str) -> DataFrame:
    train, other = table(spark, d, T), table(spark, d, "nf_ton_iot_v3")
    top = [r["L4_DST_PORT"] for r in features.top_categories(train, "L4_DST_PORT", 32).collect()]
    return features.other_rate(other, "L4_DST_PORT", top).select(F.round("other_rate", 9).alias("other_rate"))


_SCALED = ["MIN_TTL", "LONGEST_FLOW_PKT", "TCP_WIN_MAX_IN", "DNS_TTL_ANSWER"]


def robust_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = features.robust_fit(table(spark, d, T), _SCALED)
    return spark.createDataFrame([(c, m, q) for c, (m, q) in fit.items()], "feature string, median double, iqr double")


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T)
    return t.select("flow_id", *[F.round(c, 6).alias(n) for n, c in features.robust_scale(features.robust_fit(t, _SCALED)).items()])


def quantile_knots(spark: SparkSession, d: str) -> DataFrame:
    knots = features.knots_fit(table(spark, d, T), {c: F.col(c).cast("double") for c in schema.HEAVY_TAILED}, shape=lambda x: features.signed_log(features.finite(x)))
    return spark.createDataFrame([(c, i, round(v, 9)) for c, ks in knots.items() for i, v in enumerate(ks)], "feature string, i int, knot double")


def te1_conditioned(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T)
    cols = {c: features.signed_log(features.finite(F.col(c).cast("double"))) for c in ("IN_BYTES", "FLOW_DURATION_MILLISECONDS", "SRC_TO_DST_IAT_AVG")}
    knots = features.knots_fit(t, cols)
    return t.select("flow_id", features.to_normal(cols, knots).alias("n")).select("flow_id", *[F.col("n")[i].alias(c) for i, c in enumerate(cols)])


def signed_log(spark: SparkSession, d: str) -> DataFrame:
    v = features.finite(F.col("IN_BYTES"))
    return table(spark, d, T).select("flow_id", F.round(features.signed_log(v), 6).alias("clipped"), F.round(features.signed_log(v, False), 6).alias("mirrored"))


def feature_pipeline(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, T)
    return features.FeaturePipeline().fit(t).transform(t, ["flow_id"])


def feature_channels(spark: SparkSession, d: str) -> DataFrame:
    names = [c for c in table(spark, d, "train_features").columns if c not in ("row_id", "dataset", "canonical_label", *schema.TIMES, *schema.ADDRESSES, *schema.PORTS)]
    features.channels(names)
    return spark.createDataFrame([(n, features.channel(n)) for n in names], "feature string, channel string")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    from flowmill.operators.splits import class_weights as weigh

    return weigh(class_counts(spark, d).groupBy("Attack").agg(F.sum("n").alias("n"))).select("Attack", "n", F.round("weight", 9).alias("weight"))


def class_medians(spark: SparkSession, d: str) -> DataFrame:
    """Benign medians of every feature, one row each, whatever the label's
    writing: the baseline of attributions."""
    t = table(spark, d, "train_features").filter(label_key("canonical_label") == "benign")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in feature_columns(t)])
    return quantiles(t.select(F.inline(pairs)), ["feature"], F.col("x"), [0.5]).select("feature", F.round("value", 9).alias("median"))


def row_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a flow: distinct tuples by how often they occur."""
    t = table(spark, d, T).groupBy(F.xxhash64(*FEATS).alias("a"), F.xxhash64(F.lit(11), *FEATS).alias("b")).agg(F.count(F.lit(1)).alias("copies"))
    return t.groupBy("copies").agg(F.count(F.lit(1)).alias("n_tuples"))


QUERIES = {f.__name__: f for f in (
    drop_unusable, clip_negative, clean_report, dedup_flows, canonical_labels, canonical_labels_strict, canonical_labels_strict_all, family_counts, class_counts, label_ids,
    project_feasible, feasibility_violations, source_guard, te2_descriptors, flag_bits, port_features, port_buckets, hist_simplex, topk_categories,
    topk_onehot, topk_onehot_other_rate, robust_fit, robust_scale, quantile_knots, te1_conditioned, signed_log, feature_pipeline, feature_channels, class_weights, class_medians, row_hash_groups,
)}

_fin = lambda e: f"(CASE WHEN isfinite({e}) THEN {e} ELSE 0.0 END)"
_FWD, _BWD = "SRC_TO_DST_IAT", "DST_TO_SRC_IAT"
_P, _DUR = "(IN_PKTS + OUT_PKTS)", "FLOW_DURATION_MILLISECONDS"
_TE2 = {
    "iat_cv_fwd": f"{_FWD}_STDDEV / ({_FWD}_AVG + 1e-6)", "iat_cv_bwd": f"{_BWD}_STDDEV / ({_BWD}_AVG + 1e-6)",
    "iat_burst_fwd": f"({_FWD}_MAX - {_FWD}_MIN) / ({_FWD}_AVG + 1e-6)", "iat_burst_bwd": f"({_BWD}_MAX - {_BWD}_MIN) / ({_BWD}_AVG + 1e-6)",
    "duty_cycle": f"(DURATION_IN + DURATION_OUT) / ({_DUR} + 1e-6)", "pkt_rate": f"{_P} / ({_DUR} + 1e-6)", "byte_rate": f"(IN_BYTES + OUT_BYTES) / ({_DUR} + 1e-6)",
    "dir_asymmetry": f"({_FWD}_AVG - {_BWD}_AVG) / ({_FWD}_AVG + {_BWD}_AVG + 1e-6)", "pkt_size_spread": "(LONGEST_FLOW_PKT - SHORTEST_FLOW_PKT)::DOUBLE",
    "bytes_per_pkt_in": "IN_BYTES / (IN_PKTS + 1e-6)", "bytes_per_pkt_out": "OUT_BYTES / (OUT_PKTS + 1e-6)",
    "retrans_ratio": f"(RETRANSMITTED_IN_PKTS + RETRANSMITTED_OUT_PKTS) / ({_P} + 1e-6)",
}
_HIST = " + ".join(f"coalesce({b}, 0)::DOUBLE" for b in schema.PACKET_BINS)
_VALID = f"Attack IS NOT NULL AND FLOW_START_MILLISECONDS BETWEEN {LOW} AND {HIGH}"
_port = lambda c: f"""({c} < 1024)::INT::DOUBLE {c0(c)}_is_well_known, ({c} BETWEEN 1024 AND 49151)::INT::DOUBLE {c0(c)}_is_registered,
    ({c} >= 49152)::INT::DOUBLE {c0(c)}_is_ephemeral, round(ln(1 + {c}::DOUBLE) / ln(65536::DOUBLE), 6) {c0(c)}_log"""  # noqa: E731
c0 = lambda c: c[9:-4]  # noqa: E731  the name inside coalesce(..., 0)


def _q(c: str, p: float) -> str:
    return f"quantile_cont(coalesce({c}, 0)::DOUBLE, {p})"


_iqr = lambda c: f"CASE WHEN {_q(c, 0.75)} - {_q(c, 0.25)} = 0 THEN 1.0 ELSE {_q(c, 0.75)} - {_q(c, 0.25)} END"
_up = lambda e, v: f"CASE WHEN {e} < {v} THEN {v} ELSE {e} END"

SQL = {
    "drop_unusable": f"SELECT flow_id, Attack, FLOW_START_MILLISECONDS FROM {T} WHERE Attack IS NOT NULL AND FLOW_START_MILLISECONDS BETWEEN {LOW} AND {TO_MS}",
    "clip_negative": "SELECT flow_id, " + ", ".join(f"CASE WHEN {c} < 0 THEN 0 WHEN isnan({c}) THEN NULL ELSE {c} END {c}" for c in CLIPPED) + f" FROM {T}",
    "clean_report": f"""WITH v AS (SELECT *, CASE WHEN Attack IS NULL THEN 'l' WHEN FLOW_START_MILLISECONDS IS NULL THEN 't'
        WHEN NOT FLOW_START_MILLISECONDS BETWEEN {LOW} AND {HIGH} THEN 'i' ELSE 'ok' END v FROM {T}), k AS (SELECT count(*) n FROM (SELECT DISTINCT {_F} FROM v WHERE v = 'ok'))
        SELECT count(*) rows_in, count(*) FILTER (v = 'l') dropped_null_label, count(*) FILTER (v = 't') dropped_null_time, count(*) FILTER (v = 'i') dropped_implausible_time,
        count(*) FILTER (v = 'ok') - any_value(k.n) dropped_duplicates, any_value(k.n) rows_kept FROM v, k""",
    "dedup_flows": f"SELECT min(flow_id) flow_id, IPV4_SRC_ADDR, FLOW_START_MILLISECONDS FROM {T} GROUP BY {_F}",
    "canonical_labels": f"""SELECT flow_id, v.canonical_label, v.family FROM {T} f LEFT JOIN (SELECT {label_key_sql("raw_label")} AS key, canonical_label, family FROM label_vocab WHERE dataset = 'cicids2018') v
        ON {label_key_sql("f.Attack")} = v.key""",
    "canonical_labels_strict": "SELECT flow_id, v.canonical_label FROM nf_bot_iot_v3 f JOIN label_vocab v ON v.dataset = 'bot_iot' AND v.raw_label = f.Attack",
    "canonical_labels_strict_all": f"SELECT flow_id, v.canonical_label FROM nf_bot_iot_v3 f JOIN (SELECT DISTINCT {label_key_sql('raw_label')} AS key, canonical_label FROM label_vocab WHERE dataset = 'bot_iot') v ON {label_key_sql('f.Attack')} = v.key",
    "family_counts": f"""SELECT coalesce(v.family, 'other') family, count(*) n FROM {T} f LEFT JOIN (SELECT {label_key_sql("raw_label")} AS key, family FROM label_vocab WHERE dataset = 'cicids2018') v
        ON {label_key_sql("f.Attack")} = v.key GROUP BY 1""",
    "class_counts": f"SELECT Attack, Label, count(*) n FROM {T} GROUP BY 1, 2",
    "label_ids": "SELECT canonical_label, row_number() OVER (ORDER BY canonical_label) - 1 label_id FROM (SELECT DISTINCT canonical_label FROM label_vocab WHERE dataset = 'cicids2018')",
    "project_feasible": f"""WITH a AS (SELECT flow_id, round_even({_up("IN_PKTS::DOUBLE", "0")}, 0) ip, round_even({_up("OUT_PKTS::DOUBLE", "0")}, 0) op, {_nn("IN_BYTES")} ib, {_nn("OUT_BYTES")} ob,
        {_up(f"({_nn(_DUR)})", "0")} dur, {_nn("DURATION_IN")} di, {_nn("DURATION_OUT")} dout, SHORTEST_FLOW_PKT s, LONGEST_FLOW_PKT l,
        {", ".join(f"{_nn(f'{_FWD}_{x}')} {x.lower()}" for x in ("MIN", "AVG", "MAX", "STDDEV"))}, L4_DST_PORT port FROM {T}),
        b AS (SELECT *, CASE WHEN di + dout > dur THEN coalesce(dur / nullif(di + dout, 0), 1.0) ELSE 1.0 END sc FROM a)
        SELECT flow_id, ip IN_PKTS, op OUT_PKTS, {_up("ib", "ip * 40")} IN_BYTES, {_up("ob", "op * 40")} OUT_BYTES, dur FLOW_DURATION_MILLISECONDS, round(di * sc, 9) DURATION_IN, round(dout * sc, 9) DURATION_OUT,
        least(s, l)::DOUBLE SHORTEST_FLOW_PKT, least(greatest(s, l), 1514)::DOUBLE LONGEST_FLOW_PKT, least(min, avg, max) SRC_TO_DST_IAT_MIN, avg SRC_TO_DST_IAT_AVG, greatest(min, avg, max) SRC_TO_DST_IAT_MAX,
        {_up("stddev", "0")} SRC_TO_DST_IAT_STDDEV, least({_up("port", "0")}, CASE WHEN port IS NULL THEN NULL ELSE 65535 END)::DOUBLE L4_DST_PORT FROM b""",
    "feasibility_violations": f"""SELECT count(*) FILTER (IN_BYTES < IN_PKTS * 40 - 1e-6) in_bytes_below_header, count(*) FILTER (OUT_BYTES < OUT_PKTS * 40 - 1e-6) out_bytes_below_header,
        count(*) FILTER ({_FWD}_MIN > {_FWD}_AVG + 1e-6 OR {_FWD}_AVG > {_FWD}_MAX + 1e-6) fwd_iat_unordered, count(*) FILTER ({_BWD}_MIN > {_BWD}_AVG + 1e-6 OR {_BWD}_AVG > {_BWD}_MAX + 1e-6) bwd_iat_unordered FROM {T}""",
    "source_guard": " UNION ALL ".join(f"SELECT count(DISTINCT IPV4_SRC_ADDR) n_sources, CASE WHEN count(DISTINCT IPV4_SRC_ADDR) >= 1000 THEN 'ip' ELSE 'ip_port' END granularity, '{t}' flow_table FROM {t}" for t in ("nf_cicids2018_v3", "nf_unsw_nb15_v3")),
    "te2_descriptors": "SELECT flow_id, " + ", ".join(f"round({_fin(e)}, 6) {n}" for n, e in _TE2.items()) + f", CASE WHEN {_P} <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END iat_undefined FROM {T}",
    "flag_bits": "SELECT flow_id, " + ", ".join(f"((coalesce({c}, 0) >> {i}) & 1)::DOUBLE {c}_{b}" for c in schema.FLAG_COLUMNS for i, b in enumerate(schema.FLAG_BITS)) + f" FROM {T}",
    "port_features": f"SELECT flow_id, {_port('coalesce(L4_SRC_PORT, 0)')}, {_port('coalesce(L4_DST_PORT, 0)')} FROM {T}",
    "port_buckets": f"SELECT CASE WHEN NOT L4_DST_PORT BETWEEN 0 AND 65535 THEN NULL WHEN L4_DST_PORT <= 1023 THEN 'well_known' WHEN L4_DST_PORT <= 49151 THEN 'registered' WHEN L4_DST_PORT <= 65535 THEN 'ephemeral' END bucket, count(*) n FROM {T} GROUP BY 1",
    "hist_simplex": "SELECT flow_id, " + ", ".join(f"CASE WHEN s <> 0 THEN round(coalesce({b}, 0) / s, 6) ELSE 0.0 END pkt_size_hist_norm_{b}" for b in schema.PACKET_BINS) + f", round(ln(1 + greatest(s, 0)), 6) pkt_size_hist_sum_log FROM (SELECT *, {_HIST} s FROM {T})",
    "topk_categories": f"SELECT L4_DST_PORT, count(*) n FROM {T} WHERE L4_DST_PORT IS NOT NULL GROUP BY 1 ORDER BY n DESC, L4_DST_PORT LIMIT 32",
    "topk_onehot": f"""WITH t AS (SELECT PROTOCOL p, row_number() OVER (ORDER BY count(*) DESC, PROTOCOL) r FROM {T} WHERE PROTOCOL IS NOT NULL GROUP BY 1)
        SELECT flow_id, coalesce(r = 1, false)::INT::DOUBLE top_0, coalesce(r = 2, false)::INT::DOUBLE top_1, coalesce(r = 3, false)::INT::DOUBLE top_2, (coalesce(r, 99) > 3)::INT::DOUBLE other FROM {T} f LEFT JOIN t ON t.p = f.PROTOCOL""",
    "topk_onehot_other_rate": f"""WITH t AS (SELECT L4_DST_PORT p FROM {T} WHERE L4_DST_PORT IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 32)
        SELECT round(avg((t.p IS NULL)::INT), 9) other_rate FROM nf_ton_iot_v3 f LEFT JOIN t ON t.p = f.L4_DST_PORT""",
    "robust_fit": " UNION ALL ".join(f"SELECT '{c}' feature, {_q(c, 0.5)} median, {_iqr(c)} iqr FROM {T}" for c in _SCALED),
    "robust_scale": f"WITH q AS (SELECT {', '.join(f'{_q(c, 0.5)} m{i}, {_iqr(c)} r{i}' for i, c in enumerate(_SCALED))} FROM {T}) SELECT flow_id, " + ", ".join(f"round((coalesce({c}, 0) - m{i}) / r{i}, 6) {c}" for i, c in enumerate(_SCALED)) + f" FROM {T}, q",
    "signed_log": f"SELECT flow_id, round(ln(1 + greatest({_fin('IN_BYTES')}, 0)), 6) clipped, round(sign({_fin('IN_BYTES')}) * ln(1 + abs({_fin('IN_BYTES')})), 6) mirrored FROM {T}",
    "class_weights": f"SELECT Attack, count(*) n, round((1 - 0.999) / (1 - pow(0.999, count(*))), 9) weight FROM {T} GROUP BY 1",
    "class_medians": f"""WITH b AS (SELECT * FROM train_features WHERE {label_key_sql("canonical_label")} = 'benign'), u AS (UNPIVOT (SELECT COLUMNS(* EXCLUDE (row_id, dataset, canonical_label, FLOW_START_MILLISECONDS, IPV4_SRC_ADDR, IPV4_DST_ADDR, L4_SRC_PORT, L4_DST_PORT)) FROM b) ON COLUMNS(*) INTO NAME feature VALUE x)
        SELECT feature, round(quantile_cont(x, 0.5), 9) median FROM u WHERE x IS NOT NULL GROUP BY 1""",
    "quantile_knots": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' feature, ln(1 + greatest({_fin(f'coalesce({c}, 0)::DOUBLE')}, 0)) x FROM {T}" for c in schema.HEAVY_TAILED) + f"""),
        c AS (SELECT feature, floor(x * {features.KNOT_CELLS}) cell, count(*) c, min(x) lo, max(x) hi FROM v GROUP BY 1, 2), u AS (SELECT *, sum(c) OVER (PARTITION BY feature ORDER BY cell)::BIGINT upto, sum(c) OVER (PARTITION BY feature)::BIGINT n FROM c),
        k AS (SELECT feature, i, i * (n - 1) // 999 r FROM (SELECT DISTINCT feature, n FROM u) CROSS JOIN range(1000) t(i))
        SELECT k.feature, i::INT i, round(lo + (hi - lo) * (r - (upto - c)) / greatest(c - 1, 1), 9) knot FROM k JOIN u ON u.feature = k.feature AND r >= upto - c AND r < upto""",
    "row_hash_groups": f"SELECT copies, count(*) n_tuples FROM (SELECT count(*) copies FROM {T} GROUP BY {_F}) GROUP BY 1",
}
