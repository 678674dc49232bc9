"""Splits, thinning, audits: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import label_key_sql
from flowmill.operators import clean, splits
from flowmill.operators.ranking import hash_order_sql, mixed_sql, uniform_sql
from flowmill.sources.tables import feature_columns, flows_events, table

T = "nf_cicids2018_v3"
HELD = ["bot", "brute_web"]


def _labelled(spark: SparkSession, d: str, more: list[str] | None = None) -> DataFrame:
    t = table(spark, d, T).filter("FLOW_START_MILLISECONDS IS NOT NULL").select("flow_id", F.col("FLOW_START_MILLISECONDS").alias("ms"), "Attack", *(more or []))
    return clean.canonical_labels(t, table(spark, d, "label_vocab"), "cicids2018").filter("canonical_label IS NOT NULL").drop("Attack")


def _split(spark: SparkSession, d: str, more: list[str] | None = None) -> DataFrame:
    return splits.temporal_split(_labelled(spark, d, more), "canonical_label", "ms", "flow_id")


def split_protocol_a(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("flow_id", "canonical_label", "split")


def split_protocol_b(spark: SparkSession, d: str) -> DataFrame:
    return splits.leave_classes_out(_split(spark, d), "canonical_label", HELD).select("flow_id", "split", "target")


def split_family_holdout(spark: SparkSession, d: str) -> DataFrame:
    out = splits.leave_member_out(_split(spark, d), "canonical_label", "family", "dos_hulk")
    return out.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


def split_cross_dataset(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, f"nf_{n}_v3") for n in ("cicids2018", "ton_iot")}
    return splits.cross_dataset(t, "cicids2018", "ton_iot", ["flow_id", "Label"]).groupBy("dataset", "split", "Label").agg(F.count(F.lit(1)).alias("n"))


def split_host_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return splits.host_disjoint(flows_events(spark, d), "src", "flow_id").select("flow_id", "src", "split")


def holdout_sets(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in table(spark, d, "label_vocab").filter("dataset = 'cicids2018' AND canonical_label <> 'benign'").select("canonical_label").distinct().orderBy("canonical_label").collect()]  # a fixed table
    rows = [(i, c) for i, s in enumerate(splits.holdout_sets(names, 3, 5, 11)) for c in s]
    return spark.createDataFrame(rows, "set_id int, canonical_label string")


QUOTAS = {"benign": 2000, "ddos_hoic": 300}


def subsample_temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_quota(_labelled(spark, d), "canonical_label", "ms", "flow_id", QUOTAS, bins=20).select("flow_id", "canonical_label")


def subsample_quota(spark: SparkSession, d: str) -> DataFrame:
    return splits.head_quota(_labelled(spark, d), "canonical_label", "ms", "flow_id", QUOTAS).select("flow_id", "canonical_label")


def quota_plan(spark: SparkSession, d: str) -> DataFrame:
    counts = {r[0]: r[1] for r in _labelled(spark, d).groupBy("canonical_label").count().collect()}  # one row per class of a fixed table
    plan = splits.plan_quotas(counts, sum(counts.values()) // 3, 500, "benign")
    return spark.createDataFrame(list(plan.items()), "canonical_label string, quota bigint")


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_rows(flows_events(spark, d).select("flow_id", "src"), 500, "flow_id", 9)


def sample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return splits.redraw(flows_events(spark, d).select("flow_id", "bytes"), 300, "flow_id", 4)


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Share of test records within 1e-6 of a training record."""
    t, e = table(spark, d, "train_features"), table(spark, d, "test_features")
    return splits.near_duplicate_rate(e, t, feature_columns(t), "row_id").withColumn("rate", F.round("rate", 9))


_AUDIT = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "L4_SRC_PORT", "L4_DST_PORT", "IPV4_SRC_ADDR", "IPV4_DST_ADDR"]


def audit_split(spark: SparkSession, d: str) -> DataFrame:
    a = splits.audit(_split(spark, d, _AUDIT), "canonical_label", "ms", _AUDIT)
    return a.withColumn("share", F.round("share", 9))


def cross_split_copies(spark: SparkSession, d: str) -> DataFrame:
    """Distinct feature tuples that stand in train and test both (intersect)."""
    s = _split(spark, d, _AUDIT)
    both = s.filter("split = 'train'").select(_AUDIT).intersect(s.filter("split = 'test'").select(_AUDIT))
    return both.agg(F.count(F.lit(1)).alias("n_tuples"))


def only_in_test(spark: SparkSession, d: str) -> DataFrame:
    """Source addresses of test that train has not (except)."""
    s = _split(spark, d, ["IPV4_SRC_ADDR"])
    return s.filter("split = 'test'").select("IPV4_SRC_ADDR").exceptAll(s.filter("split = 'train'").select("IPV4_SRC_ADDR")).distinct()


def unseen_pair_rate(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d, ["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]).filter("IPV4_SRC_ADDR IS NOT NULL AND IPV4_DST_ADDR IS NOT NULL")
    u = splits.unseen_pairs(s.filter("split = 'test'"), s.filter("split = 'train'"), "IPV4_SRC_ADDR", "IPV4_DST_ADDR")
    return u.withColumn("unseen_rate", F.round("unseen_rate", 9))


def host_concentration(spark: SparkSession, d: str) -> DataFrame:
    t = _labelled(spark, d, ["IPV4_SRC_ADDR"]).filter("IPV4_SRC_ADDR IS NOT NULL")
    return splits.host_concentration(t, "canonical_label", "IPV4_SRC_ADDR").withColumn("top_share", F.round("top_share", 9))


QUERIES = {f.__name__: f for f in (
    split_protocol_a, split_protocol_b, split_family_holdout, split_cross_dataset, split_host_disjoint, holdout_sets, subsample_temporal, subsample_quota, quota_plan,
    near_duplicates, sample_rows, sample_with_replacement, audit_split, cross_split_copies, only_in_test, unseen_pair_rate, host_concentration,
)}

_LAB = f"""lab AS (SELECT f.*, FLOW_START_MILLISECONDS ms, v.canonical_label, v.family FROM {T} f
    JOIN (SELECT {label_key_sql("raw_label")} AS key, canonical_label, family FROM label_vocab WHERE dataset = 'cicids2018') v ON {label_key_sql("f.Attack")} = v.key WHERE FLOW_START_MILLISECONDS IS NOT NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY ms, flow_id) rk, count(*) OVER (PARTITION BY canonical_label) n FROM lab),
    s AS (SELECT * EXCLUDE (rk, n), CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END split FROM rk)"""
_HELD = ", ".join(f"'{c}'" for c in HELD)
_EV = "SELECT event_id flow_id, user_id src, value bytes FROM events"
_QUOTA = "CASE canonical_label " + " ".join(f"WHEN '{c}' THEN {q}" for c, q in QUOTAS.items()) + " END"
_A = ", ".join(_AUDIT)

SQL = {
    "split_protocol_a": f"WITH {_LAB} SELECT flow_id, canonical_label, split FROM s",
    "split_protocol_b": f"WITH {_LAB} SELECT flow_id, split, CASE WHEN canonical_label IN ({_HELD}) THEN 'UNKNOWN' ELSE canonical_label END target FROM s WHERE canonical_label NOT IN ({_HELD}) OR split = 'test'",
    "split_family_holdout": f"WITH {_LAB} SELECT split, CASE WHEN canonical_label = 'dos_hulk' THEN 'UNKNOWN' ELSE canonical_label END target, count(*) n FROM s WHERE canonical_label <> 'dos_hulk' OR split = 'test' GROUP BY 1, 2",
    "split_cross_dataset": "SELECT 'cicids2018' dataset, 'train' split, Label, count(*) n FROM nf_cicids2018_v3 GROUP BY 3 UNION ALL SELECT 'ton_iot', 'test', Label, count(*) FROM nf_ton_iot_v3 GROUP BY 3",
    "split_host_disjoint": f"SELECT flow_id, src, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END split FROM (SELECT *, {uniform_sql('src', seed=3)} u FROM ({_EV}))",
    "subsample_temporal": f"""WITH {_LAB}, b AS (SELECT *, {_QUOTA} q, floor((rk - 1) * 20 / n) bin FROM rk), k AS (SELECT *, row_number() OVER (PARTITION BY canonical_label, bin ORDER BY {hash_order_sql('flow_id', 1)}, flow_id) r FROM b)
        SELECT flow_id, canonical_label FROM k WHERE q IS NULL OR r <= ceil(q / 20)""",
    "subsample_quota": f"WITH {_LAB} SELECT flow_id, canonical_label FROM rk WHERE coalesce(rk <= {_QUOTA}, true)",
    "near_duplicates": f"""WITH {", ".join(f"{n} AS (SELECT row_number() OVER () r, list_transform(list_value(*COLUMNS(* EXCLUDE (row_id, dataset, canonical_label, FLOW_START_MILLISECONDS, IPV4_SRC_ADDR, IPV4_DST_ADDR, L4_SRC_PORT, L4_DST_PORT))), lambda x: coalesce(x, 0)) f FROM {t})" for n, t in (("a", "train_features"), ("b", "test_features")))},
        h AS (SELECT DISTINCT b.r FROM b JOIN a ON a.f[1] BETWEEN b.f[1] - 1e-6 AND b.f[1] + 1e-6 WHERE list_distance(a.f, b.f) <= 1e-6) SELECT (SELECT count(*) FROM b) n_rows, count(*) n_near, round(count(*) / (SELECT count(*) FROM b), 9) rate FROM h""",
    "sample_rows": f"SELECT flow_id, src FROM ({_EV}) ORDER BY {hash_order_sql('flow_id', 9)}, flow_id LIMIT 500",
    "sample_with_replacement": f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY flow_id) r FROM ({_EV})), d AS (SELECT id draw, {mixed_sql('id', seed=4)} % (SELECT count(*) FROM e) + 1 a FROM range(1, 301) t(id))
        SELECT flow_id, bytes, draw FROM d JOIN e ON r = a""",
    "audit_split": f"""WITH {_LAB}, seen AS (SELECT DISTINCT {_A} FROM s WHERE split = 'train'), m AS (SELECT s.split, s.canonical_label, ms, split <> 'train' AND EXISTS (SELECT 1 FROM seen t WHERE {" AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in _AUDIT)}) hit FROM s)
        SELECT split, canonical_label, count(*) n_rows, min(ms) first_ms, max(ms) last_ms, count(*) FILTER (hit) in_train, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 9) AS "share" FROM m GROUP BY 1, 2""",
    "cross_split_copies": f"WITH {_LAB} SELECT count(*) n_tuples FROM (SELECT {_A} FROM s WHERE split = 'train' INTERSECT SELECT {_A} FROM s WHERE split = 'test')",
    "only_in_test": f"""WITH {_LAB}, c AS (SELECT IPV4_SRC_ADDR, count(*) FILTER (split = 'test') a, count(*) FILTER (split = 'train') b FROM s GROUP BY 1) SELECT IPV4_SRC_ADDR FROM c WHERE a > b""",
    "unseen_pair_rate": f"""WITH {_LAB}, p AS (SELECT * FROM s WHERE IPV4_SRC_ADDR IS NOT NULL AND IPV4_DST_ADDR IS NOT NULL), k AS (SELECT DISTINCT IPV4_SRC_ADDR a, IPV4_DST_ADDR b FROM p WHERE split = 'train')
        SELECT count(*) test_rows, count(*) FILTER (a IS NULL) unseen_rows, round(count(*) FILTER (a IS NULL) / count(*), 9) unseen_rate FROM p LEFT JOIN k ON a = IPV4_SRC_ADDR AND b = IPV4_DST_ADDR WHERE split = 'test'""",
    "host_concentration": f"""WITH {_LAB}, h AS (SELECT canonical_label, IPV4_SRC_ADDR h, count(*) n FROM lab WHERE IPV4_SRC_ADDR IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY n DESC, h) r FROM h)
        SELECT canonical_label, sum(n)::BIGINT n_rows, count(*) n_hosts, max(n) top_rows, max(h) FILTER (r = 1) top_host, round(max(n) / sum(n), 9) top_share FROM r GROUP BY 1""",
}
