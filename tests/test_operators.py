"""Invariants of the core operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill import config, schema
from flowmill.functions import vec
from flowmill.functions.mathx import probit
from flowmill.functions.text import ipv4, label_key
from flowmill.operators import adversarial, baselines, clean, explain, features, graph, metrics, prototypes, robust, skew, splits
from flowmill.operators.ranking import ranked
from flowmill.sources import io


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- texts ------------------------------------------------------------------


def test_addresses(spark):
    same = ["10.0.0.7", " 10.0.0.7", "10.0.0.7\n", "\t10.0.0.7\xa0", "010.000.00.007", "10.0.0.7:443", "10.0.0.7/32", "::ffff:10.0.0.7", "0:0:0:0:0:FFFF:10.0.0.7", "[10.0.0.7]", "'10.0.0.7'", "[::ffff:10.0.0.7]:80"]
    none = [None, "", "-", "n/a", "10.0.0", "10.0.0.256", "10.0.0.7.1", "10.0.0.x", "1234.0.0.1", "fe80::1", "10.0.0.7 10.0.0.8"]
    df = spark.createDataFrame([(t,) for t in same + none], "t string")
    got = [r[0] for r in df.select(ipv4("t")).collect()]
    assert got == ["10.0.0.7"] * len(same) + [None] * len(none)


def test_label_keys(spark):
    df = spark.createDataFrame([("DoS_attacks-Hulk",), (" dos attacks__hulk\t",), ("DOS-ATTACKS - HULK\n",), ("doshulk",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(label_key("t")).collect()]
    assert got[0] == got[1] == got[2] == "dos attacks hulk" and got[3:] == ["doshulk", None, ""]


# --- problem 1 -----------------------------------------------------------------


def _join_brute(left, right):
    out = {}
    for k in {k for k, _ in left + right if k is not None}:
        ls, rs = [v for a, v in left if a == k], [v for a, v in right if a == k]
        usable = lambda vs: sum(v for v in vs if v is not None)
        out[k] = (len(ls), len(rs), len(ls) * len(rs), usable(ls) * len(rs), usable(rs) * len(ls))
    return out


def test_eager_aggregation_equals_the_join(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice(["hot"] * 8 + ["a", "b", "c", None]), rng.choice([1.0, 2.5, None])) for _ in range(n)]
    left, right = make(300) + [("only", 4.0)], make(200)
    frame = lambda d: spark.createDataFrame(d, "k string, v double").withColumn("_key", F.lit("clash")).withColumn("l_rows", F.lit(0))
    j = skew.eager_join_aggregate(frame(left), frame(right), F.col("k"), F.col("k"), {"v": F.col("v")}, {"v": F.col("v")})
    got = {r["key"]: (r["l_rows"], r["r_rows"], int(r["pair_rows"]), r["pair_l_v"], r["pair_r_v"]) for r in j.collect()}
    assert got == _join_brute(left, right)
    inner = skew.eager_join_aggregate(frame(left), frame(right), F.col("k"), F.col("k"), how="inner")
    assert {r["key"] for r in inner.collect()} == {"hot", "a", "b", "c"}


def test_eager_aggregation_of_nothing(spark):
    e = spark.createDataFrame([], "k string, v double")
    j = skew.eager_join_aggregate(e, e, F.col("k"), F.col("k"), {"v": F.col("v")})
    assert rows(j) == [] and rows(skew.heavy_keys(j, "l", "r", 0.05)) == []


def test_heavy_keys_at_the_border(spark):
    left = spark.createDataFrame([("a",)] * 5 + [(f"k{i}",) for i in range(95)] + [(None,)] * 50, "k string")
    right = spark.createDataFrame([("z",)], "k string")
    j = skew.eager_join_aggregate(left, right, F.col("k"), F.col("k"))
    assert sorted(r[:2] for r in rows(skew.heavy_keys(j, "l", "r", 0.05))) == [("l", "a"), ("r", "z")]


# --- ranks ---------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randrange(20), i, 1.0) for i in range(400)]
    df = spark.createDataFrame(data, "g string, t int, id int, v double").repartition(parts)
    got = {r["id"]: (r["rank"], r["group_rows"], r["run_v"]) for r in ranked(df, ["g"], [F.col("t"), F.col("id")], {"v": F.col("v")}, parts).collect()}
    for g in ("hot", "b", None):
        order = sorted((t, i) for gg, t, i, _ in data if gg == g)
        assert all(got[i] == (k + 1, len(order), float(k + 1)) for k, (_, i) in enumerate(order))


# --- cleaning and splits ------------------------------------------------------------


def test_strict_labels_raise(spark):
    vocab = spark.createDataFrame([("d", "Benign", "benign", "benign")], "dataset string, raw_label string, canonical_label string, family string")
    df = spark.createDataFrame([("Benign",), ("NotALabel",)], "Attack string")
    with pytest.raises(Exception, match="label unknown"):
        clean.canonical_labels(df, vocab, "d", strict=True).collect()
    assert [r[1] for r in rows(clean.canonical_labels(df, vocab, "d").select("Attack", "canonical_label").orderBy("Attack"))] == ["benign", None]


def test_source_guard_raises(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    with pytest.raises(ValueError):
        clean.require_sources(df, "s")
    clean.require_sources(df, "s", "ip_port")


def test_feasible_set(spark):
    df = spark.createDataFrame([(2.5, 10.0, 3, 50.0, 10.0, -5.0, 30.0)], "IN_PKTS double, IN_BYTES double, OUT_PKTS int, SRC_TO_DST_IAT_MIN double, SRC_TO_DST_IAT_AVG double, SRC_TO_DST_IAT_STDDEV double, SRC_TO_DST_IAT_MAX double")
    r = clean.feasible(df).first()
    assert r["IN_PKTS"] == 2 and r["IN_BYTES"] == 80 and r["SRC_TO_DST_IAT_STDDEV"] == 0
    assert r["SRC_TO_DST_IAT_MIN"] <= r["SRC_TO_DST_IAT_AVG"] <= r["SRC_TO_DST_IAT_MAX"]


def test_copies_across_splits_raise(spark):
    s = spark.createDataFrame([("train", "a", 1, 5), ("test", "a", 2, 5), ("test", "b", 3, 6)], "split string, cls string, ms int, x int")
    with pytest.raises(ValueError, match="occur again"):
        splits.require_clean(s, "cls", "ms", ["x"])
    with pytest.raises(ValueError, match="absent"):
        splits.require_clean(s.filter("x <> 5 OR split = 'train'"), "cls", "ms", ["x"])


def test_holdouts_are_distinct_and_seeded():
    a = splits.holdout_sets(list("abcde"), 2, 6, 3)
    assert a == splits.holdout_sets(list("abcde"), 2, 6, 3) and len(set(a)) == 6 and all(len(set(s)) == 2 for s in a)
    assert len(splits.holdout_sets(list("abc"), 2, 99)) == 3


def test_quota_plan_keeps_minorities():
    q = splits.plan_quotas({"benign": 9000, "dos": 5000, "rare": 20}, 4000, 100, "benign")
    assert "rare" not in q and q["benign"] >= 2000 and sum(q.values()) + 20 <= 4000


# --- features ---------------------------------------------------------------------------


def test_channels_cover_all_features_and_unknown_ones_raise():
    assert len(schema.RAW_FEATURES) == 53 and len(schema.FLOW_SCHEMA) == 55
    with pytest.raises(ValueError):
        features.channels(["IN_BYTES", "no_such_feature"])


def test_pipeline_survives_saving(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.001/nf_cicids2018_v3.parquet")
    p = features.FeaturePipeline(quantiles=50).fit(t)
    p.save(str(tmp_path / "p.json"))
    q = features.FeaturePipeline.load(str(tmp_path / "p.json"))
    a, b = p.transform(t, ["flow_id"]).orderBy("flow_id"), q.transform(t, ["flow_id"]).orderBy("flow_id")
    assert a.columns == b.columns and rows(a) == rows(b)
    assert all(v is not None and math.isfinite(v) for r in rows(a) for v in r)
    left, right = features.channels(a.columns[1:])
    assert len(left) + len(right) == p.manifest()["n_features"]
    bare = features.FeaturePipeline(quantiles=50, temporal=False).fit(t).transform(t)
    assert not set(schema.HEAVY_TAILED) & set(bare.columns) and "iat_cv_fwd" not in bare.columns


def test_probit(spark):
    got = [r[0] for r in spark.createDataFrame([(p,) for p in (1e-6, 0.025, 0.5, 0.9, 0.999)], "p double").select(probit(F.col("p"))).collect()]
    assert np.allclose(got, [-4.753424, -1.959964, 0.0, 1.281552, 3.090232], atol=1e-6)


# --- graph ---------------------------------------------------------------------------------


def _edges(spark, n=600, nodes=12):
    rng = random.Random(4)
    data = sorted(rng.randrange(60_000) for _ in range(n))
    return spark.createDataFrame([(i, t, str(rng.randrange(nodes)), str(rng.randrange(nodes))) for i, t in enumerate(data)], "flow_id bigint, ms bigint, src string, dst string")


def test_windows_never_look_ahead(spark):
    b = graph.anchor_bins(_edges(spark))
    for r in graph.window_edges(b, 5_000).collect():
        assert r["end_ms"] - 5_000 <= r["ms"] <= r["end_ms"] and r["dt_s"] >= 0


@pytest.mark.parametrize("strategy", ["recent", "uniform", "recency_stratified"])
def test_samplers_cap_and_repeat(spark, strategy):
    e = _edges(spark)
    take = lambda d: sorted(rows(graph.neighbours(d, ["dst"], 8, strategy).select("dst", "flow_id")))
    got = take(e)
    assert got == take(e.repartition(5)) and max(sum(r[0] == n for r in got) for n, _ in got) == 8
    with pytest.raises(ValueError):
        graph.neighbours(e, ["dst"], 8, "other")


def test_beacon_has_a_sharp_spectrum(spark):
    beacon = [(i, i * 1000, "b", f"x{i}") for i in range(64)]
    rng = random.Random(1)
    noise = [(100 + i, rng.randrange(64_000), "r", f"y{i}") for i in range(64)]
    s = {r["node"]: r for r in graph.spectrum(graph.anchor_bins(spark.createDataFrame(beacon[::8] + noise, "flow_id bigint, ms bigint, src string, dst string"), 64_000), 64_000).collect()}
    assert s["b"]["flatness"] < s["r"]["flatness"] and s["x0"]["entropy"] == 0.0


# --- robust aggregates --------------------------------------------------------------------------


def _messages(spark, values):
    return spark.createDataFrame([(i, "g", float(v), 1 / len(values)) for i, v in enumerate(values)], "flow_id bigint, grp string, value double, weight double")


def test_trimming_ignores_corrupt_tails(spark):
    base = [float(i) for i in range(20)]
    agg = lambda v: robust.trimmed_mean(_messages(spark, v), ["grp"]).first()["agg"]
    assert agg(base) == pytest.approx(agg([-1e6] * 4 + base[4:16] + [1e6] * 4))
    assert abs(agg(base[:8] + [50.0] * 12) - agg(base)) > 5
    with pytest.raises(ValueError):
        robust.trimmed_mean(_messages(spark, base), ["grp"], 0.5)


def test_soft_medoid_moves_less_than_the_mean(spark):
    v = [[0.1 * i, 0.0] for i in range(15)] + [[100.0, 100.0]]
    df = spark.createDataFrame([(i, "g", x, 1 / 16) for i, x in enumerate(v)], "flow_id bigint, grp string, vec array<double>, weight double")
    m = robust.soft_medoid(df, "grp").first()["agg"]
    assert np.linalg.norm(m) < 0.2 * np.linalg.norm(np.mean(v, axis=0))


# --- prototypes --------------------------------------------------------------------------------------


def _vectors(spark, n=90, dim=6, classes=3):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(classes, dim)) * 3
    return spark.createDataFrame([(i, i % classes, [float(x) for x in centres[i % classes] + rng.normal(size=dim)]) for i in range(n)], "id bigint, y int, z array<double>")


def test_evidence_is_a_distribution(spark):
    df = _vectors(spark)
    s = prototypes.decide(prototypes.evidence(prototypes.cosines(df, prototypes.class_means(df, "y", "z", 6), "z")), 0.0, None)
    for r in s.collect():
        assert abs(sum(r["p"]) - 1) < 1e-9 and 0 < r["vacuity"] <= 1 and r["decision"] in (-2, 0, 1, 2)
        assert all(-15 <= x <= 15 for x in r["log_e"])


def test_registering_a_class_moves_no_old_score(spark):
    df = _vectors(spark)
    old = prototypes.class_means(df.filter("y < 2"), "y", "z", 6)
    new = prototypes.register_class(old, df.filter("y = 2"), "z", 2, 6)
    a = {r["id"]: r["cos"] for r in prototypes.cosines(df, old, "z").collect()}
    b = {r["id"]: r["cos"] for r in prototypes.cosines(df, new, "z").collect()}
    assert all(b[k][:2] == a[k] for k in a) and all(len(v) == 3 for v in b.values())


def test_attributions_are_complete(spark):
    df = _vectors(spark)
    o = df.join(prototypes.class_means(df, "y", "z", 6), F.col("y") == F.col("class_id"))
    assert o.agg(F.max(explain.completeness_gap(F.col("z"), F.col("proto"), 0.1, 0.2))).first()[0] < 1e-9
    base = F.transform("proto", lambda p: p * 0.5)
    ig = o.select(vec.total(explain.integrated_gradients(F.col("z"), base, F.col("proto"), 0.1, 200)), (vec.cosine(F.col("z"), F.col("proto")) - vec.cosine(base, F.col("proto"))) / 0.1)
    assert all(abs(a - b) < 0.02 for a, b in rows(ig))


# --- metrics -------------------------------------------------------------------------------------------


def test_curves_on_ties_and_extremes(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.9, False), (3, 0.1, False), (4, 0.95, True)], "id bigint, s double, pos boolean")
    assert metrics.roc_auc(df, "s", F.col("pos")).first()["auroc"] == pytest.approx(0.875)
    one = df.filter("pos")
    assert metrics.roc_auc(one, "s", F.col("pos")).first()["auroc"] is None
    assert metrics.pr_auc(one, "s", F.col("pos")).first()["pr_auc"] == pytest.approx(1.0)


def test_perfect_predictions(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(30)], "id bigint, y int, p int")
    r = metrics.closed_set(metrics.confusion(df, "y", "p")).first()
    assert (r["accuracy"], r["macro_f1"], r["mcc"]) == (1.0, 1.0, 1.0)
    assert tuple(metrics.clusters(df, "y", "p").first()) == pytest.approx((1.0, 1.0, 1.0))


def test_weibull_fit_recovers_its_parameters():
    rng = np.random.default_rng(0)
    shape, scale = baselines.weibull_fit(list(3.0 * rng.weibull(1.7, 20_000)))
    assert abs(shape - 1.7) < 0.05 and abs(scale - 3.0) < 0.05 and baselines.weibull_fit([1.0]) == (1.0, 1.0)


# --- attacks ------------------------------------------------------------------------------------------------


def test_zero_budgets_change_nothing(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/nf_cicids2018_v3.parquet").select("flow_id", "SRC_TO_DST_IAT_AVG", "FLOW_DURATION_MILLISECONDS").filter("SRC_TO_DST_IAT_AVG >= 0 AND FLOW_DURATION_MILLISECONDS >= 0")
    j = adversarial.jitter(t, "flow_id", (0.0, 0.5))
    zero = j.filter("sigma = 0").join(t.withColumnRenamed("SRC_TO_DST_IAT_AVG", "was"), "flow_id")
    assert zero.filter("NOT (SRC_TO_DST_IAT_AVG <=> was) OR duration_change <> 0").isEmpty()
    v = _vectors(spark)
    assert adversarial.spsa_attack(v, "z", [1.0] * 6, 0.0).filter("NOT (attacked <=> z)").isEmpty()
    moved = adversarial.spsa_attack(v, "z", [1.0] * 6, 0.2).select(vec.total(F.col("attacked")) - vec.total(F.col("z")))
    assert all(r[0] > 0 for r in rows(moved))


def test_injection_adds_context_before_the_target(spark):
    e = _edges(spark, 80).withColumn("bytes", F.lit(1.0))
    inj = adversarial.inject_edges(e.filter("flow_id < 5"), e, 10_000, (0, 3, 8), "all_strata")
    at = {r["flow_id"]: r["ms"] for r in e.collect()}
    got = inj.collect()
    assert len(got) == 5 * 11 and all(r["ms"] < at[r["target_id"]] and r["is_injected"] for r in got)
    with pytest.raises(ValueError):
        adversarial.inject_edges(e, e, 10, (1,), "elsewhere")


def test_the_gate_slows_poison(spark):
    bank = prototypes.class_means(_vectors(spark), "y", "z", 6)
    far = [-x for x in bank.filter("class_id = 0").first()["proto"]]
    drift = lambda gate: {r["class_id"]: r["drift"] for r in adversarial.poison_drift(bank, far, 0.5, gate=gate).collect()}[0]
    assert drift(0.5) == 0.0


# --- settings, files ---------------------------------------------------------------------------------------------


def test_settings_are_strict(tmp_path):
    assert config.load(overrides=["graph.cap=64"])["graph"]["cap"] == 64
    for bad in ("graph.capp=1", "nothing.here=2"):
        with pytest.raises(KeyError):
            config.load(overrides=[bad])
    for bad in ("model.trim_beta=0.5", "model.norm=batch", "graph.sampler=best", "data.dataset=bot_iot", "model.tau_final=0.01"):
        with pytest.raises(ValueError):
            config.load(overrides=[bad])


def test_registry_is_idempotent_and_skips_broken_files(tmp_path, spark):
    r = io.Registry(spark, f"{tmp_path}/runs")
    assert r.runs().collect() == [] and r.register("a", f1=0.5) and not r.register("a", f1=0.6)
    (tmp_path / "runs" / "odd.json").write_text("{not json\n")
    assert r.register("b") and r.is_complete("b") and not r.is_complete("c")
    assert {x["run_id"]: x["facts"].get("f1") for x in r.runs().collect()} == {"a": "0.5", "b": None}
    planned = spark.createDataFrame([("a",), ("c",)], "run_id string")
    assert rows(io.pending_runs(planned, r.runs())) == [("c",)]


def test_event_log_and_checkpoints(tmp_path, spark):
    log = io.EventLog(spark, f"{tmp_path}/log")
    log.log("begin", n=1), log.metric("f1", 0.5, 3)
    assert {(x["event"], x["value"]) for x in io.read_events(spark, f"{tmp_path}/log").collect()} == {("begin", None), ("metric", 0.5)}
    assert io.load_checkpoint(spark, f"{tmp_path}/model") is None
    rng = np.random.default_rng(3)
    io.save_checkpoint(spark, f"{tmp_path}/model", 1, {"w": np.zeros((2, 3))}, {"loss": 0.5}, rng)
    io.save_checkpoint(spark, f"{tmp_path}/model", 2, {"w": np.arange(6.0).reshape(2, 3), "b": np.array([])}, {"loss": 0.25}, rng)
    c, first = io.load_checkpoint(spark, f"{tmp_path}/model"), io.load_checkpoint(spark, f"{tmp_path}/model", 1)
    assert c["epoch"] == 2 and c["facts"] == {"loss": 0.25} and (c["parameters"]["w"] == np.arange(6.0).reshape(2, 3)).all() and c["parameters"]["b"].size == 0
    assert c["rng"].random() == first["rng"].random() == rng.random()


def test_json_is_plain(tmp_path, spark):
    io.save_json(io.assemble_report(a={"x": np.float64(1.5), "y": float("nan"), "z": np.arange(2)}, b=None), str(tmp_path / "r.json"))
    r = io.load_json(str(tmp_path / "r.json"))
    assert r == {"a": {"x": 1.5, "y": None, "z": [0, 1]}} and io.nested(r, "a.x") == 1.5 and io.nested(r, "a.q.r", 7) == 7
    with pytest.raises(ValueError):
        io.dataset_file("other")
