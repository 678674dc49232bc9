"""Training, attacks on raw flows, explanations of lists, live streams, hashes and quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators import adversarial, explain, graph, metrics, prototypes, splits, train
from flowmill.operators.ranking import HASHES, mixed, mixed_number, quantiles, ranked
from flowmill.streaming import detector


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- ranks, quantiles, hashes ------------------------------------------------------


def test_ranks_and_running_sums_over_hot_and_null_groups(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), rng.choice([None, -2, 1, 5])) for i in range(2000)]
    df = spark.createDataFrame(data, "id bigint, g string, v int, w bigint").repartition(7)
    got = {r["id"]: r for r in ranked(df, ["g"], [F.desc("v"), F.asc("id")], {"w": F.col("w")}, 6).collect()}
    for g in ("a", "b", None):
        mine = sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0]))
        run, total = 0, sum(d[3] or 0 for d in mine)
        for k, d in enumerate(mine, 1):
            run += d[3] or 0
            r = got[d[0]]
            assert (r["rank"], r["group_rows"], r["run_w"], r["all_w"]) == (k, len(mine), run, total)
    assert ranked(df.limit(0), ["g"], [F.col("id")], {"w": F.col("w")}).collect() == []


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    data = {"x": rng.normal(size=301).round(1), "y": np.array([3.0]), "z": rng.integers(0, 3, size=100).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("x", None), ("x", float("nan")), ("none", None)], "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(g, q): (v, n) for g, q, v, n in rows(quantiles(df, ["g"], F.col("v"), qs))}
    assert set(got) == {(g, q) for g in data for q in qs}
    assert all(np.isclose(got[g, q][0], np.quantile(vs, q)) and got[g, q][1] == len(vs) for g, vs in data.items() for q in qs)
    assert quantiles(df.limit(0), [], F.col("v"), qs).collect() == [] and metrics.threshold(df.limit(0), "v", 0.5).first()[0] == 0.0


def test_no_quantile_gathers_rows_in_one_task(spark):
    df = spark.range(1000).withColumn("g", F.lit("a"))
    plan = quantiles(df, ["g"], F.col("id"), [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_hashes_agree_and_spread(spark):
    got = spark.range(3_000_000, 3_000_400).select("id", mixed(F.col("id"), 7, seed=3))
    assert all(h == mixed_number(i, 7, seed=3) and 0 <= h < HASHES for i, h in rows(got))
    far = spark.createDataFrame([(7 + i * 1_000_003,) for i in range(200)], "id bigint").select(mixed(F.col("id")))
    assert len(set(rows(far))) == 200


def test_random_rows_reach_large_tables(spark):
    got = [r["id"] for r in splits.random_rows(spark.range(2_500_000), 300, "id", 2).collect()]
    assert len(set(got)) == 300 and all(60 < sum(k * 833_334 <= i < (k + 1) * 833_334 for i in got) < 140 for k in range(3))


def test_bootstrap_counts_equal_weighted_rows(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7) % 3 if i % 5 else None) for i in range(300)], "id bigint, y int, p int")
    c = metrics.bootstrap_counts(df, ["y", "p"], "id", 20)
    n = dict(rows(c.groupBy("resample").agg(F.sum("n"))))
    m = {r["resample"]: r["n"] for r in metrics.bootstrap_means(df, {"one": F.lit(1.0)}, "id", 20).collect()}
    assert n == m and all(200 < v < 400 for v in n.values())
    with pytest.raises(ValueError):
        metrics.bootstrap_counts(df, ["id"], "id", 2, max_groups=10)


def test_gaps_across_blocks_and_ties(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.choice([rng.randrange(20_000), 5000]), i % 2) for i in range(400)]
    df = spark.createDataFrame(data, "flow_id bigint, src string, ms bigint, bin bigint")
    got = {r["flow_id"]: r["gap_ms"] for r in graph.send_gaps(df, 500).collect()}
    for key in {(d[1], d[3]) for d in data}:
        mine = sorted((d for d in data if (d[1], d[3]) == key), key=lambda d: (d[2], d[0]))
        assert [got[d[0]] for d in mine] == [None, *[b[2] - a[2] for a, b in zip(mine, mine[1:], strict=False)]]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 5)).round(2)
    near = base[:20] + rng.normal(size=(20, 5)) * rng.choice([1e-8, 1e-3], size=(20, 1))
    names = [f"f{i}" for i in range(5)]
    make = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id bigint, " + ", ".join(f"{n} double" for n in names))
    test = np.vstack([near, near[:3], rng.normal(size=(10, 5))])
    want = int((np.linalg.norm(test[:, None] - base[None], axis=2).min(axis=1) <= 1e-6).sum())
    r = splits.near_duplicate_rate(make(test), make(base), names, "id").first()
    assert (r["n_rows"], r["n_near"]) == (33, want) and 0 < want < 33
    assert splits.near_duplicate_rate(make(test).limit(0), make(base), names, "id").first()["rate"] == 0.0


# --- training -------------------------------------------------------------------------


def _blobs(spark, n=300):
    rng = np.random.default_rng(2)
    centres = np.array([[3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 3, 0]])
    return spark.createDataFrame([(i, i % 3, [float(x) for x in centres[i % 3] + rng.normal(size=4)]) for i in range(n)] + [(n, None, [0.0] * 4), (n + 1, 0, None)], "id bigint, y int, z array<double>")


def test_a_head_is_learned_and_goes_on_from_a_checkpoint(spark, tmp_path):
    df = _blobs(spark)
    own, held = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    whole = train.fit_head(own, held, "z", "y", 3, 4, epochs=12, rate=0.3)
    assert whole.history[-1]["val_loss"] < whole.history[0]["val_loss"] * 0.7
    path = f"file://{tmp_path}/head"
    train.fit_head(own, held, "z", "y", 3, 4, epochs=5, rate=0.3, path=path)
    again = train.fit_head(own, held, "z", "y", 3, 4, epochs=12, rate=0.3, path=path)
    assert [h["epoch"] for h in again.history] == list(range(12)) and np.allclose(again.parameters["w"], whole.parameters["w"], atol=1e-6)


def test_early_stop_keeps_the_best(spark):
    df = _blobs(spark)
    wrong = df.withColumn("y", (F.col("id") * 7 + F.floor(F.col("id") / 5)).cast("int") % 3)  # labels that training cannot help
    fit = train.fit_head(df, wrong, "z", "y", 3, 4, epochs=60, rate=0.3, patience=2)
    assert fit.stopped and len(fit.history) < 60 and fit.history[fit.best]["val_loss"] == min(h["val_loss"] for h in fit.history)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, size=7).astype(float)
    for loss, p in ((train.am_softmax_loss(), {"w": rng.normal(size=(3, 4))}), (train.autoencoder_loss, {"a": rng.normal(size=(4, 2)), "b": rng.normal(size=2), "c": rng.normal(size=(2, 4)), "d": rng.normal(size=4)})):
        _, g = loss(p, x, y)
        for n, v in p.items():
            for at in list(np.ndindex(v.shape))[:4]:
                up, down = {**p, n: v.copy()}, {**p, n: v.copy()}
                up[n][at] += 1e-6
                down[n][at] -= 1e-6
                assert np.isclose((loss(up, x, y)[0] - loss(down, x, y)[0]) / 2e-6, g[n][at], atol=1e-4)


def test_autoencoder_finds_the_odd_row(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(t), float(2 * t), float(-t)]) for i, t in enumerate(rng.uniform(-1, 1, 200))], "id bigint, z array<double>")
    fit = train.fit_autoencoder(df, df, F.col("z"), 3, 1, epochs=60, rate=0.05)
    odd = spark.createDataFrame([(0, [0.5, 1.0, -0.5]), (1, [1.0, -2.0, 1.0])], df.schema)
    s = dict(rows(odd.select("id", train.reconstruction_error(F.col("z"), fit))))
    assert s[1] > 5 * s[0]


# --- prototypes, streams ----------------------------------------------------------------


def test_a_class_of_two_kinds_gets_two_prototypes(spark):
    bank = prototypes.class_means(_blobs(spark).filter("y = 0"), "y", "z", 4)
    kinds = spark.createDataFrame([(i, [0.0, 0.0, 1.0 if i % 2 else 0.1, 0.1 if i % 2 else 1.0]) for i in range(40)], "id bigint, z array<double>")
    new = prototypes.register_class(bank, kinds, "z", 7, 4, 2)
    assert new.filter("class_id = 7").count() == 2 and rows(new.filter("class_id = 0").select("proto")) == rows(bank.select("proto"))
    assert prototypes.register_class(bank, kinds.limit(5), "z", 7, 4, 2).filter("class_id = 7").count() == 1
    assert prototypes.register_class(bank, kinds.limit(0), "z", 7, 4, 2).filter("class_id = 7").count() == 0


def test_a_class_registered_between_batches_is_named_in_the_next(spark, tmp_path):
    df = _blobs(spark).filter("y IS NOT NULL AND z IS NOT NULL")
    live = detector.LiveDetector(spark, f"file://{tmp_path}/bank", "z", 4, theta_unknown=0.0, theta_defer=0.0)
    live.start(prototypes.class_means(df.filter("y < 2"), "y", "z", 4))
    for part in (0, 1):
        df.filter(F.col("id") % 2 == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = live.to(f"{tmp_path}/out", ["id", "decision"])

    def each(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 0:
            live.register(df.filter("y = 2"), 2)

    source.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    n = dict(rows(got.groupBy("batch").agg(F.sum((F.col("decision") == 2).cast("int")))))
    assert n[0] == 0 and n[1] > 20 and got.count() == 300
    assert detector.footprint(spark, prototypes.class_means(df, "y", "z", 4))["parameters"] == 12


# --- attacks, explanations -----------------------------------------------------------------


def test_injected_edges_move_the_mean_more_than_the_trimmed_mean(spark):
    lists = spark.createDataFrame([(t, i, 1.0 + i / 100) for t in (1, 2) for i in range(10)], "target_id bigint, flow_id bigint, value double")
    inj = spark.createDataFrame([(1, 2, i, 50.0) for i in range(2)], "target_id bigint, budget int, i bigint, value double")
    r = adversarial.injection_shift(lists, inj).collect()
    assert len(r) == 1 and r[0]["mean_shift"] > 5 and r[0]["trimmed_shift"] < 0.1


def test_masks_keep_the_edges_that_speak_for_the_prototype(spark):
    l = [(i, 0.25, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for i in range(4)]
    df = spark.createDataFrame([("g", l), ("one", l[:1])], "grp string, l array<struct<flow_id: bigint, w: double, m: array<double>>>")
    r = {x["grp"]: x for x in explain.edge_masks(df, "grp", [1.0, 0.0]).collect()}
    assert min(r["g"]["masks"][:2]) > 0.5 > max(r["g"]["masks"][2:]) and r["g"]["masked_score"] > r["g"]["score"] + 0.2
    assert len(r["one"]["masks"]) == 1


def test_counterfactual_takes_turns_over_scales(spark):
    df = spark.createDataFrame([("g", "long", 1, 5.0), ("g", "long", 2, 4.0), ("g", "mid", 3, 1.0), ("h", "mid", 4, 1.0)], "g string, s string, id bigint, c double")
    r = {x["g"]: x for x in explain.counterfactual_round_robin(df, "g", "s", "c", "id", F.lit(4.5)).collect()}
    assert r["g"]["needed"] == 2 and r["h"]["needed"] == 1  # 5, then 1 of the other scale, leave 4


def test_vectors_of_unit_length(spark):
    assert spark.range(1).select(vec.norm(vec.unit(F.array(F.lit(3.0), F.lit(4.0))))).first()[0] == 1.0
