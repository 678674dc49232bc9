"""The encoder against plain NumPy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from flowmill.operators import encoder, graph


def _graph(spark):
    rng = random.Random(4)
    rows = [(i, 1_000_000 + rng.randrange(40_000), f"h{rng.randrange(6)}", f"h{rng.randrange(6)}", rng.random()) for i in range(120)]
    return rows, spark.createDataFrame(rows, "flow_id bigint, ms bigint, src string, dst string, x double")


def test_nodes_of_a_bin_share_one_space(spark):
    rows, edges = _graph(spark)
    nodes, context, targets = encoder.bin_batch(edges, {"short": 1_000, "long": 10_000}, 1_000, 4)
    t0 = min(r[1] for r in rows)
    per = {}
    for n in nodes.collect():
        per.setdefault(n["bin"], {})[n["node"]] = n["place"]
    assert set(per) == {(r[1] - t0) // 1000 for r in rows}
    for b, names in per.items():
        assert [names[k] for k in sorted(names)] == list(range(len(names)))
    for c in context.collect():
        assert c["src"] in per[c["bin"]] and c["dst"] in per[c["bin"]] and 0 <= c["dt_s"] <= 10
    assert context.groupBy("bin", "scale", "dst").count().agg(F.max("count")).first()[0] <= 4
    assert targets.count() == len(rows)


def test_dense_pads_and_masks(spark):
    df = spark.createDataFrame([(1, 5, "a", 1.0), (2, 4, "a", 2.0), (3, 9, "b", 3.0)], "flow_id bigint, ms bigint, g string, x double")
    got = {r["g"]: r for r in encoder.dense(df, ["g"], F.array("x", F.lit(0.5)), 3, 2).collect()}
    assert got["a"]["slots"] == [[2.0, 0.5], [1.0, 0.5], [0.0, 0.0]] and got["a"]["mask"] == [True, True, False]
    assert got["b"]["slots"][0] == [3.0, 0.5] and got["b"]["mask"] == [True, False, False]


def _gelu(x):
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def test_a_layer_equals_numpy_and_resists_a_corrupt_message(spark):
    w = encoder.Layer(encoder.given(3, 3 + 1 + 4, "m"), encoder.given(3, 6, "u"))
    h = {f"n{i}": np.array([i, 1.0, -i / 2]) for i in range(8)}
    states = spark.createDataFrame([(0, n, [float(x) for x in v]) for n, v in h.items()], "bin bigint, node string, h array<double>")
    for bad in (0.0, 1e6):
        e = [(0, f"n{i}", "n7", i, float(i), [bad if i == 3 else 0.1 * i]) for i in range(7)]
        edges = spark.createDataFrame(e, "bin bigint, src string, dst string, flow_id bigint, dt_s double, e array<double>")
        got = {r["node"]: np.array(r["h"]) for r in encoder.layer(edges, states, w, 3, 10.0).collect()}
        codes = lambda t: [t, *[math.sin(2 * math.pi / (0.1 * (6000 ** (1 / 2)) ** i) * t) for i in range(3)]]
        m = np.array([_gelu(np.array(w.message) @ np.concatenate([h[s], x, codes(t)])) for _, s, _, _, t, x in e])
        a = np.array([2.0 ** (-t / 10.0) for *_, t, _ in e])
        a /= a.sum()
        agg = []
        for j in range(3):
            o = np.argsort(m[:, j], kind="stable")[1:-1]
            agg.append((a[o] * m[o, j]).sum() / a[o].sum())
        want = h["n7"] + _gelu(np.array(w.update) @ np.concatenate([h["n7"], agg]))
        assert np.allclose(got["n7"], want) and np.abs(got["n7"]).max() < 100
        assert np.allclose(got["n0"], h["n0"] + _gelu(np.array(w.update) @ np.concatenate([h["n0"], np.zeros(3)])))


def test_graph_norm(spark):
    states = spark.createDataFrame([(b, str(i), [float(i * b), 2.0]) for b in (1, 3) for i in range(5)], "bin bigint, node string, h array<double>")
    got = np.array([r["h"] for r in encoder.graph_norm(states, "bin", 2).filter("bin = 3").collect()])
    assert np.allclose(got.mean(axis=0), 0) and np.allclose(got[:, 0].std(), 1, atol=1e-4) and np.allclose(got[:, 1], 0)


def test_memory_folds_in_time_order_and_forgets(spark):
    gates = {g: encoder.given(2, 3, g) for g in "zrn"}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def step(h, x):
        xh = np.concatenate([x, h])
        z, r = sig(np.array(gates["z"]) @ xh), sig(np.array(gates["r"]) @ xh)
        return (1 - z) * np.tanh(np.array(gates["n"]) @ np.concatenate([x, r * h])) + z * h

    rows = [(1, 10, "a", [0.5]), (3, 30, "a", [2.0]), (2, 20, "a", [1.0]), (4, 10, "b", [1.0]), (5, 10_000, "b", [3.0])]
    df = spark.createDataFrame(rows, "flow_id bigint, ms bigint, src string, x array<double>")
    got = {r["src"]: r for r in encoder.node_memory(df, "src", "x", gates, 2, forget_ms=1000).collect()}
    h = np.zeros(2)
    for x in (0.5, 1.0, 2.0):
        h = step(h, np.array([x]))
    assert np.allclose(got["a"]["memory"], h) and got["a"]["n"] == 3
    assert np.allclose(got["b"]["memory"], step(np.zeros(2), np.array([3.0]))) and got["b"]["last_ms"] == 10_000
    capped = encoder.node_memory(df, "src", "x", gates, 2, k=1).filter("src = 'a'").first()
    assert np.allclose(capped["memory"], step(np.zeros(2), np.array([2.0])))


def test_encoding_over_scales(spark):
    _, edges = _graph(spark)
    widths = {"short": 1_000, "mid": 5_000, "long": 10_000}
    nodes, context, targets = encoder.bin_batch(edges, widths, 1_000, 4)
    states = nodes.select("bin", "node", F.array((F.col("place") / 10.0), F.lit(1.0)).alias("h"))
    w = encoder.Weights(2, 1, 4, 1)
    e = F.array("x")
    z = encoder.encode(context.withColumn("e", e), targets.withColumn("e", e), states, w, widths).collect()
    assert sorted(r["flow_id"] for r in z) == list(range(120)) and all(abs(sum(r["shares"]) - 1) < 1e-9 and len(r["z"]) == 2 for r in z)
    assert graph.CAP == 32
