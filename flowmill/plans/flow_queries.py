"""The graph operators on raw flows: addresses, ports, bytes, windows of 1, 30
and 300 seconds, flows that arrive late; and the encoder over them.

Flows without two addresses or a plausible start time are no edges. The SQL of
the graph queries is that of ``graph_queries`` over flows, its hours read as the
scales used here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill import schema
from flowmill.functions import vec
from flowmill.functions.text import ipv4, ipv4_sql, measure, measure_sql
from flowmill.operators import encoder, graph, prototypes
from flowmill.plans import graph_queries as events
from flowmill.plans.shared import materialise
from flowmill.sources.tables import table

FLOWS = "nf_ton_iot_v3"
BIN, SHORT, MID, LONG = 1_000, 1_000, 30_000, 300_000
TIMEOUTS = (15, 30, 60, 120, 300, 600)
LOW, HIGH = schema.VALID_MS


def edges(spark: SparkSession, d: str, name: str = FLOWS) -> DataFrame:
    """``flow_id, ms, src, dst, port, bytes`` of the flows that are edges."""
    t = table(spark, d, name).filter(F.col("FLOW_START_MILLISECONDS").between(LOW, HIGH))
    out = t.select("flow_id", F.col("FLOW_START_MILLISECONDS").alias("ms"), ipv4("IPV4_SRC_ADDR").alias("src"), ipv4("IPV4_DST_ADDR").alias("dst"), F.col("L4_DST_PORT").alias("port"), F.coalesce(measure("IN_BYTES"), F.lit(0.0)).alias("bytes"))
    return out.filter("src IS NOT NULL AND dst IS NOT NULL")


def _binned(spark: SparkSession, d: str, ms: int = BIN) -> DataFrame:
    return graph.anchor_bins(edges(spark, d), ms)


def _r(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def flow_bins(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d).select("flow_id", "ms", "bin")


def flow_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per second with flows, how many lie in each window that ends with it."""
    return graph.bin_windows(_binned(spark, d), graph.SCALES)


def flow_window_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.window_edges(_binned(spark, d, MID), MID).select("bin", "flow_id", F.round("dt_s", 3).alias("dt_s"))


def flow_history(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_history(edges(spark, d), graph.SCALES).select("flow_id", "n_short", "n_mid", "n_long")


def flow_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_binned(spark, d, LONG), ["bin", "dst"], 8, strata=4, seed=7).select("bin", "dst", "flow_id")


def flow_node_stats(spark: SparkSession, d: str) -> DataFrame:
    """The twelve statistics of each host in each 300 seconds, with real ports and bytes."""
    return _r(graph.node_features(_binned(spark, d, LONG), LONG, 32, port="port", volume="bytes"), ["bin", "node"])


def flow_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = graph.send_gaps(_binned(spark, d, LONG))
    return g.groupBy("src").agg(F.count("gap_ms").alias("n_gaps"), F.round(F.avg("log_gap"), 6).alias("gap_mean"), F.round(F.stddev_pop("log_gap"), 6).alias("gap_std"))


def flow_beacons(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.spectrum(_binned(spark, d, LONG), LONG), ["bin", "node"], 4)


def flow_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per source under each timeout."""
    e, out = edges(spark, d), None
    for s in TIMEOUTS:
        one = graph.sessions(e, "src", s * 1000, "bytes").groupBy("src").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_edges").alias("longest"), F.round(F.sum("bytes"), 4).alias("bytes")).withColumn("timeout_s", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


# --- the encoder ------------------------------------------------------------------------

SIZE, EDGE, CAP = 4, 2, 8
_LAYER = encoder.Layer(encoder.given(SIZE, SIZE + EDGE + 4, "m"), encoder.given(SIZE, 2 * SIZE, "u"))


def _edge_vector() -> list:
    return [F.log1p("bytes") / 10, F.coalesce(F.col("port"), F.lit(0)).cast("double") / 65535]


def _capped(spark: SparkSession, d: str) -> DataFrame:
    """The eight latest edges to each host in each 300 seconds, with age and features."""
    e = graph.neighbours_recent(_binned(spark, d, LONG), ["bin", "dst"], CAP)
    ends = e.groupBy("bin").agg(F.max("ms").alias("end_ms"))
    return e.join(ends, "bin").withColumn("dt_s", (F.col("end_ms") - F.col("ms")) / 1000.0).withColumn("e", F.array(*_edge_vector()))


def _first_states(e: DataFrame) -> DataFrame:
    """What each host sent and received among the capped edges, on a log scale."""
    sent = e.groupBy("bin", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.sum("bytes").alias("ob"))
    got = e.groupBy("bin", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.sum("bytes").alias("ib"))
    j = sent.join(got, ["bin", "node"], "full").na.fill(0, ["o", "i"]).na.fill(0.0, ["ob", "ib"])
    return j.select("bin", "node", F.array(F.log1p("o"), F.log1p("i"), F.log1p("ob") / 10, F.log1p("ib") / 10).alias("h"))


def _flat(df: DataFrame, keys: list[str], v: str = "h", size: int = SIZE, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(v)[i], digits).alias(f"h{i}") for i in range(size)])


def bin_batch(spark: SparkSession, d: str) -> DataFrame:
    """Per bin of a second: its nodes, context edges of each scale, and targets."""
    nodes, context, targets = encoder.bin_batch(edges(spark, d, "nf_unsw_nb15_v3"), k=CAP)
    n = nodes.groupBy("bin").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("place").alias("last_place"))
    c = context.groupBy("bin").agg(*[F.sum(F.when(F.col("scale") == s, 1).otherwise(0)).alias(f"n_{s}") for s in graph.SCALES])
    return n.join(c, "bin").join(targets.groupBy("bin").agg(F.count(F.lit(1)).alias("n_targets")), "bin")


def dense_slots(spark: SparkSession, d: str) -> DataFrame:
    """The [slot, feature] array of each host: filled slots, first and last feature."""
    s = encoder.dense(_capped(spark, d), ["bin", "dst"], F.col("e"), CAP, EDGE)
    filled = F.size(F.filter("mask", lambda m: m))
    return s.select("bin", "dst", F.size("slots").alias("n_slots"), filled.alias("filled"), F.round(F.col("slots")[0][0], 6).alias("oldest"), F.round(F.element_at("slots", filled)[1], 6).alias("latest_port"), F.round(F.element_at("slots", F.lit(CAP))[0], 6).alias("last"))


_WA, _WB = encoder.given(3, 2, "a"), encoder.given(3, 2, "b")


def channel_projection(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and port projected apart from time of day and weekday."""
    ms = F.col("ms")
    v = F.array(*_edge_vector(), (ms % 86_400_000) / 86_400_000.0, (F.floor(ms / 86_400_000) % 7) / 7.0)
    return _flat(edges(spark, d).withColumn("h", encoder.project_channels(v, [0, 1], [2, 3], _WA, _WB)), ["flow_id"], size=6)


def encoder_layer(spark: SparkSession, d: str) -> DataFrame:
    """Host states after one layer with trimmed aggregation."""
    e = _capped(spark, d)
    return _flat(encoder.layer(e, _first_states(e), _LAYER, SIZE, LONG / 4000.0), ["bin", "node"])


def graph_norm(spark: SparkSession, d: str) -> DataFrame:
    return _flat(encoder.graph_norm(_first_states(_capped(spark, d)), "bin", SIZE), ["bin", "node"], digits=5)


def edge_readout(spark: SparkSession, d: str) -> DataFrame:
    """Every capped edge from both ends' first states and its features."""
    e = _capped(spark, d)
    return _flat(encoder.read_edges(e, _first_states(e), encoder.given(SIZE, 2 * SIZE + EDGE, "r")), ["bin", "flow_id"], "z")


def scale_gates(spark: SparkSession, d: str) -> DataFrame:
    """Three vectors per flow fused by a softmax gate."""
    h = graph.node_history(edges(spark, d), graph.SCALES)
    v = {s: F.array(F.log1p(f"n_{s}"), F.log1p("bytes") / 10) for s in graph.SCALES}
    z, shares = encoder.fuse(v, {s: encoder.given(1, 2, f"{s}.g")[0] for s in graph.SCALES}, 2)
    return h.select("flow_id", *[F.round(z[i], 6).alias(f"z{i}") for i in range(2)], *[F.round(shares[i], 6).alias(f"share_{s}") for i, s in enumerate(graph.SCALES)])


def _encoded(spark: SparkSession, d: str):
    """Bins of 30 seconds of the smallest table, context of all scales."""
    nodes, context, targets = encoder.bin_batch(edges(spark, d, "nf_unsw_nb15_v3"), {"short": 30_000, "mid": 60_000, "long": 300_000}, 30_000, CAP)
    e = F.array(*_edge_vector())
    first = context.filter("scale = 'long'")
    sent = first.groupBy("bin", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    states = nodes.join(sent, ["bin", "node"], "left").select("bin", "node", F.array(F.log1p(F.coalesce("o", F.lit(0))), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("h"))
    return context.withColumn("e", e), targets.withColumn("e", e), states, encoder.Weights(SIZE, EDGE, 4, 2), {"short": 30_000, "mid": 60_000, "long": 300_000}


def encode_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every flow encoded over three scales by two layers each."""
    context, targets, states, w, widths = _encoded(spark, d)
    z = encoder.encode(context, targets, states, w, widths)
    return z.select("flow_id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(SIZE)], F.round(vec.total(F.col("shares")), 9).alias("shares"))


def encoder_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """From flows to verdicts: the encoder, prototypes of its own vectors, decisions."""
    context, targets, states, w, widths = _encoded(spark, d)
    z = materialise(encoder.encode(context, targets, states, w, widths), "encoded")
    y = table(spark, d, "nf_unsw_nb15_v3").select("flow_id", F.when(F.col("Label") == 1, 1).otherwise(0).alias("y"))
    bank = prototypes.class_means(z.join(y, "flow_id"), "y", "z", SIZE)
    v = encoder.verdicts(z, bank, theta_unknown=0.05, theta_defer=0.001)
    return v.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def node_memory(spark: SparkSession, d: str) -> DataFrame:
    """The memory of each source after its latest flows."""
    gates = {g: encoder.given(2, EDGE + 2, f"gru.{g}") for g in "zrn"}
    m = encoder.node_memory(edges(spark, d).withColumn("x", F.array(*_edge_vector())), "src", "x", gates, 2, 32)
    return m.select("src", "n", "last_ms", *[F.round(F.col("memory")[i], 6).alias(f"m{i}") for i in range(2)])


QUERIES = {f.__name__: f for f in (
    flow_bins, flow_windows, flow_window_edges, flow_history, flow_neighbours, flow_node_stats, flow_gaps, flow_beacons, flow_sessions,
    bin_batch, dense_slots, channel_projection, encoder_layer, graph_norm, edge_readout, scale_gates, encode_edges, encoder_verdicts, node_memory,
)}


def _ev(name: str = FLOWS) -> str:
    return f"""ev AS (SELECT flow_id, FLOW_START_MILLISECONDS ms, {ipv4_sql("IPV4_SRC_ADDR")} src, {ipv4_sql("IPV4_DST_ADDR")} dst, L4_DST_PORT AS port, coalesce({measure_sql("IN_BYTES")}, 0) AS bytes FROM {name}
    WHERE FLOW_START_MILLISECONDS BETWEEN {LOW} AND {HIGH} AND src IS NOT NULL AND dst IS NOT NULL)"""


def _over_flows(sql: str) -> str:
    """The SQL of an event query over flows: hours, six hours and days become the scales."""
    for a, b in ((events.EV, _ev()), ("86400000", str(LONG)), ("21600000", str(MID)), ("3600000", str(SHORT)), ("86400.0", str(LONG / 1000)), ("ms, 0, 0, dst FROM b", "ms, 0, 0, port::VARCHAR FROM b")):
        sql = sql.replace(a, b)
    return sql


def _matvec(matrix: list[list[float]], entries: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{w!r}::DOUBLE * ({x})" for w, x in zip(row, entries, strict=True)) + ")" for row in matrix]


_gelu = lambda x: f"0.5 * ({x}) * (1 + tanh({math.sqrt(2 / math.pi)!r}::DOUBLE * (({x}) + 0.044715 * ({x}) * ({x}) * ({x}))))"
_E = ["ln(1 + bytes) / 10", "coalesce(port, 0) / 65535"]
_B = f"{_ev()}, b AS (SELECT *, (ms - (SELECT min(ms) FROM ev)) // {LONG} bin FROM ev)"
_C = f"""{_B}, c0 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bin, dst ORDER BY ms DESC, flow_id DESC) <= {CAP}), c AS (SELECT *, (max(ms) OVER (PARTITION BY bin) - ms) / 1000.0::DOUBLE dt, {_E[0]} e0, {_E[1]} e1 FROM c0),
    h AS (SELECT bin, node, ln(1 + sum(o)) a0, ln(1 + sum(i)) a1, ln(1 + sum(ob)) / 10 a2, ln(1 + sum(ib)) / 10 a3 FROM (SELECT bin, src node, 1 o, 0 i, bytes ob, 0 ib FROM c UNION ALL SELECT bin, dst, 0, 1, 0, bytes FROM c) GROUP BY 1, 2)"""
_waves = (600.0 / 0.1) ** (1 / 2)
_T = ["dt", *[f"sin({2 * math.pi / (0.1 * _waves**i)!r}::DOUBLE * dt)" for i in range(3)]]
_MSG = _matvec(_LAYER.message, ["a0", "a1", "a2", "a3", "e0", "e1", *[f"t{i}" for i in range(4)]])
_UPD = _matvec(_LAYER.update, ["a0", "a1", "a2", "a3", *[f"coalesce(g{i}, 0)" for i in range(4)]])
_CH = lambda w, x: ", ".join(f"{m} {x}{i}" for i, m in enumerate(w))
_norm = lambda x: [f"({x}{i} - ({x}0 + {x}1 + {x}2) / 3) / sqrt((pow({x}0 - ({x}0 + {x}1 + {x}2) / 3, 2) + pow({x}1 - ({x}0 + {x}1 + {x}2) / 3, 2) + pow({x}2 - ({x}0 + {x}1 + {x}2) / 3, 2)) / 3 + 1e-5)" for i in range(3)]
_GATE = {s: _matvec(encoder.given(1, 2, f"{s}.g"), [f"ln(1 + n_{s})", "ln(1 + bytes) / 10"])[0] for s in graph.SCALES}
_sess = lambda s: f"""SELECT src, count(*) n_sessions, max(n) longest, round(sum(b), 4) AS bytes, {s} timeout_s FROM (SELECT src, s, count(*) n, sum(bytes) b FROM (SELECT *, sum(nw) OVER (PARTITION BY src ORDER BY ms, flow_id) s
    FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY src ORDER BY ms, flow_id) <= {s * 1000} THEN 0 ELSE 1 END nw FROM ev)) GROUP BY 1, 2) GROUP BY 1"""  # noqa: E731
_bb = f"{_ev('nf_unsw_nb15_v3')}, b AS (SELECT *, (ms - (SELECT min(ms) FROM ev)) // 1000 bin FROM ev), e AS (SELECT bin, max(ms) end_ms FROM b GROUP BY 1)"

SQL = {f"flow_{a}": _over_flows(events.SQL[b]) for a, b in (
    ("bins", "anchor_bins"), ("windows", "sliding_multiscale"), ("window_edges", "window_edges"), ("history", "node_history"), ("neighbours", "neighbour_stratified_k"), ("node_stats", "node_stats_long"), ("gaps", "gap_stats"), ("beacons", "spectral_beacon"),
)} | {
    "flow_sessions": f"WITH {_ev()} " + " UNION ALL ".join(_sess(s) for s in TIMEOUTS),
    "dense_slots": f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, dst ORDER BY ms, flow_id) k, count(*) OVER (PARTITION BY bin, dst) n FROM c)
        SELECT bin, dst, {CAP} n_slots, any_value(n) filled, round(max(e0) FILTER (k = 1), 6) oldest, round(max(e1) FILTER (k = n), 6) latest_port, round(coalesce(max(e0) FILTER (k = {CAP}), 0), 6) AS last FROM r GROUP BY 1, 2""",
    "channel_projection": f"""WITH {_ev()}, v AS (SELECT flow_id, {_E[0]} x0, {_E[1]} x1, (ms % 86400000) / 86400000.0::DOUBLE y0, ((ms // 86400000) % 7) / 7.0::DOUBLE y1 FROM ev), p AS (SELECT flow_id, {_CH(_matvec(_WA, ["x0", "x1"]), "p")}, {_CH(_matvec(_WB, ["y0", "y1"]), "q")} FROM v)
        SELECT flow_id, {", ".join(f"round({_gelu(x)}, 6) h{i}" for i, x in enumerate(_norm("p") + _norm("q")))} FROM p""",
    "encoder_layer": f"""WITH {_C}, t AS (SELECT c.bin, dst, flow_id, pow(2.0, -dt / {LONG / 4000}) w0, e0, e1, a0, a1, a2, a3, {", ".join(f"{x} t{i}" for i, x in enumerate(_T))} FROM c JOIN h ON h.bin = c.bin AND h.node = c.src),
        m AS (SELECT bin, dst, flow_id, w0 / sum(w0) OVER (PARTITION BY bin, dst) w, [{", ".join(_gelu(x) for x in _MSG)}] v FROM t), l AS (SELECT bin, dst, flow_id, w, unnest(v) v, generate_subscripts(v, 1) j FROM m),
        k AS (SELECT *, row_number() OVER (PARTITION BY bin, dst, j ORDER BY v, flow_id) r, count(*) OVER (PARTITION BY bin, dst, j) n FROM l), a AS (SELECT bin, dst, j, sum(w * v) / greatest(sum(w), 1e-9) g FROM k WHERE r > floor(n * 0.2::DOUBLE) AND r <= n - floor(n * 0.2::DOUBLE) GROUP BY 1, 2, 3),
        g AS (SELECT bin, dst node, {", ".join(f"max(g) FILTER (j = {i + 1}) g{i}" for i in range(4))} FROM a GROUP BY 1, 2)
        SELECT h.bin, h.node, {", ".join(f"round(a{i} + {_gelu(x)}, 6) h{i}" for i, x in enumerate(_UPD))} FROM h LEFT JOIN g ON g.bin = h.bin AND g.node = h.node""",
    "graph_norm": f"WITH {_C} SELECT bin, node, {', '.join(f'round((a{i} - avg(a{i}) OVER w) / sqrt(var_pop(a{i}) OVER w + 1e-5), 5) h{i}' for i in range(4))} FROM h WINDOW w AS (PARTITION BY bin)",
    "edge_readout": f"""WITH {_C}, j AS (SELECT c.bin, flow_id, e0, e1, {", ".join(f"s.a{i} s{i}, d.a{i} d{i}" for i in range(4))} FROM c JOIN h s ON s.bin = c.bin AND s.node = c.src JOIN h d ON d.bin = c.bin AND d.node = c.dst)
        SELECT bin, flow_id, {", ".join(f"round({x}, 6) h{i}" for i, x in enumerate(_matvec(encoder.given(SIZE, 2 * SIZE + EDGE, "r"), [*(f"s{i}" for i in range(4)), *(f"d{i}" for i in range(4)), "e0", "e1"])))} FROM j""",
    "scale_gates": f"""WITH {_ev()}, n AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY src ORDER BY ms RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) n_{s}" for s, w in graph.SCALES.items())} FROM ev),
        g AS (SELECT *, {", ".join(f"exp({x}) g_{s}" for s, x in _GATE.items())} FROM n), q AS (SELECT *, g_short + g_mid + g_long t FROM g)
        SELECT flow_id, round(({" + ".join(f"g_{s} * ln(1 + n_{s})" for s in graph.SCALES)}) / t, 6) z0, round(ln(1 + bytes) / 10, 6) z1, {", ".join(f"round(g_{s} / t, 6) share_{s}" for s in graph.SCALES)} FROM q""",
    "bin_batch": f"""WITH {_bb}, w AS ({" UNION ALL ".join(f"SELECT e.bin, '{s}' scale, src, dst, ms, flow_id FROM e JOIN b ON b.ms BETWEEN end_ms - {x} AND end_ms" for s, x in graph.SCALES.items())}),
        c AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY bin, scale, dst ORDER BY ms DESC, flow_id DESC) <= {CAP}), n AS (SELECT bin, count(DISTINCT node) k FROM (SELECT bin, src node FROM b UNION ALL SELECT bin, dst FROM b UNION ALL SELECT bin, src FROM c UNION ALL SELECT bin, dst FROM c) GROUP BY 1)
        SELECT n.bin, k n_nodes, (k - 1)::INT last_place, {", ".join(f"(SELECT count(*) FROM c WHERE c.bin = n.bin AND scale = '{s}') n_{s}" for s in graph.SCALES)}, (SELECT count(*) FROM b WHERE b.bin = n.bin) n_targets FROM n""",
}
