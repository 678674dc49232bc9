"""Windows, samplers, node features, robust aggregates: queries and their SQL.

The test events are sparse, so scales of hours stand in for seconds here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import ipv4, ipv4_sql
from flowmill.operators import graph, robust
from flowmill.operators.ranking import hash_order_sql
from flowmill.sources.tables import flows_events, table

H = 3_600_000
BIN, LONG = H, 24 * H
SCALES = {"short": H, "mid": 6 * H, "long": 24 * H}


def _binned(spark: SparkSession, d: str, bin_ms: int = BIN) -> DataFrame:
    return graph.anchor_bins(flows_events(spark, d), bin_ms)


def _r(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def anchor_bins(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d).select("flow_id", "ms", "bin")


def sliding_multiscale(spark: SparkSession, d: str) -> DataFrame:
    return graph.bin_windows(_binned(spark, d), SCALES)


def window_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges in the window of each bin, with their age (heads only: 6 h bins)."""
    return graph.window_edges(_binned(spark, d, 6 * H), 6 * H).select("bin", "flow_id", F.round("dt_s", 3).alias("dt_s"))


def node_history(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_history(flows_events(spark, d), SCALES).select("flow_id", "n_short", "n_mid", "n_long")


def _capped(spark: SparkSession, d: str, strategy: str, **more) -> DataFrame:
    return graph.neighbours(_binned(spark, d, LONG), ["bin", "dst"], 8, strategy, **more).select("bin", "dst", "flow_id")


def neighbour_recent_k(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d, "recent")


def neighbour_uniform_k(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d, "uniform", seed=7)


def neighbour_stratified_k(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d, "recency_stratified", strata=4, seed=7)


def node_stats_long(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.node_features(_binned(spark, d, LONG), LONG, 32, volume="bytes"), ["bin", "node"])


def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    g = graph.send_gaps(_binned(spark, d, LONG)).groupBy("src").agg(F.count("gap_ms").alias("n_gaps"), F.round(F.avg("log_gap"), 6).alias("gap_mean"), F.round(F.stddev_pop("log_gap"), 6).alias("gap_std"))
    return g


def spectral_beacon(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.spectrum(_binned(spark, d, LONG), LONG), ["bin", "node"], 4)


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    e = flows_events(spark, d)
    return graph.node_ids(e)


def node_ids_ip_port(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nf_unsw_nb15_v3").withColumns({"s": ipv4("IPV4_SRC_ADDR"), "t": ipv4("IPV4_DST_ADDR")}).filter("s IS NOT NULL AND t IS NOT NULL")
    edges = t.select(graph.node_name(t, "s", "L4_SRC_PORT").alias("src"), graph.node_name(t, "t", "L4_DST_PORT").alias("dst"))
    return graph.node_ids(edges)


def session_timeouts(spark: SparkSession, d: str) -> DataFrame:
    e = flows_events(spark, d)
    out = None
    for m in (15, 60, 600):
        s = graph.sessions(e, "src", m * 60_000, "bytes").groupBy("src").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_edges").alias("longest"), F.round(F.sum("bytes"), 4).alias("bytes")).withColumn("timeout_min", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out


# --- robust aggregates over capped neighbour lists -----------------------------------


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two coordinates to each (bin, dst), at most 32 per list; weights
    decay with age and add up to 1."""
    e = graph.neighbours_recent(_binned(spark, d, LONG), ["bin", "dst"], 32)
    ends = e.groupBy("bin").agg(F.max("ms").alias("end_ms"))
    aged = e.join(ends, "bin").withColumn("dt_s", (F.col("end_ms") - F.col("ms")) / 1000.0)
    weighted = robust.decay_weights(aged, ["bin", "dst"], LONG / 1000.0 / 4)
    return weighted.select("bin", "dst", "flow_id", "weight", F.posexplode(F.array(F.col("bytes"), F.log1p(F.abs("bytes")))).alias("coord", "value"))


_G = ["bin", "dst", "coord"]


def mean_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _r(robust.robust_aggregate(_messages(spark, d), _G, "mean"), _G)


def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return _r(robust.trimmed_mean(_messages(spark, d), _G), _G)


def trimmed_std(spark: SparkSession, d: str) -> DataFrame:
    return _r(robust.trimmed_std(_messages(spark, d), _G), _G, 5)


def multi_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _r(robust.multi_aggregate(_messages(spark, d), _G), _G, 5)


def soft_medoid(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).filter("coord = 0").select(F.concat_ws("|", "bin", "dst").alias("grp"), "flow_id", "weight", F.array(F.col("value") / 100.0, F.log1p(F.abs("value"))).alias("vec"))
    return robust.soft_medoid(m, "grp").select("grp", F.round(F.col("agg")[0], 6).alias("a0"), F.round(F.col("agg")[1], 6).alias("a1"))


def decay_attention(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).filter("coord = 0").select("bin", "dst", "flow_id", F.round("weight", 9).alias("weight"))


def segment_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = flows_events(spark, d).withColumn("score", F.col("bytes") / 50.0)
    return robust.segment_softmax_by_join(e, ["dst"], "score").select("flow_id", F.round("weight", 12).alias("weight"))


def scatter_mean(spark: SparkSession, d: str) -> DataFrame:
    return robust.scatter_mean(flows_events(spark, d), "dst", "bytes").select("dst", F.round("agg", 6).alias("agg"), "n")


def time_encoding(spark: SparkSession, d: str) -> DataFrame:
    e = _binned(spark, d).withColumn("dt", (F.col("ms") % 600_000) / 1000.0)
    enc, rec = robust.time_encoding(F.col("dt"), 8), robust.recency_encoding(F.col("dt"), 300.0, 2)
    return e.select("flow_id", *[F.round(enc[i], 6).alias(f"e{i}") for i in range(8)], F.round(rec[0], 6).alias("r0"))


QUERIES = {f.__name__: f for f in (
    anchor_bins, sliding_multiscale, window_edges, node_history, neighbour_recent_k, neighbour_uniform_k, neighbour_stratified_k, node_stats_long, gap_stats, spectral_beacon,
    node_ids, node_ids_ip_port, session_timeouts, mean_aggregate, trimmed_mean, trimmed_std, multi_aggregate, soft_medoid, decay_attention, segment_softmax, scatter_mean, time_encoding,
)}

EV = "ev AS (SELECT event_id flow_id, epoch_us(ts) // 1000 ms, user_id src, event_type dst, value bytes FROM events)"
_B = lambda ms=BIN: f"{EV}, b AS (SELECT *, (ms - (SELECT min(ms) FROM ev)) // {ms} bin FROM ev)"
_MSG = f"""{_B(LONG)}, c AS (SELECT *, row_number() OVER (PARTITION BY bin, dst ORDER BY ms DESC, flow_id DESC) r FROM b), c32 AS (SELECT *, max(ms) OVER (PARTITION BY bin) e FROM c WHERE r <= 32),
    x AS (SELECT *, pow(2.0, -((e - ms) / 1000.0) / {LONG / 4000}) w0 FROM c32), w AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY bin, dst) weight FROM x),
    m AS (SELECT bin, dst, flow_id, weight, 0 coord, bytes AS "value" FROM w UNION ALL SELECT bin, dst, flow_id, weight, 1, ln(1 + abs(bytes)) FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY bin, dst, coord ORDER BY "value", flow_id) r, count(*) OVER (PARTITION BY bin, dst, coord) n FROM m),
    t AS (SELECT *, n - 2 * floor(n * 0.2::DOUBLE) >= 1 AS enough FROM k), q AS (SELECT * FROM t WHERE NOT enough OR (r > floor(n * 0.2::DOUBLE) AND r <= n - floor(n * 0.2::DOUBLE)))"""
_TM = 'CASE WHEN any_value(enough) THEN sum(weight * "value") / greatest(sum(weight), 1e-9) ELSE sum(weight * "value") END'
_TSD = """(SELECT bin, dst, coord, sqrt(sum(weight * pow("value" - mu, 2)) / greatest(sum(weight), 1e-9) + 1e-9) s FROM (SELECT *, sum(weight * "value") OVER (PARTITION BY bin, dst, coord) / greatest(sum(weight) OVER (PARTITION BY bin, dst, coord), 1e-9) mu FROM q) GROUP BY 1, 2, 3)"""
_HO = hash_order_sql("flow_id", 7)
_waves = (600.0 / 0.1) ** (1 / 6)


def _ids(nodes: str) -> str:
    return f"SELECT node, row_number() OVER (ORDER BY node) - 1 node_id FROM (SELECT DISTINCT node FROM ({nodes}) WHERE node IS NOT NULL)"


_S = lambda m: f"""SELECT src, count(*) n_sessions, max(n) longest, round(sum(b), 4) AS bytes, {m} timeout_min FROM (SELECT src, s, count(*) n, sum(bytes) b FROM (SELECT *, sum(nw) OVER (PARTITION BY src ORDER BY ms, flow_id) s
    FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY src ORDER BY ms, flow_id) <= {m * 60000} THEN 0 ELSE 1 END nw FROM ev)) GROUP BY 1, 2) GROUP BY 1"""  # noqa: E731
_LG = f"ln(1 + gap / 1000.0)"
_GAP = "g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY bin, src ORDER BY ms, flow_id) gap FROM b)"

SQL = {
    "anchor_bins": f"WITH {_B()} SELECT flow_id, ms, bin FROM b",
    "sliding_multiscale": f"""WITH {_B()}, e AS (SELECT bin, max(ms) end_ms, count(*) n_targets FROM b GROUP BY 1) SELECT e.bin, end_ms, n_targets, count(*) FILTER (b.ms >= end_ms - {H}) n_short,
        count(*) FILTER (b.ms >= end_ms - {6 * H}) n_mid, count(*) n_long FROM e JOIN b ON b.ms BETWEEN end_ms - {24 * H} AND end_ms GROUP BY 1, 2, 3""",
    "window_edges": f"WITH {_B(6 * H)}, e AS (SELECT bin, max(ms) end_ms FROM b GROUP BY 1) SELECT e.bin, flow_id, round((end_ms - ms) / 1000.0, 3) dt_s FROM e JOIN b ON b.ms BETWEEN end_ms - {6 * H} AND end_ms",
    "node_history": f"WITH {EV} SELECT flow_id, " + ", ".join(f"count(*) OVER (PARTITION BY src ORDER BY ms RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) n_{s}" for s, w in SCALES.items()) + " FROM ev",
    "neighbour_recent_k": f"WITH {_B(LONG)} SELECT bin, dst, flow_id FROM b QUALIFY row_number() OVER (PARTITION BY bin, dst ORDER BY ms DESC, flow_id DESC) <= 8",
    "neighbour_uniform_k": f"WITH {_B(LONG)} SELECT bin, dst, flow_id FROM b QUALIFY row_number() OVER (PARTITION BY bin, dst ORDER BY {_HO}, flow_id) <= 8",
    "neighbour_stratified_k": f"""WITH {_B(LONG)}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, dst ORDER BY ms, flow_id) r, count(*) OVER (PARTITION BY bin, dst) n FROM b),
        s AS (SELECT *, (r > n // 4)::INT + (r > 2 * n // 4)::INT + (r > 3 * n // 4)::INT st FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY bin, dst, st ORDER BY {_HO}, flow_id) q FROM s)
        SELECT bin, dst, flow_id FROM q WHERE n <= 8 OR q <= 2""",
    "node_stats_long": f"""WITH {_B(LONG)}, e AS (SELECT bin, max(ms) e FROM b GROUP BY 1), {_GAP},
        u AS (SELECT bin, src::VARCHAR node, dst peer, ms, bytes v, 1 o, NULL prt FROM b UNION ALL SELECT bin, dst, src::VARCHAR, ms, 0, 0, dst FROM b),
        a AS (SELECT u.bin, node, sum(o) o, sum(1 - o) i, count(DISTINCT peer) peers, count(DISTINCT prt) ports, sum(v) v, count(*) FILTER (o = 1 AND ms >= e - 1000) s, count(*) FILTER (o = 1 AND ms >= e - 30000) m FROM u JOIN e USING (bin) GROUP BY 1, 2),
        gs AS (SELECT bin, src::VARCHAR node, avg({_LG}) gm, stddev_pop({_LG}) gd FROM g GROUP BY 1, 2), bb AS (SELECT bin, lag(bin) OVER (ORDER BY bin) pb FROM e)
        SELECT a.bin, a.node, round(least(a.o, 32) / 32, 6) out_degree, round(least(a.i, 32) / 32, 6) in_degree, round(ln(1 + a.peers) / ln(33), 6) peer_count, round(ln(1 + a.ports) / ln(33), 6) port_count, round(a.peers / (a.o + 1e-6), 6) fan_out,
        round(ln(1 + a.o / 86400.0), 6) send_rate, round(coalesce(gm, 0), 6) gap_mean, round(coalesce(gd, 0), 6) gap_std, round(ln(1 + a.v) / 20, 6) volume, round(a.s / (a.m / 30.0 + 1e-6), 6) burst, round(a.i / (a.i + a.o + 1e-6), 6) reverse_ratio,
        CASE WHEN p.node IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END is_new FROM a LEFT JOIN gs USING (bin, node) JOIN bb ON bb.bin = a.bin LEFT JOIN a p ON p.bin = bb.pb AND p.node = a.node""",
    "gap_stats": f"WITH {_B(LONG)}, {_GAP} SELECT src, count(gap) n_gaps, round(avg({_LG}), 6) gap_mean, round(stddev_pop({_LG}), 6) gap_std FROM g GROUP BY 1",
    "spectral_beacon": f"""WITH {_B(LONG)}, t0 AS (SELECT bin, min(ms) t0 FROM b GROUP BY 1), u AS (SELECT bin, src::VARCHAR node, ms FROM b UNION ALL SELECT bin, dst, ms FROM b WHERE dst <> src::VARCHAR),
        s AS (SELECT bin, node, least(floor((ms - t0) / {float(LONG)}::DOUBLE * 64), 63)::INT sl, count(*) c FROM u JOIN t0 USING (bin) GROUP BY 1, 2, 3), nn AS (SELECT bin, node, sum(c) n FROM s GROUP BY 1, 2), """,
    "node_ids": f"WITH {EV} {_ids('SELECT src::VARCHAR node FROM ev UNION ALL SELECT dst FROM ev')}",
    "node_ids_ip_port": f"""WITH t AS (SELECT *, {ipv4_sql('IPV4_SRC_ADDR')} s, {ipv4_sql('IPV4_DST_ADDR')} t FROM nf_unsw_nb15_v3), u AS (SELECT * FROM t WHERE s IS NOT NULL AND t IS NOT NULL)
        {_ids("SELECT s || ':' || coalesce(L4_SRC_PORT::VARCHAR, '') node FROM u UNION ALL SELECT t || ':' || coalesce(L4_DST_PORT::VARCHAR, '') FROM u")}""",
    "session_timeouts": f"WITH {EV} " + " UNION ALL ".join(_S(m) for m in (15, 60, 600)),
    "mean_aggregate": f'WITH {_MSG} SELECT bin, dst, coord, round(sum(weight * "value"), 6) agg FROM m GROUP BY 1, 2, 3',
    "trimmed_mean": f"WITH {_MSG} SELECT bin, dst, coord, round({_TM}, 6) agg FROM q GROUP BY 1, 2, 3",
    "trimmed_std": f"WITH {_MSG} SELECT bin, dst, coord, round(s, 5) agg FROM {_TSD}",
    "multi_aggregate": f"""WITH {_MSG} SELECT bin, dst, coord, round(a, 5) trim_mean, round(s, 5) trim_std, round(ln(1 + n) / ln(33), 5) degree FROM (SELECT bin, dst, coord, {_TM} a, any_value(n) n FROM q GROUP BY 1, 2, 3) JOIN {_TSD} USING (bin, dst, coord)""",
    "soft_medoid": f"""WITH {_MSG}, v AS (SELECT bin || '|' || dst grp, flow_id, weight, "value" / 100 x, ln(1 + abs("value")) y FROM m WHERE coord = 0),
        d AS (SELECT a.grp, a.flow_id, any_value(a.weight) w, any_value(a.x) x, any_value(a.y) y, -sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) f FROM v a JOIN v b USING (grp) GROUP BY 1, 2),
        s AS (SELECT *, exp(f - max(f) OVER (PARTITION BY grp)) * w r FROM d) SELECT grp, round(sum(r * x) / sum(r), 6) a0, round(sum(r * y) / sum(r), 6) a1 FROM s GROUP BY 1""",
    "decay_attention": f"WITH {_MSG} SELECT bin, dst, flow_id, round(weight, 9) weight FROM m WHERE coord = 0",
    "segment_softmax": f"WITH {EV}, e AS (SELECT *, exp(bytes / 50 - max(bytes / 50) OVER (PARTITION BY dst)) e FROM ev) SELECT flow_id, round(e / sum(e) OVER (PARTITION BY dst), 12) weight FROM e",
    "scatter_mean": f"WITH {EV} SELECT dst, round(avg(bytes), 6) agg, count(*) n FROM ev GROUP BY 1",
    "time_encoding": f"WITH {EV}, t AS (SELECT flow_id, (ms % 600000) / 1000.0::DOUBLE dt FROM ev) SELECT flow_id, round(dt, 6) e0, " + ", ".join(f"round(sin({2 * math.pi / (0.1 * _waves**i)!r} * dt), 6) e{i + 1}" for i in range(7)) + ", round(ln(1 + dt / 300), 6) r0 FROM t",
}
_f = """f AS (SELECT bin, node, n, kk.k, pow(sum(c * cos(2 * pi() * kk.k * sl / 64)), 2) + pow(sum(c * sin(2 * pi() * kk.k * sl / 64)), 2) p FROM s JOIN nn USING (bin, node) CROSS JOIN range(1, 33) kk(k) GROUP BY 1, 2, 3, 4),
    a AS (SELECT bin, node, any_value(n) n, sum(p) t, max(p) mx, avg(p) av, sum(p) FILTER (k <= 4) lo, exp(avg(ln(p + 1e-12))) geo FROM f GROUP BY 1, 2),
    z AS (SELECT bin, node, -sum(p / t * ln(p / t + 1e-12)) / ln(32) h, min(k) FILTER (p >= mx * (1 - 1e-9)) - 1 pk FROM f JOIN a USING (bin, node) WHERE t > 1e-9 GROUP BY 1, 2)"""
_l = lambda e, n: f"CASE WHEN n >= 8 AND t > 1e-9 THEN round({e}, 4) ELSE 0.0 END {n}"
SQL["spectral_beacon"] = SQL["spectral_beacon"] + _f + f"""
    SELECT bin, node, {_l("pk / 32.0", "peak_frequency")}, {_l("mx / (t + 1e-9)", "peak_share")}, {_l("h", "entropy")}, {_l("geo / (av + 1e-9)", "flatness")}, {_l("mx / (av + 1e-9)", "peak_to_mean")}, {_l("lo / (t + 1e-9)", "low_share")}
    FROM a LEFT JOIN z USING (bin, node)"""
