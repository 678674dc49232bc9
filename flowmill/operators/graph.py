"""Flows as edges of a time-windowed multigraph.

Edges are a DataFrame ``flow_id, ms, src, dst`` (more columns may follow).
Windows look backward only. Every operator works on all bins at once.

A node may hold a third of all edges, so nothing here orders a whole node in
one task unless the frame is cut into bins first: windows are partitioned by
(bin, node), and neighbour caps use a group limit below the exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators.ranking import hash_order, ranked
from flowmill.plans.shared import broadcast_if_small

SCALES = {"short": 1_000, "mid": 30_000, "long": 300_000}
CAP, STRATA, SPECTRUM = 32, 4, 64
EPS = 1e-6
#: Tables of up to this many rows (of a few numbers each) may be broadcast.
SMALL = 200_000


def node_name(df: DataFrame, address: str, port: str | None = None) -> Column:
    """A node's name: the address, or ``address:port``."""
    return F.col(address) if port is None else F.concat_ws(":", F.col(address), F.coalesce(F.col(port).cast("string"), F.lit("")))


def node_ids(edges: DataFrame) -> DataFrame:
    """``node, node_id``: ids from 0 in the names' order, over sources and
    destinations. Ranks are shifted slices of a range partitioning, so the
    node set is never gathered."""
    nodes = edges.select(F.col("src").cast("string").alias("node")).union(edges.select(F.col("dst").cast("string"))).filter("node IS NOT NULL").distinct()
    return ranked(nodes.withColumn("_all", F.lit(0)), ["_all"], [F.col("node")]).select("node", (F.col("rank") - 1).alias("node_id"))


def anchor_bins(edges: DataFrame, bin_ms: int = 1_000, origin: Column | None = None) -> DataFrame:
    """``bin`` of every edge: whole bins since the first edge (or ``origin``).

    The first time is a scalar subquery, not a window over all rows.
    """
    t0 = origin if origin is not None else edges.agg(F.min("ms")).scalar()
    return edges.withColumn("bin", F.floor((F.col("ms") - t0) / F.lit(bin_ms)).cast("bigint"))


def _window_counts(times: DataFrame, keys: list[str], widths: dict[str, int]) -> DataFrame:
    """``keys, ms`` and ``n_<width>``: for each (keys, ms) of ``times`` (``keys,
    ms, n``, one row each) the sum of n over [ms - width, ms].

    A sliding frame would be summed anew at every row. Instead each time also
    stands as probes at its window's start and end, and one running sum over
    times and probes answers all: a window's count is the difference of two
    probes. Sums run over (keys, block of the widest window); a time counts in
    its own block and the next, so no partition holds more than two widths.
    """
    own = F.floor(F.col("ms") / F.lit(max(widths.values())))
    row = lambda block, at, kind, n, name: F.struct(block.alias("block"), at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), n.cast("bigint").alias("v"), F.lit(name).cast("string").alias("name"))
    none = F.lit(0)
    points = [row(own, F.col("ms"), 1, F.col("n"), None), row(own + 1, F.col("ms"), 1, F.col("n"), None), row(own, F.col("ms"), 2, none, "_end")]
    points += [row(own, F.col("ms") - F.lit(w), 0, none, s) for s, w in widths.items()]  # before what happens at the same time
    each = times.select(*keys, "ms", F.explode(F.array(*points)).alias("_p")).select(*keys, "ms", "_p.*")
    upto = F.sum("v").over(Window.partitionBy(*keys, "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    asked = each.withColumn("upto", upto).filter("name IS NOT NULL")
    got = lambda s: F.max(F.when(F.col("name") == s, F.col("upto")))
    return asked.groupBy(*keys, "ms").agg(*[(got("_end") - got(s)).alias(f"n_{s}") for s in widths])


def bin_windows(binned: DataFrame, scales: dict[str, int] | None = None) -> DataFrame:
    """``bin, n_targets, end_ms`` and per scale the number of edges in
    [end - width, end], where the end is the bin's last edge.

    Edges are folded to counts per time first; a bin takes the counts of its
    last time (see ``_window_counts``).
    """
    scales = scales or SCALES
    times = binned.groupBy("ms", "bin").agg(F.count(F.lit(1)).alias("n"))
    ends = times.groupBy("bin").agg(F.max("ms").alias("end_ms"), F.sum("n").alias("n_targets"))
    counts = _window_counts(times, [], scales)
    return ends.join(counts, F.col("end_ms") == F.col("ms")).select("bin", "end_ms", "n_targets", *[f"n_{s}" for s in scales])


def window_edges(binned: DataFrame, width_ms: int) -> DataFrame:
    """Every edge with each bin whose window holds it: ``bin, end_ms, dt_s`` and
    the edge. An equi-join on coarse time blocks, then the exact bounds."""
    ends = binned.groupBy("bin").agg(F.max("ms").alias("end_ms"))
    block = lambda c: F.floor(c / F.lit(width_ms))
    spread = binned.drop("bin").withColumn("_block", F.explode(F.array(block(F.col("ms")), block(F.col("ms")) + 1)))
    near = ends.withColumn("_block", block(F.col("end_ms"))).join(spread, "_block").drop("_block")
    inside = near.filter((F.col("ms") <= F.col("end_ms")) & (F.col("ms") >= F.col("end_ms") - F.lit(width_ms)))
    return inside.withColumn("dt_s", F.greatest((F.col("end_ms") - F.col("ms")) / 1000.0, F.lit(0.0)))


def node_history(edges: DataFrame, widths: dict[str, int], node: str = "src") -> DataFrame:
    """Per edge, how many edges of its node lie in each window ending at it (ties
    in time count). Counted per (node, time) in blocks of time, so a hot node is
    spread, and joined back by both."""
    counts = _window_counts(edges.groupBy(node, "ms").agg(F.count(F.lit(1)).alias("n")), [node], widths)
    return edges.join(counts, [node, "ms"]).select(*edges.columns, *[f"n_{s}" for s in widths])


def neighbours_recent(edges: DataFrame, groups: list[str], k: int = CAP) -> DataFrame:
    """The k latest edges of each group (ties by key, the larger first)."""
    w = Window.partitionBy(*groups).orderBy(F.desc("ms"), F.desc("flow_id"))
    return edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def neighbours_uniform(edges: DataFrame, groups: list[str], k: int = CAP, seed: int = 7) -> DataFrame:
    """k edges of each group without replacement, by hash."""
    w = Window.partitionBy(*groups).orderBy(hash_order("flow_id", seed), F.col("flow_id"))
    return edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def neighbours_stratified(edges: DataFrame, groups: list[str], k: int = CAP, strata: int = STRATA, seed: int = 7) -> DataFrame:
    """k edges of each group, spread over recency: the group's edges in time
    order are cut at ``floor(i * n / strata)``; each stratum gives k // strata by
    hash, the last also the remainder. Groups of up to k edges stay whole.
    Ranks come from :func:`ranked`, so a hot group is not sorted in one task."""
    r = ranked(edges, groups, [F.col("ms"), F.col("flow_id")]).withColumnsRenamed({"rank": "_rank", "group_rows": "_n"})
    # stratum i holds ranks above floor(i n / s) and up to floor((i + 1) n / s)
    stratum = F.lit(0)
    for i in range(1, strata):
        stratum = stratum + F.when(F.col("_rank") > F.floor(F.lit(i) * F.col("_n") / F.lit(strata)), 1).otherwise(0)
    cut = r.withColumn("_stratum", stratum)
    whole, large = cut.filter(F.col("_n") <= k), cut.filter(F.col("_n") > k)
    w = Window.partitionBy(*groups, "_stratum").orderBy(hash_order("flow_id", seed), F.col("flow_id"))
    quota = F.when(F.col("_stratum") == strata - 1, k // strata + k % strata).otherwise(k // strata)
    picked = large.withColumn("_q", F.row_number().over(w)).filter(F.col("_q") <= k).filter(F.col("_q") <= quota)
    return whole.select(edges.columns).unionByName(picked.select(edges.columns))


def neighbours(edges: DataFrame, groups: list[str], k: int = CAP, strategy: str = "recency_stratified", **more) -> DataFrame:
    """The named sampler."""
    make = {"recency_stratified": neighbours_stratified, "recent": neighbours_recent, "uniform": neighbours_uniform}
    if strategy not in make:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return make[strategy](edges, groups, k, **more)


def node_features(binned: DataFrame, long_ms: int, k: int = CAP, port: str | None = None, volume: str | None = None) -> DataFrame:
    """The twelve window statistics of each (bin, node), the bin being the long
    window. Both directions of each edge are stacked; one fold per (bin, node,
    peer) first, so a hub is spread over its peers.

    Volume, gaps and rates are of the edges a node sends. ``is_new`` is 0 if the
    node was active in the bin before the last processed one.
    """
    vol = F.col(volume).cast("double") if volume else F.lit(0.0)
    prt = F.col(port).cast("string") if port else F.col("dst").cast("string")
    sent = binned.select("bin", F.col("src").cast("string").alias("node"), F.col("dst").cast("string").alias("peer"), "ms", "flow_id", vol.alias("vol"), F.lit(1).alias("out"), F.lit(None).cast("string").alias("prt"))
    got = binned.select("bin", F.col("dst").cast("string").alias("node"), F.col("src").cast("string").alias("peer"), "ms", "flow_id", F.lit(0.0).alias("vol"), F.lit(0).alias("out"), prt.alias("prt"))
    ends = broadcast_if_small(binned.groupBy("bin").agg(F.max("ms").alias("bin_end")), SMALL)
    both = sent.unionByName(got)
    per_peer = both.join(ends, "bin").groupBy("bin", "node", "peer").agg(
        F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"), F.sum("vol").alias("v"),
        F.sum(F.when((F.col("out") == 1) & (F.col("ms") >= F.col("bin_end") - 1_000), 1).otherwise(0)).alias("s"),
        F.sum(F.when((F.col("out") == 1) & (F.col("ms") >= F.col("bin_end") - 30_000), 1).otherwise(0)).alias("m"),
    )
    base = per_peer.groupBy("bin", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.count(F.lit(1)).alias("peers"), F.sum("v").alias("v"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    ports = got.groupBy("bin", "node", "prt").agg(F.lit(1).alias("x")).groupBy("bin", "node").agg(F.count("prt").alias("ports"))
    gaps = send_gaps(binned).groupBy("bin", F.col("src").cast("string").alias("node")).agg(F.avg("log_gap").alias("gm"), F.stddev_pop("log_gap").alias("gs"))
    place = ranked(binned.select("bin").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.col("bin")]).select("bin", "rank")
    bins = broadcast_if_small(place.join(place.select(F.col("bin").alias("before"), (F.col("rank") + 1).alias("rank")), "rank", "left").drop("rank"), SMALL)
    active = base.select(F.col("bin").alias("before"), "node", F.lit(1).alias("was"))
    o, i = F.col("o"), F.col("i")
    full = base.join(ports, ["bin", "node"], "left").join(gaps, ["bin", "node"], "left").join(bins, "bin").join(active, ["before", "node"], "left")
    degree = math.log1p(max(k, 2))
    return full.select(
        "bin", "node", (F.least(o, F.lit(k)) / k).alias("out_degree"), (F.least(i, F.lit(k)) / k).alias("in_degree"),
        (F.log1p(F.col("peers")) / degree).alias("peer_count"), (F.log1p(F.coalesce("ports", F.lit(0))) / degree).alias("port_count"),
        (F.col("peers") / (o + EPS)).alias("fan_out"), F.log1p(o / F.lit(max(long_ms / 1000.0, 1.0))).alias("send_rate"),
        F.coalesce("gm", F.lit(0.0)).alias("gap_mean"), F.coalesce("gs", F.lit(0.0)).alias("gap_std"), (F.log1p(F.col("v")) / 20.0).alias("volume"),
        (F.col("s") / (F.col("m") / 30.0 + EPS)).alias("burst"), (i / (i + o + EPS)).alias("reverse_ratio"), F.when(F.col("was").isNull(), 1.0).otherwise(0.0).alias("is_new"),
    )


def send_gaps(binned: DataFrame, block_ms: int = 1_000) -> DataFrame:
    """Gap of each edge to its source's edge before it in the bin, and its log
    in seconds; null for the first.

    Edges are ordered within blocks of time; the first of a block follows the
    last of the source's block before, found among blocks, not edges. So a hot
    source is never ordered in one task.
    """
    keys = ["bin", "src"]
    cut = binned.withColumn("_block", F.floor(F.col("ms") / F.lit(block_ms)))
    w = Window.partitionBy(*keys, "_block").orderBy("ms", "flow_id")
    lasts = cut.groupBy(*keys, "_block").agg(F.max("ms").alias("_last")).withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
    named = lasts.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_block"]], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_block"]]
    gap = (F.col("ms") - F.coalesce("_lag", "_before")).cast("bigint")
    out = cut.withColumn("_lag", F.lag("ms").over(w)).join(named, same, "left").withColumn("gap_ms", gap)
    return out.withColumn("log_gap", F.log1p(F.col("gap_ms") / 1000.0)).select(*binned.columns, "gap_ms", "log_gap")


def spectrum(binned: DataFrame, long_ms: int, bins: int = SPECTRUM, least: int = 8) -> DataFrame:
    """The six beaconing descriptors of each (bin, node): the power spectrum of
    its arrival histogram, by literal cosines and sines (no UDF).

    Histogram counts are folded on the map side. Nodes with fewer than
    ``least`` edges get zeros. ``bins`` must be even.
    """
    starts = broadcast_if_small(binned.groupBy("bin").agg(F.min("ms").alias("t0")), SMALL)
    ends = binned.select("bin", F.col("src").cast("string").alias("node"), "ms").union(binned.filter(F.col("dst").cast("string") != F.col("src").cast("string")).select("bin", F.col("dst").cast("string"), "ms"))
    rel = (F.col("ms") - F.col("t0")) / F.lit(float(long_ms))
    slot = F.least(F.floor(rel * bins), F.lit(bins - 1)).cast("int")
    counts = ends.join(starts, "bin").filter(rel <= 1).groupBy("bin", "node", slot.alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    node = counts.groupBy("bin", "node").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "c"))).alias("h"))  # at most `bins` entries
    h = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda s: F.coalesce(F.try_element_at(F.col("h"), s), F.lit(0)).cast("double") - F.col("n") / F.lit(float(bins)))
    return describe_spectrum(node.withColumn("x", h), bins, least).select("bin", "node", *SPECTRAL)


SPECTRAL = ("peak_frequency", "peak_share", "entropy", "flatness", "peak_to_mean", "low_share")


def describe_spectrum(df: DataFrame, bins: int, least: int) -> DataFrame:
    """Descriptors of the mean-centred series ``x`` of ``n`` events.

    Series, power and sums are bound once each (``vec.let``), so a row costs
    ``bins * bins / 2`` products and no more.
    """
    half = bins // 2
    table = F.lit([[[float(f(2 * math.pi * k * t / bins)) for t in range(bins)] for f in (math.cos, math.sin)] for k in range(1, half + 1)])
    power = vec.let(F.col("x"), lambda x: F.transform(table, lambda w: F.aggregate(F.transform(w, lambda v: vec.dot(x, v)), F.lit(0.0), lambda s, y: s + y * y)))
    bound = vec.let(power, lambda p: F.struct(p.alias("p"), vec.total(p).alias("total"), F.array_max(p).alias("top")))

    def describe(t):
        p, total, top = t["p"], t["total"], t["top"]
        mean = total / half
        # a peak within one part in 1e9 of the largest counts as the largest, so that rounding picks no other
        first = F.array_position(F.transform(p, lambda y: y >= top * (1 - 1e-9)), True) - 1
        made = (
            first / float(half), top / (total + 1e-9), -vec.total(F.transform(p, lambda y: (y / total) * F.ln(y / total + 1e-12))) / math.log(max(half, 2)),
            F.exp(vec.total(F.transform(p, lambda y: F.ln(y + 1e-12))) / half) / (mean + 1e-9), top / (mean + 1e-9), vec.total(F.slice(p, 1, max(half // 8, 1))) / (total + 1e-9),
        )
        return F.when(total > 1e-9, F.array(*made))

    d = df.withColumn("_d", F.when(F.col("n") >= least, vec.let(bound, describe)))
    return d.select("*", *[F.coalesce(F.col("_d")[i], F.lit(0.0)).alias(n) for i, n in enumerate(SPECTRAL)]).drop("_d")


def sessions(edges: DataFrame, node: str, timeout_ms: int, bytes_: str | None = None) -> DataFrame:
    """Edges of a node merged into sessions: a gap above the timeout starts a
    new one. Per session: start, end, edges, bytes.

    First within blocks of 32 timeouts, then across blocks: what is merged last
    is one row per block and session, so a hot node's edges never meet in one task.
    """
    block = F.floor(F.col("ms") / F.lit(32 * timeout_ms))
    vol = F.col(bytes_).cast("double") if bytes_ else F.lit(0.0)
    rows = edges.select(F.col(node), block.alias("_block"), F.col("ms").alias("start_ms"), F.col("ms").alias("end_ms"), F.lit(1).cast("bigint").alias("n_edges"), vol.alias("bytes"))

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
        new = F.when(F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= timeout_ms, 0).otherwise(1)
        numbered = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_edges").alias("n_edges"), F.sum("bytes").alias("bytes"))

    return merged(merged(rows, [node, "_block"]).drop("session"), [node])
