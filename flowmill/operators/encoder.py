"""The encoder of edges: windowed graphs, robust message passing over vectors,
a readout per scale, gated fusion, and memory of nodes.

States are arrays, one row per (bin, node); a layer is one join of edges with
their sources' states and one fold of capped neighbour lists, for all bins at
once. Weights are given (trained elsewhere, or by ``train``): small matrices
that enter plans as literals. Everything runs inside the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.operators import graph, prototypes, robust
from flowmill.operators.ranking import HASHES, mixed_number
from flowmill.plans.shared import materialise

TINY = 1e-9


# --- batches -------------------------------------------------------------------


def bin_batch(edges: DataFrame, scales: dict[str, int] | None = None, bin_ms: int = 1_000, k: int = graph.CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All bins at once as ``(nodes, context, targets)``.

    ``targets``: the edges of each bin; ``context``: ``bin, scale`` and the edges
    in the window of the scale that ends with the bin, at most the ``k`` latest
    per target node, with their age; ``nodes``: ``bin, node, place``, one node
    space for all scales of a bin, numbered from 0 in the names' order.
    """
    binned = graph.anchor_bins(edges, bin_ms)
    parts = [graph.neighbours_recent(graph.window_edges(binned, width).withColumn("scale", F.lit(s)), ["bin", "scale", "dst"], k) for s, width in (scales or graph.SCALES).items()]
    context = parts[0]
    for p in parts[1:]:
        context = context.unionByName(p)
    seen = [df.select("bin", F.col(c).cast("string").alias("node")) for df in (binned, context) for c in ("src", "dst")]
    names = seen[0].union(seen[1]).union(seen[2]).union(seen[3]).distinct()
    # a bin's nodes: at most two per edge of its windows, folded before they are numbered
    place = F.row_number().over(Window.partitionBy("bin").orderBy("node")) - 1
    return names.withColumn("place", place), context, binned


def dense(edges: DataFrame, groups: list[str], feature: Column, k: int, width: int) -> DataFrame:
    """``groups, slots, mask``: each group's edges as a [k, width] array, oldest
    first, padded with zeros; ``mask`` says which slots are filled. Groups must
    hold at most k edges (see ``graph.neighbours``)."""
    lists = edges.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("ms", "flow_id", feature.alias("f")))).alias("l"))
    n = F.least(F.size("l"), F.lit(k))
    rows = F.transform(F.slice("l", 1, k), lambda t: t["f"])
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), width), k - n)
    return lists.select(*groups, F.concat(rows, pad).alias("slots"), F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= n).alias("mask"))


# --- weights --------------------------------------------------------------------


def given(rows: int, columns: int, name: str, seed: int = 0) -> list[list[float]]:
    """A matrix of fixed pseudo-random weights in +-1 / sqrt(columns)."""
    return [[(2 * mixed_number(name, i, j, seed=seed) / HASHES - 1) / math.sqrt(columns) for j in range(columns)] for i in range(rows)]


@dataclass
class Layer:
    """A message matrix over (source state, edge, time code) and an update matrix
    over (own state, aggregate)."""

    message: list[list[float]]
    update: list[list[float]]


@dataclass
class Weights:
    """All matrices of the encoder, per scale where they differ."""

    size: int
    edge: int
    code: int = 4
    depth: int = 1
    scales: tuple[str, ...] = ("short", "mid", "long")
    seed: int = 0
    layers: dict[str, list[Layer]] = field(init=False)
    readout: dict[str, list[list[float]]] = field(init=False)
    gate: dict[str, list[float]] = field(init=False)

    def __post_init__(self):
        d, e, t, s = self.size, self.edge, self.code, self.seed
        self.layers = {n: [Layer(given(d, d + e + t, f"{n}.m{i}", s), given(d, 2 * d, f"{n}.u{i}", s)) for i in range(self.depth)] for n in self.scales}
        self.readout = {n: given(d, 2 * d + e, f"{n}.r", s) for n in self.scales}
        self.gate = {n: given(1, d, f"{n}.g", s)[0] for n in self.scales}


def project(x: Column, matrix: list[list[float]]) -> Column:
    """matrix times x; ``x`` is computed once."""
    return vec.let(x, lambda v: F.transform(F.lit(matrix), lambda row: vec.total(F.zip_with(row, v, lambda a, b: a * b))))


def gelu(v: Column) -> Column:
    """The tanh form, entry by entry."""
    return F.transform(v, lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))))


def project_channels(edge: Column, a: list[int], b: list[int], wa: list[list[float]], wb: list[list[float]]) -> Column:
    """The edge's two channels projected apart (linear, layer norm, GELU) and
    joined, so that what the sender shapes never mixes with the rest here."""
    pick = lambda at: F.transform(F.lit(at), lambda i: F.element_at(edge, i + 1))
    one = lambda at, w: gelu(vec.layer_norm(project(pick(at), w)))
    return F.concat(one(a, wa), one(b, wb))


# --- layers -----------------------------------------------------------------------


def _trimmed(lists: Column, size: int, beta: float) -> Column:
    """Per coordinate the weighted mean of the messages left after trimming both ends."""

    def coordinate(j: Column) -> Column:
        ordered = F.array_sort(F.transform(lists, lambda t: F.struct(F.element_at(t["m"], j).alias("v"), t["flow_id"].alias("i"), t["w"].alias("w"))))
        cut = F.floor(F.size(lists) * F.lit(beta)).cast("int")
        kept = F.slice(ordered, cut + 1, F.size(lists) - 2 * cut)
        return vec.let(kept, lambda q: vec.total(F.transform(q, lambda t: t["w"] * t["v"])) / F.greatest(vec.total(F.transform(q, lambda t: t["w"])), F.lit(TINY)))

    return F.transform(F.sequence(F.lit(1), F.lit(size)), coordinate)


def layer(edges: DataFrame, states: DataFrame, weights: Layer, size: int, half_life_s: float, code: int = 4, beta: float = 0.2) -> DataFrame:
    """``bin, node, h`` after one round.

    ``edges``: ``bin, src, dst, flow_id, dt_s, e`` (array), at most a capped
    number per (bin, dst); ``states``: ``bin, node, h``. A message is
    GELU(M [source state, edge, time code]); messages are weighed by decay and
    aggregated by trimmed means; the new state is h + GELU(U [h, aggregate]).
    Nodes nobody writes to aggregate zeros.
    """
    source = states.select("bin", F.col("node").alias("src"), F.col("h").alias("hs"))
    told = edges.join(source, ["bin", "src"])
    message = gelu(project(F.concat("hs", "e", robust.time_encoding(F.col("dt_s"), code)), weights.message))
    weighed = robust.decay_weights(told.select("bin", "dst", "flow_id", "dt_s", message.alias("m")), ["bin", "dst"], half_life_s)
    lists = weighed.groupBy("bin", F.col("dst").alias("node")).agg(F.collect_list(F.struct("flow_id", F.col("weight").alias("w"), "m")).alias("l"))
    got = lists.select("bin", "node", _trimmed(F.col("l"), size, beta).alias("agg"))
    both = states.join(got, ["bin", "node"], "left").withColumn("agg", F.coalesce("agg", F.array_repeat(F.lit(0.0), size)))
    moved = gelu(project(F.concat("h", "agg"), weights.update))
    return both.select("bin", "node", F.zip_with("h", moved, lambda x, y: x + y).alias("h"))


def graph_norm(states: DataFrame, group: str, size: int, eps: float = 1e-5) -> DataFrame:
    """Mean 0 and variance 1 of every coordinate over the nodes of each graph: one
    fold of ``2 * size`` sums per graph, joined back."""
    at = lambda i: F.col("h")[i]
    facts = states.groupBy(group).agg(F.array(*[F.avg(at(i)) for i in range(size)]).alias("_m"), F.array(*[F.var_pop(at(i)) for i in range(size)]).alias("_v"))
    named = facts.withColumnRenamed(group, "_g")
    j = states.join(named, F.col(group).eqNullSafe(F.col("_g")))
    normed = F.transform(F.arrays_zip("h", "_m", "_v"), lambda t: (t["h"] - t["_m"]) / F.sqrt(t["_v"] + eps))
    return j.withColumn("h", normed).drop("_g", "_m", "_v")


def read_edges(targets: DataFrame, states: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """``bin, flow_id, z``: each target edge from both ends' states and its own features."""
    end = lambda name, h: states.select("bin", F.col("node").alias(name), F.col("h").alias(h))
    j = targets.join(end("src", "hs"), ["bin", "src"]).join(end("dst", "hd"), ["bin", "dst"])
    return j.select("bin", "flow_id", project(F.concat("hs", "hd", "e"), matrix).alias("z"))


def fuse(vectors: dict[str, Column], gate: dict[str, list[float]], size: int) -> tuple[Column, Column]:
    """The vectors of all scales as one, and the shares of the scales: a softmax
    of one gate score each."""
    names = list(vectors)
    score = lambda n: vec.total(F.zip_with(vectors[n], F.lit(gate[n]), lambda x, g: x * g))
    shares = vec.softmax(F.array(*[score(n) for n in names]))
    held = F.arrays_zip(F.array(*[vectors[n] for n in names]).alias("v"), shares.alias("g"))
    joined = F.aggregate(held, F.array_repeat(F.lit(0.0), size), lambda acc, t: F.zip_with(acc, t["v"], lambda a, x: a + x * t["g"]))
    return joined, shares


def encode(context: DataFrame, targets: DataFrame, states: DataFrame, weights: Weights, widths: dict[str, int] | None = None) -> DataFrame:
    """``bin, flow_id, z, shares``: every target edge encoded over all scales.

    ``context``: as of :func:`bin_batch`, with ``e``; ``targets``: ``bin,
    flow_id, src, dst, e``; ``states``: ``bin, node, h``, the first states.
    """
    widths = widths or graph.SCALES
    context, targets, states = materialise(context, "context"), materialise(targets, "targets"), materialise(states, "states")
    out = None
    for n in weights.scales:
        h, own = states, context.filter(F.col("scale") == n)
        for w in weights.layers[n]:
            h = materialise(layer(own, h, w, weights.size, widths[n] / 4000.0, weights.code), "states")  # read twice by the next layer
        z = read_edges(targets, h, weights.readout[n]).withColumnRenamed("z", f"z_{n}")
        out = z if out is None else out.join(z, ["bin", "flow_id"])
    z, shares = fuse({n: F.col(f"z_{n}") for n in weights.scales}, weights.gate, weights.size)
    return out.select("bin", "flow_id", z.alias("z"), shares.alias("shares"))


def forward(context: DataFrame, targets: DataFrame, states: DataFrame, weights: Weights, bank: DataFrame, widths: dict[str, int] | None = None, margin: float = 0.2, tau: float = 0.1, theta_unknown: float = 0.5, theta_defer: float = 0.1) -> DataFrame:
    """From windowed edges to verdicts: encoded, scored against the bank, decided."""
    return verdicts(encode(context, targets, states, weights, widths), bank, margin, tau, theta_unknown, theta_defer)


def verdicts(encoded: DataFrame, bank: DataFrame, margin: float = 0.2, tau: float = 0.1, theta_unknown: float = 0.5, theta_defer: float = 0.1) -> DataFrame:
    """Verdicts of edges that are encoded already (``z``)."""
    return prototypes.decide(prototypes.evidence(prototypes.cosines(encoded, bank, "z"), margin, tau), theta_unknown, theta_defer)


# --- memory -------------------------------------------------------------------------


def gru(h: Column, x: Column, gates: dict[str, list[list[float]]]) -> Column:
    """One step of a gated recurrent unit; ``gates``: matrices ``z``, ``r`` and
    ``n`` over (input, state)."""
    squash = lambda v: F.transform(v, lambda a: 1 / (1 + F.exp(-a)))

    def step(t: Column) -> Column:
        z, r = squash(project(F.concat(t["x"], t["h"]), gates["z"])), squash(project(F.concat(t["x"], t["h"]), gates["r"]))
        n = F.transform(project(F.concat(t["x"], F.zip_with(r, t["h"], lambda a, b: a * b)), gates["n"]), F.tanh)
        return vec.let(F.struct(z.alias("z"), n.alias("n")), lambda g: F.transform(F.arrays_zip(g["z"].alias("z"), g["n"].alias("n"), t["h"].alias("h")), lambda q: (1 - q["z"]) * q["n"] + q["z"] * q["h"]))

    return vec.let(F.struct(h.alias("h"), x.alias("x")), step)


def node_memory(events: DataFrame, node: str, x: str, gates: dict[str, list[list[float]]], size: int, k: int = graph.CAP, forget_ms: int = 600_000) -> DataFrame:
    """``node, n, last_ms, memory``: the state of each node after its latest ``k``
    events in time order, from zeros; a pause of more than ``forget_ms`` empties
    it. Lists are capped by a group limit below the exchange, so a node of any
    size is one short fold."""
    latest = graph.neighbours_recent(events, [node], k)
    lists = latest.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("ms", "flow_id", F.col(x).alias("x")))).alias("l"))
    zero = F.array_repeat(F.lit(0.0), size)

    def step(s: Column, t: Column) -> Column:
        return F.struct(t["ms"].alias("ms"), gru(F.when(t["ms"] - s["ms"] > forget_ms, zero).otherwise(s["h"]), t["x"], gates).alias("h"))

    run = F.aggregate("l", F.struct(F.element_at(F.col("l"), 1)["ms"].alias("ms"), zero.alias("h")), step)
    return lists.select(node, F.size("l").alias("n"), run["ms"].alias("last_ms"), run["h"].alias("memory"))
