"""Flow features: rhythm descriptors, flags, ports, histograms, vocabularies,
robust scaling and conditioning of heavy tails. Fitted state is a handful of
numbers per column, kept as plain values; transforms are projections."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill import schema
from flowmill.functions.mathx import normal_scores
from flowmill.operators.ranking import quantiles
from flowmill.plans.shared import read_text, write_text

EPS = 1e-6
KNOT_CELLS = 4096


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def finite(c: Column) -> Column:
    """NaN, infinities and null as 0."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(ok, c).otherwise(0.0)


def rhythm() -> dict[str, Column]:
    """The twelve rhythm descriptors and the mask of flows too short for them."""
    ratio = lambda a, b: a / (b + EPS)
    fwd, bwd = ({s: _d(f"{d}_IAT_{s}") for s in ("MIN", "MAX", "AVG", "STDDEV")} for d in ("SRC_TO_DST", "DST_TO_SRC"))
    packets, duration = _d("IN_PKTS") + _d("OUT_PKTS"), _d("FLOW_DURATION_MILLISECONDS")
    raw = {
        "iat_cv_fwd": ratio(fwd["STDDEV"], fwd["AVG"]),
        "iat_cv_bwd": ratio(bwd["STDDEV"], bwd["AVG"]),
        "iat_burst_fwd": ratio(fwd["MAX"] - fwd["MIN"], fwd["AVG"]),
        "iat_burst_bwd": ratio(bwd["MAX"] - bwd["MIN"], bwd["AVG"]),
        "duty_cycle": ratio(_d("DURATION_IN") + _d("DURATION_OUT"), duration),
        "pkt_rate": ratio(packets, duration),
        "byte_rate": ratio(_d("IN_BYTES") + _d("OUT_BYTES"), duration),
        "dir_asymmetry": ratio(fwd["AVG"] - bwd["AVG"], fwd["AVG"] + bwd["AVG"]),
        "pkt_size_spread": _d("LONGEST_FLOW_PKT") - _d("SHORTEST_FLOW_PKT"),
        "bytes_per_pkt_in": ratio(_d("IN_BYTES"), _d("IN_PKTS")),
        "bytes_per_pkt_out": ratio(_d("OUT_BYTES"), _d("OUT_PKTS")),
        "retrans_ratio": ratio(_d("RETRANSMITTED_IN_PKTS") + _d("RETRANSMITTED_OUT_PKTS"), packets),
    }
    return {n: finite(c) for n, c in raw.items()} | {"iat_undefined": F.when(packets <= 2, 1.0).otherwise(0.0)}


RHYTHM = ("iat_cv_fwd", "iat_cv_bwd", "iat_burst_fwd", "iat_burst_bwd", "duty_cycle", "pkt_rate", "byte_rate", "dir_asymmetry", "pkt_size_spread", "bytes_per_pkt_in", "bytes_per_pkt_out", "retrans_ratio")


def flag_bits() -> dict[str, Column]:
    """Every bit of the three flag columns as 0.0 or 1.0; null as no flags."""
    value = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return {f"{c}_{b}": F.shiftright(value(c), i).bitwiseAND(F.lit(1)).cast("double") for c in schema.FLAG_COLUMNS for i, b in enumerate(schema.FLAG_BITS)}


def port_features(c: str) -> dict[str, Column]:
    """Class flags of a port and its log scale; null as port 0."""
    p = F.coalesce(_d(c), F.lit(0.0))
    flag = lambda x: x.cast("double")
    return {
        f"{c}_is_well_known": flag(p < 1024), f"{c}_is_registered": flag((p >= 1024) & (p < 49152)),
        f"{c}_is_ephemeral": flag(p >= 49152), f"{c}_log": F.log1p(p) / math.log1p(65535),
    }


def port_bucket(c: str) -> Column:
    """``well_known`` up to 1023, ``registered`` up to 49151, else ``ephemeral``; null outside 0..65535."""
    p = F.col(c)
    return F.when(~p.between(0, 65535), None).when(p <= 1023, "well_known").when(p <= 49151, "registered").when(p <= 65535, "ephemeral")


def histogram() -> dict[str, Column]:
    """Packet-size bins as shares of their sum (0 if it is 0; null bins add
    nothing and stay 0), and the log of the sum."""
    bins = [F.coalesce(_d(b), F.lit(0.0)) for b in schema.PACKET_BINS]
    total = bins[0] + bins[1] + bins[2] + bins[3] + bins[4]
    return {f"pkt_size_hist_norm_{n}": F.when(total != 0, b / total).otherwise(0.0) for n, b in zip(schema.PACKET_BINS, bins, strict=True)} | {"pkt_size_hist_sum_log": F.log1p(F.greatest(total, F.lit(0.0)))}


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """``column, n``: the k most frequent values (ties: the smaller value)."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def one_hot(column: str, categories: list, prefix: str | None = None) -> dict[str, Column]:
    """A 0/1 column per category and one for all else (null included)."""
    prefix = prefix or column
    known = F.coalesce(F.col(column).isin(categories), F.lit(False)) if categories else F.lit(False)
    return {f"{prefix}_{v}": F.coalesce((F.col(column) == F.lit(v)), F.lit(False)).cast("double") for v in categories} | {f"{prefix}_OTHER": (~known).cast("double")}


def other_rate(df: DataFrame, column: str, categories: list) -> DataFrame:
    """Share of rows outside the vocabulary: how far a table has drifted."""
    return df.agg(F.avg(one_hot(column, categories)[f"{column}_OTHER"]).alias("other_rate"))


def signed_log(c: Column, clip_negative: bool = True) -> Column:
    """log1p of the value; negatives as 0, or mirrored if not clipped."""
    return F.log1p(F.greatest(c, F.lit(0.0))) if clip_negative else F.signum(c) * F.log1p(F.abs(c))


def robust_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (0 as 1) of each column, null read as 0.

    All columns are stacked and ranked together, in balanced slices (exact; see
    :func:`ranking.quantiles`); three numbers a column reach the driver.
    """
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(_d(c), F.lit(0.0)).alias("x")) for c in columns])))
    got: dict[str, dict[float, float]] = {}
    for r in quantiles(each, ["feature"], F.col("x"), [0.25, 0.5, 0.75]).collect():
        got.setdefault(r["feature"], {})[r["q"]] = r["value"]
    return {c: (q[0.5], (q[0.75] - q[0.25]) or 1.0) if (q := got.get(c)) else (0.0, 1.0) for c in columns}


def robust_scale(fit: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (F.coalesce(_d(c), F.lit(0.0)) - m) / iqr for c, (m, iqr) in fit.items()}


def knots_fit(df: DataFrame, values: dict[str, Column], n: int = 1000, shape=None) -> dict[str, list[float]]:
    """``n`` evenly spaced quantiles of each column, in one pass. ``shape``, if
    given, is applied to every value (as one short expression over the array of
    values: written out per column it would make methods too long to compile).

    Rows are folded on the map side to counts, minima and maxima per column and
    cell of width 1 / KNOT_CELLS; a knot is placed inside its cell by its rank.
    So it errs by less than a cell (not at all where a cell holds one value),
    and states of any parts add up.
    """
    row = F.array(*values.values())
    each = df.select(F.posexplode(row if shape is None else F.transform(row, shape)).alias("feature", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    cells = each.groupBy("feature", F.floor(F.col("x") * KNOT_CELLS).alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = F.sum("c").over(Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # over cells, not rows
    placed = cells.withColumn("upto", upto).withColumn("rows", F.sum("c").over(Window.partitionBy("feature"))).withColumn("before", F.col("upto") - F.col("c"))
    # knot i has the rank i * (rows - 1) div (n - 1), from 0
    first = F.when(F.col("rows") > 1, F.ceil(F.col("before") * (n - 1) / (F.col("rows") - 1))).otherwise(0)
    last = F.when(F.col("rows") > 1, F.least(F.ceil(F.col("upto") * (n - 1) / (F.col("rows") - 1)) - 1, F.lit(n - 1))).otherwise(n - 1)
    asked = placed.filter(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    rank = F.floor(F.col("i") * (F.col("rows") - 1) / (n - 1)) - F.col("before")
    knot = F.col("lo") + (F.col("hi") - F.col("lo")) * F.least(F.greatest(rank, F.lit(0)), F.col("c") - 1) / F.greatest(F.col("c") - 1, F.lit(1))
    found = asked.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", knot.alias("k")))), lambda x: x["k"]).alias("knots"))
    told = {r["feature"]: list(r["knots"]) for r in found.collect()}  # n numbers a column
    return {k: told.get(i) or [0.0, 0.0] for i, k in enumerate(values)}


def vocabularies(df: DataFrame, sizes: dict[str, int]) -> dict[str, list]:
    """The most frequent values of several columns, as :func:`top_categories` gives
    them, from one fold of all."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("x")) for c in sizes]))).filter(F.col("x").isNotNull())
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("x"))
    top = each.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(sizes.values()))
    got = sorted(top.collect(), key=lambda r: r["r"])  # at most k a column
    return {c: [r["x"] for r in got if r["feature"] == c][:k] for c, k in sizes.items()}


def to_normal(values: dict[str, Column], knots: dict[str, list[float]], clip: float = 5.0) -> Column:
    """One array: every value's quantile among its knots, as a normal deviate."""
    return normal_scores(F.array(*values.values()), [knots[n] for n in values], clip)


@dataclass
class FeaturePipeline:
    """Fit on training rows only; transform any rows; save and load as JSON.

    The blocks in order: conditioned heavy tails, scaled bounded columns, packet
    histogram, flag bits, one-hot protocol and application, both ports, one-hot
    destination ports, conditioned rhythm with its mask. ``rhythm=False`` drops
    the rhythm block, ``temporal=False`` drops it and the heavy-tailed block,
    ``condition=False`` passes heavy tails as they are.
    """

    quantiles: int = 1000
    clip: float = 5.0
    condition: bool = True
    rhythm: bool = True
    temporal: bool = True
    knots: dict = field(default_factory=dict)
    rhythm_knots: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    vocabulary: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "FeaturePipeline":
        tails = {c: _d(c) for c in schema.HEAVY_TAILED} if self.temporal and self.condition else {}
        beats = {n: c for n, c in rhythm().items() if n in RHYTHM} if self.temporal and self.rhythm else {}
        if tails or beats:
            found = knots_fit(df, tails | beats, self.quantiles, lambda x: signed_log(finite(x)))
            self.knots, self.rhythm_knots = {c: found[c] for c in tails}, {c: found[c] for c in beats}
        self.scale = robust_fit(df, list(schema.BOUNDED))
        self.vocabulary = vocabularies(df, schema.CATEGORICAL)
        return self

    def _conditioned(self) -> tuple[dict[str, Column], dict[str, list[float]]]:
        values: dict[str, Column] = {}
        if self.temporal and self.condition:
            values |= {c: signed_log(finite(_d(c))) for c in schema.HEAVY_TAILED}
        if self.temporal and self.rhythm:
            values |= {n: signed_log(c) for n, c in rhythm().items() if n in RHYTHM}
        return values, self.knots | self.rhythm_knots

    def columns(self) -> dict[str, Column]:
        """The features by name; conditioned ones are entries of the array
        ``_normal`` that :meth:`transform` adds first."""
        at = {n: F.col("_normal")[i] for i, n in enumerate(self._conditioned()[0])}
        out: dict[str, Column] = {}
        if self.temporal:
            out |= {c: at[c] if self.condition else finite(_d(c)) for c in schema.HEAVY_TAILED}
        out |= robust_scale(self.scale) | histogram() | flag_bits()
        out |= one_hot("PROTOCOL", self.vocabulary["PROTOCOL"]) | one_hot("L7_PROTO", self.vocabulary["L7_PROTO"])
        out |= port_features("L4_SRC_PORT") | port_features("L4_DST_PORT") | one_hot("L4_DST_PORT", self.vocabulary["L4_DST_PORT"], "L4_DST_PORT_topk")
        if self.temporal and self.rhythm:
            out |= {n: at[n] for n in RHYTHM} | {"iat_undefined": rhythm()["iat_undefined"]}
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        values, knots = self._conditioned()
        if values:
            df = df.withColumn("_normal", to_normal(values, knots, self.clip))
        return df.select(*(keep or []), *[c.alias(n) for n, c in self.columns().items()])

    def manifest(self) -> dict:
        names = list(self.columns())
        return {"feature_names": names, "n_features": len(names), "channels": {n: channel(n) for n in names}}

    def save(self, path: str) -> None:
        """State and manifest as JSON, anywhere the session's file systems reach."""
        write_text(SparkSession.active(), path, json.dumps({"state": asdict(self), "manifest": self.manifest()}))

    @classmethod
    def load(cls, path: str) -> "FeaturePipeline":
        return cls(**json.loads(read_text(SparkSession.active(), path))["state"])


# Features by who shapes them, the sender (channel A) or the path and the observer (channel B).
_SENT = (
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "TCP_WIN_MAX_IN",
    "TCP_WIN_MAX_OUT", "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE", "FTP_COMMAND_RET_CODE", "NUM_PKTS_UP_TO_128_BYTES",
    "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES", "pkt_size_hist_sum_log",
    "pkt_size_spread", "bytes_per_pkt_in", "bytes_per_pkt_out", "TCP_FLAGS_FIN", "TCP_FLAGS_SYN", "TCP_FLAGS_RST", "TCP_FLAGS_PSH", "TCP_FLAGS_ACK",
    "TCP_FLAGS_URG", "TCP_FLAGS_ECE", "TCP_FLAGS_CWR", "CLIENT_TCP_FLAGS_FIN", "CLIENT_TCP_FLAGS_SYN", "CLIENT_TCP_FLAGS_RST", "CLIENT_TCP_FLAGS_PSH",
    "CLIENT_TCP_FLAGS_ACK", "CLIENT_TCP_FLAGS_URG", "CLIENT_TCP_FLAGS_ECE", "CLIENT_TCP_FLAGS_CWR", "SERVER_TCP_FLAGS_FIN", "SERVER_TCP_FLAGS_SYN",
    "SERVER_TCP_FLAGS_RST", "SERVER_TCP_FLAGS_PSH", "SERVER_TCP_FLAGS_ACK", "SERVER_TCP_FLAGS_URG", "SERVER_TCP_FLAGS_ECE", "SERVER_TCP_FLAGS_CWR",
    "L4_SRC_PORT_is_well_known", "L4_SRC_PORT_is_registered", "L4_SRC_PORT_is_ephemeral", "L4_SRC_PORT_log", "L4_DST_PORT_is_well_known",
    "L4_DST_PORT_is_registered", "L4_DST_PORT_is_ephemeral", "L4_DST_PORT_log",
)
_OBSERVED = (
    "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "SRC_TO_DST_AVG_THROUGHPUT",
    "DST_TO_SRC_AVG_THROUGHPUT", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX",
    "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV", "MIN_TTL", "MAX_TTL", "DNS_TTL_ANSWER", "iat_cv_fwd", "iat_cv_bwd", "iat_burst_fwd",
    "iat_burst_bwd", "duty_cycle", "pkt_rate", "byte_rate", "dir_asymmetry", "retrans_ratio", "iat_undefined",
)


def channel(name: str) -> str | None:
    """``A``, ``B``, or None for a name of neither; names made from data go by prefix."""
    if name in _OBSERVED:
        return "B"
    made = ("L4_DST_PORT_topk_", "PROTOCOL_", "L7_PROTO_", "pkt_size_hist_norm_")
    return "A" if name in _SENT or name.startswith(made) else None


def channels(names: list[str]) -> tuple[list[int], list[int]]:
    """Positions of both channels; raises if a name belongs to neither."""
    told = [channel(n) for n in names]
    if None in told:
        raise ValueError(f"feature {names[told.index(None)]!r} belongs to no channel")
    return [i for i, c in enumerate(told) if c == "A"], [i for i, c in enumerate(told) if c == "B"]
