"""Cleaning, canonical labels, deduplication, and the feasible set of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill import schema
from flowmill.functions.text import label_key
from flowmill.plans.shared import broadcast_if_small

HEADER_BYTES, LARGEST_PACKET = 40, 1514


def usable(low_ms: int = schema.VALID_MS[0], high_ms: int = schema.VALID_MS[1]) -> dict[str, Column]:
    """The rules a flow must pass, by name, in the order they are counted."""
    start = F.col("FLOW_START_MILLISECONDS")
    return {
        "null_label": F.col("Attack").isNull(),
        "null_time": start.isNull(),
        "implausible_time": start.isNotNull() & ~start.between(low_ms, high_ms),
    }


def drop_unusable(df: DataFrame, low_ms: int = schema.VALID_MS[0], high_ms: int = schema.VALID_MS[1]) -> DataFrame:
    """Flows with a label and a plausible start time. All filters reach the scan."""
    return df.filter(F.col("Attack").isNotNull() & F.col("FLOW_START_MILLISECONDS").between(low_ms, high_ms))


def clip_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Negative measures become 0; NaN becomes null, null stays."""
    known = lambda c: F.nullif(F.col(c), F.lit(float("nan"))) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(known(c)) for c in columns})


def deduplicate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (the smallest ``flow_id``) per distinct tuple of features.

    The fold is by two 64-bit hashes of the tuple, so wide rows are not
    shuffled twice; the map side already drops copies.
    """
    cols = list(columns or schema.RAW_FEATURES)
    return df.join(_firsts(df, cols), "flow_id", "left_semi")


def _firsts(df: DataFrame, cols: list[str]) -> DataFrame:
    h = [F.xxhash64(*cols).alias("_a"), F.xxhash64(F.lit(11), *cols).alias("_b")]
    return df.select("flow_id", *h).groupBy("_a", "_b").agg(F.min("flow_id").alias("flow_id")).select("flow_id")


def clean_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows in, rows dropped by each rule, duplicates, rows kept.

    Rules are counted in order, each row under the first it fails.
    """
    cols = list(columns or schema.RAW_FEATURES)
    rules = usable()
    verdict = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()], F.lit("ok"))
    h = F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(11), *cols).alias("b"))
    groups = df.select(verdict.alias("v"), h.alias("h")).groupBy("v", "h").agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy("v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    got = lambda v, c: F.coalesce(F.sum(F.when(F.col("v") == v, F.col(c))), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), *[got(n, "n").alias(f"dropped_{n}") for n in rules],
        (got("ok", "n") - got("ok", "d")).alias("dropped_duplicates"), got("ok", "d").alias("rows_kept"),
    )


def canonical_labels(df: DataFrame, vocabulary: DataFrame, dataset: str, strict: bool = False, exact: bool = False) -> DataFrame:
    """``df`` with ``canonical_label`` and ``family`` of its ``Attack``.

    Labels are compared by :func:`label_key` (or, with ``exact``, as written).
    Unknown labels give null; with ``strict`` they raise when the plan runs.
    The vocabulary is broadcast only if it is small.
    """
    key = (lambda c: F.col(c)) if exact else label_key
    names = vocabulary.filter(F.col("dataset") == dataset).select(key("raw_label").alias("_key"), "canonical_label", "family").dropDuplicates(["_key"])
    out = df.withColumn("_key", key("Attack")).join(broadcast_if_small(names, 100_000), "_key", "left").drop("_key")
    if strict:
        told = F.raise_error(F.concat(F.lit(f"label unknown for {dataset}: "), F.coalesce("Attack", F.lit("null"))))
        out = out.withColumn("canonical_label", F.when(F.col("canonical_label").isNull(), told.cast("string")).otherwise(F.col("canonical_label")))
    return out


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """``label, label_id``: ids from 0 in the labels' order. Labels are few."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return names.agg(F.array_sort(F.collect_set(label)).alias("a")).select(F.posexplode("a").alias("label_id", label)).select(label, "label_id")


def feasible(df: DataFrame) -> DataFrame:
    """Flows moved onto the feasible set: whole packet counts, at least 40
    bytes a packet, parts of a duration no longer than the whole, ordered
    minima and maxima, ports in range. Absent columns are skipped; halves round
    to even. Null stays null, but a null minimum or maximum takes the other's value."""
    has = set(df.columns)
    at_least = lambda c, v: F.when(F.col(c) < v, v.cast("double") if isinstance(v, Column) else F.lit(v).cast("double")).otherwise(F.col(c).cast("double"))
    for p in ("IN", "OUT"):
        if f"{p}_PKTS" in has:
            df = df.withColumn(f"{p}_PKTS", F.rint(at_least(f"{p}_PKTS", 0)))
            if f"{p}_BYTES" in has:
                df = df.withColumn(f"{p}_BYTES", at_least(f"{p}_BYTES", F.col(f"{p}_PKTS") * HEADER_BYTES))
    if "FLOW_DURATION_MILLISECONDS" in has:
        df = df.withColumn("FLOW_DURATION_MILLISECONDS", at_least("FLOW_DURATION_MILLISECONDS", 0))
        if {"DURATION_IN", "DURATION_OUT"} <= has:
            both = F.col("DURATION_IN") + F.col("DURATION_OUT")
            scale = F.when(both > F.col("FLOW_DURATION_MILLISECONDS"), F.coalesce(F.try_divide(F.col("FLOW_DURATION_MILLISECONDS"), both), F.lit(1.0))).otherwise(1.0)
            df = df.withColumn("_scale", scale).withColumns({c: F.col(c) * F.col("_scale") for c in ("DURATION_IN", "DURATION_OUT")}).drop("_scale")
    for low, high, cap in (("SHORTEST_FLOW_PKT", "LONGEST_FLOW_PKT", LARGEST_PACKET), ("MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", None)):
        if {low, high} <= has:
            lo, hi = F.least(low, high), F.greatest(low, high)
            df = df.withColumn("_lo", lo).withColumn(high, hi if cap is None else F.least(hi, F.lit(cap))).withColumn(low, F.col("_lo")).drop("_lo")
    for d in ("SRC_TO_DST_IAT", "DST_TO_SRC_IAT"):
        lo, mid, hi = f"{d}_MIN", f"{d}_AVG", f"{d}_MAX"
        if {lo, mid, hi} <= has:
            df = df.withColumns({"_lo": F.least(lo, mid, hi), "_hi": F.greatest(lo, mid, hi)}).withColumns({lo: F.col("_lo"), hi: F.col("_hi")}).drop("_lo", "_hi")
        if f"{d}_STDDEV" in has:
            df = df.withColumn(f"{d}_STDDEV", at_least(f"{d}_STDDEV", 0))
    for p in schema.PORTS:
        if p in has:
            df = df.withColumn(p, F.when(F.col(p).isNotNull(), F.rint(F.least(at_least(p, 0), F.lit(65535.0)))))
    if {*schema.PACKET_BINS, "IN_PKTS", "OUT_PKTS"} <= has:  # the bins count the packets
        total = sum((F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in schema.PACKET_BINS[1:]), F.coalesce(F.col(schema.PACKET_BINS[0]).cast("double"), F.lit(0.0)))
        packets = F.coalesce("IN_PKTS", F.lit(0.0)) + F.coalesce("OUT_PKTS", F.lit(0.0))
        df = df.withColumn("_f", F.when(total > packets, packets / total).otherwise(1.0)).withColumns({b: F.floor(F.col(b) * F.col("_f")).cast("double") for b in schema.PACKET_BINS}).drop("_f")
    return df


def infeasible() -> dict[str, Column]:
    """Predicates a feasible flow must not meet."""
    out = {f"{p.lower()}_bytes_below_header": F.col(f"{p}_BYTES") < F.col(f"{p}_PKTS") * HEADER_BYTES - 1e-6 for p in ("IN", "OUT")}
    for d, n in (("SRC_TO_DST_IAT", "fwd"), ("DST_TO_SRC_IAT", "bwd")):
        out[f"{n}_iat_unordered"] = (F.col(f"{d}_MIN") > F.col(f"{d}_AVG") + 1e-6) | (F.col(f"{d}_AVG") > F.col(f"{d}_MAX") + 1e-6)
    return out


def source_guard(df: DataFrame, source: str, least: int = schema.MIN_SOURCES) -> DataFrame:
    """One row: distinct sources, and the node names they allow (``ip`` only if
    there are at least ``least`` sources, else ``ip_port``)."""
    n = df.agg(F.countDistinct(source).alias("n_sources"))
    return n.withColumn("granularity", F.when(F.col("n_sources") >= least, "ip").otherwise("ip_port"))


def require_sources(df: DataFrame, source: str, granularity: str = "ip", least: int = schema.MIN_SOURCES) -> None:
    """Raises if ``ip`` is asked for with too few distinct sources."""
    if granularity == "ip" and df.agg(F.countDistinct(source).alias("n")).first()["n"] < least:
        raise ValueError(f"fewer than {least} distinct sources: name nodes by address and port")
