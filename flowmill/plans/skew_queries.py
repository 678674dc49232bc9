"""Problem 1: per-source results although a few sources hold most flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import ipv4, ipv4_sql, measure, measure_sql
from flowmill.operators.skew import eager_join_aggregate, heavy_keys
from flowmill.sources.tables import table

HEAVY_SHARE = 0.05
_SUMS = ("IN_BYTES", "OUT_BYTES")


def _states(spark: SparkSession, d: str, sums: tuple[str, ...] = ()) -> DataFrame:
    cols = {c.lower(): measure(c) for c in sums}
    bot, unsw = table(spark, d, "nf_bot_iot_v3"), table(spark, d, "nf_unsw_nb15_v3")
    return eager_join_aggregate(bot, unsw, ipv4("IPV4_SRC_ADDR"), ipv4("IPV4_SRC_ADDR"), cols, cols)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source addresses with at least 5 % of a dataset's flows that have one."""
    return heavy_keys(_states(spark, d), "bot_iot", "unsw_nb15", HEAVY_SHARE).select(F.col("side").alias("dataset"), F.col("key").alias("addr"))


def p1_source_join(spark: SparkSession, d: str) -> DataFrame:
    """Per address: flows and bytes of both datasets and of their join."""
    s = _states(spark, d, _SUMS)
    return s.select(
        F.col("key").alias("addr"),
        F.col("l_rows").alias("bot_flows"), F.col("r_rows").alias("unsw_flows"),
        F.col("l_in_bytes").alias("bot_in_bytes"), F.col("r_in_bytes").alias("unsw_in_bytes"),
        F.col("l_in_bytes_n").alias("bot_in_known"), F.col("r_in_bytes_n").alias("unsw_in_known"),
        F.col("l_out_bytes").alias("bot_out_bytes"), F.col("r_out_bytes").alias("unsw_out_bytes"),
        F.col("pair_rows").cast("double").alias("pair_flows"),
        F.col("pair_l_in_bytes").alias("pair_bot_in_bytes"),
        F.col("pair_r_in_bytes").alias("pair_unsw_in_bytes"),
    )


def p1_source_peers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct destination addresses per source: (source, peer) is folded
    first, so a heavy source is spread over its peers before it is counted."""
    b = table(spark, d, "nf_bot_iot_v3").select(ipv4("IPV4_SRC_ADDR").alias("addr"), ipv4("IPV4_DST_ADDR").alias("peer"))
    pairs = b.filter("addr IS NOT NULL").groupBy("addr", "peer").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("addr").agg(F.sum("n").alias("flows"), F.count("peer").alias("peers"))


_FOLD = """SELECT addr, count(*) n, coalesce(sum(ib), 0) ib, count(ib) ibn, coalesce(sum(ob), 0) ob
FROM (SELECT {a} addr, {ib} ib, {ob} ob FROM {t}) WHERE addr IS NOT NULL GROUP BY addr"""


def _fold(t: str) -> str:
    return _FOLD.format(a=ipv4_sql("IPV4_SRC_ADDR"), ib=measure_sql("IN_BYTES"), ob=measure_sql("OUT_BYTES"), t=t)


QUERIES = {"p1_found": p1_found, "p1_source_join": p1_source_join, "p1_source_peers": p1_source_peers}

SQL = {
    "p1_found": " UNION ALL ".join(
        f"""SELECT dataset, addr FROM (SELECT '{ds}' dataset, addr, count(*) n, sum(count(*)) OVER () t
        FROM (SELECT {ipv4_sql("IPV4_SRC_ADDR")} addr FROM {t}) WHERE addr IS NOT NULL GROUP BY addr) WHERE n >= 0.05 * t"""
        for ds, t in (("bot_iot", "nf_bot_iot_v3"), ("unsw_nb15", "nf_unsw_nb15_v3"))
    ),
    "p1_source_join": f"""WITH b AS ({_fold("nf_bot_iot_v3")}), u AS ({_fold("nf_unsw_nb15_v3")})
        SELECT coalesce(b.addr, u.addr) addr, coalesce(b.n, 0) bot_flows, coalesce(u.n, 0) unsw_flows,
        coalesce(b.ib, 0)::DOUBLE bot_in_bytes, coalesce(u.ib, 0)::DOUBLE unsw_in_bytes,
        coalesce(b.ibn, 0) bot_in_known, coalesce(u.ibn, 0) unsw_in_known,
        coalesce(b.ob, 0)::DOUBLE bot_out_bytes, coalesce(u.ob, 0)::DOUBLE unsw_out_bytes,
        (coalesce(b.n, 0) * coalesce(u.n, 0))::DOUBLE pair_flows,
        (coalesce(b.ib, 0) * coalesce(u.n, 0))::DOUBLE pair_bot_in_bytes,
        (coalesce(u.ib, 0) * coalesce(b.n, 0))::DOUBLE pair_unsw_in_bytes
        FROM b FULL JOIN u ON b.addr = u.addr""",
    "p1_source_peers": f"""SELECT addr, count(*) flows, count(DISTINCT peer) peers
        FROM (SELECT {ipv4_sql("IPV4_SRC_ADDR")} addr, {ipv4_sql("IPV4_DST_ADDR")} peer FROM nf_bot_iot_v3)
        WHERE addr IS NOT NULL GROUP BY addr""",
}
