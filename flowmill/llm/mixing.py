"""Mixing sources to target shares of the total size, by capped repetition.

Sizes are summed per source; a source's repetition rate is what its share of
the total needs, at most its cap. A record is emitted ``floor(rate)`` times and
once more with probability equal to the fraction, decided by a hash of its key
and a seed, so the mixture is the same on every run and partitioning and needs
no shuffle of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.plans.shared import broadcast_if_small

MAX_SOURCES = 100_000


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_records, size, total, wanted,
    rate, short``: what each target source needs.

    ``sizes``: ``source`` (null for records of no target source), ``size``, one
    row per record; ``targets``: ``source, target_share, max_repeats``. All
    records count in ``total``, also those of no target source. A source is
    ``short`` if its share of the total exceeds ``max_repeats`` times its size;
    its rate is then the cap. Without any size the rate is the cap as well (0 if
    the total is 0). Targets without records stay, with size 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").alias("size"))
    total = per.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total")).scalar()
    joined = targets.join(per, "source", "left").na.fill(0, ["n_records", "size"]).withColumn("total", total)
    wanted = F.col("target_share") * F.col("total")
    need = F.when(F.col("size") > 0, wanted / F.col("size")).when(wanted > 0, F.lit(float("inf"))).otherwise(0.0)
    return joined.withColumn("wanted", wanted).withColumn("rate", F.least(need, F.col("max_repeats").cast("double"))).withColumn(
        "short", wanted > F.col("max_repeats") * F.col("size")
    )


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often a record is used: floor(rate), and one more with the
    probability of the fraction, by a hash of key and seed."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(2**53)
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix(records: DataFrame, rates: DataFrame, key: str, seed: int = 29) -> DataFrame:
    """``key, source, size, copies`` of every record used at least once.

    ``records``: ``key, source, size``. The rates are one row per source; they
    are broadcast only if they are few. Records of no target source, and of
    sources with rate 0, are not used.
    """
    small = broadcast_if_small(rates.select("source", "rate"), MAX_SOURCES)
    used = records.join(small, "source").withColumn("copies", copies(F.col("rate"), F.col(key), seed))
    return used.filter("copies > 0").select(key, "source", "size", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per use: the columns of ``mixed`` with ``copy_no`` (from 1)."""
    return mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def share_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: its rate, the size used and the share reached."""
    used = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used_size"), F.max("copies").alias("most_copies"))
    all_used = used.agg(F.coalesce(F.sum("used_size"), F.lit(0)).alias("mixture_size")).scalar()
    r = rates.join(used, "source", "left").na.fill(0, ["used_size", "most_copies"]).withColumn("mixture_size", all_used)
    actual = F.when(F.col("mixture_size") > 0, F.col("used_size") / F.col("mixture_size")).otherwise(0.0)
    return r.select("source", "target_share", "max_repeats", "n_records", "size", "rate", "short", "used_size", "most_copies", actual.alias("actual_share"), (actual - F.col("target_share")).alias("gap"))
