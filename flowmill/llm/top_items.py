"""Most frequent values of columns with unbounded numbers of distinct values.

Exact, by spillable hash aggregation: one scan stacks the asked fields as
(field, item) and folds counts on the map side; the shuffle hash-partitions
what is left by (field, item), so every partition holds a disjoint part of the
distinct values and spills to disk when they outgrow its memory. Each partition
keeps its own top k per field, and only those (k per field and partition) are
ordered in the final limit. No task ever sees all distinct values, and a hot
value costs one partial count per map task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``field_name, item, n``: exact counts of every non-null item of each field.

    Items are compared as text. Nulls are left out; an empty table gives no row.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("field_name"), c.cast("string").alias("item")) for name, c in fields.items()
    ])).alias("s")).select("s.field_name", "s.item")
    return stacked.filter(F.col("item").isNotNull()).groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n"))


def _top(counts: DataFrame, k: int) -> DataFrame:
    # row_number <= k is planned as a group limit below the exchange (the local
    # top k of each partition) and once more above it.
    w = Window.partitionBy("field_name").orderBy(F.desc("n"), F.asc("item"))
    return counts.withColumn("item_rank", F.row_number().over(w)).filter(F.col("item_rank") <= k)


def top_items(df: DataFrame, fields: dict[str, Column], k: int) -> DataFrame:
    """``field_name, item, n, item_rank``: the ``k`` most frequent items of each
    field; ties are broken by the item's text, so the result is deterministic."""
    return _top(item_counts(df, fields), k)


def frequent_items(df: DataFrame, fields: dict[str, Column], min_share: float) -> DataFrame:
    """``field_name, item, n, total``: every item holding at least ``min_share``
    of its field's non-null rows. At most ``1 / min_share`` items can, so the
    top ``floor(1 / min_share)`` contain them all. ``total`` is folded from the
    same counts (one row per field, which bounds the broadcast).
    """
    counts = item_counts(df, fields)
    totals = counts.groupBy("field_name").agg(F.sum("n").alias("total"))
    top = _top(counts, math.floor(1 / min_share + 1e-9))
    return top.join(F.broadcast(totals), "field_name").filter(F.col("n") >= F.lit(min_share) * F.col("total")).drop("item_rank")
