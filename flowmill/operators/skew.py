"""Aggregates over joins whose keys are held by a few heavy hitters.

A join on a key that holds a third of all rows would put those rows (and, if
both sides are heavy, the product of them) on one task. Eager aggregation
avoids this: each input is first folded to one compact state per key. The fold
combines on the map side, so a key contributes at most one state per map task
to the shuffle, whatever its share. Only states are joined, one row per key
and side; the result of the join of rows follows algebraically: a sum of left
values over all pairs is ``left_sum * right_rows``, the number of pairs is
``left_rows * right_rows``. Coarser results are rolled up from the states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "decimal(38,0)"


def key_states(df: DataFrame, key: Column, sums: dict[str, Column], prefix: str) -> DataFrame:
    """One row per key: ``{prefix}_rows``, ``{prefix}_{name}`` (sum of the
    non-null values, 0.0 if none) and ``{prefix}_{name}_n`` (their number).

    Rows whose key is null are left out: they join with nothing. Names are
    made here, so extra or clashing columns of ``df`` do not matter.
    """
    values = df.select(key.alias("_key"), *[v.cast("double").alias(f"_{n}") for n, v in sums.items()])
    states = values.filter(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        *[a for n in sums for a in (F.coalesce(F.sum(f"_{n}"), F.lit(0.0)).alias(f"{prefix}_{n}"), F.count(f"_{n}").alias(f"{prefix}_{n}_n"))],
    )
    return states


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    how: str = "full",
) -> DataFrame:
    """Per-key aggregates of ``left JOIN right`` without forming the join.

    Output: ``key``, the states of both sides (``l_rows``, ``l_<name>``, ...,
    ``r_rows``, ...), ``pair_rows`` and, for each sum, ``pair_l_<name>`` and
    ``pair_r_<name>``: what the row-level equi-join would have given. With
    ``how="full"`` keys of one side only come out too, with 0 rows on the
    other; ``inner`` keeps keys of both. Empty inputs give an empty result (or
    the other side alone); repeated rows count as rows; null keys are left out.
    The join reuses the partitioning of the folds: two shuffles of states.
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    ls, rs = key_states(left, left_key, left_sums, "l"), key_states(right, right_key, right_sums, "r")
    joined = ls.join(rs, "_key", how)
    counts = [c for c in joined.columns if c.endswith("_rows") or c.endswith("_n")]
    joined = joined.na.fill(0, counts).na.fill(0.0, [c for c in joined.columns if c not in counts and c != "_key"])
    pairs = F.col("l_rows").cast("decimal(19,0)") * F.col("r_rows").cast("decimal(19,0)")
    return joined.select(
        F.col("_key").alias("key"),
        *[F.col(c) for c in joined.columns if c != "_key"],
        pairs.cast(ROWS).alias("pair_rows"),
        *[(F.col(f"l_{n}") * F.col("r_rows")).alias(f"pair_l_{n}") for n in left_sums],
        *[(F.col(f"r_{n}") * F.col("l_rows")).alias(f"pair_r_{n}") for n in right_sums],
    )


def side_rows(states: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """States of both sides below each other: ``side, key, n_rows``."""
    stacked = states.select(
        "key",
        F.explode(F.array(
            F.struct(F.lit(left_name).alias("side"), F.col("l_rows").alias("n_rows")),
            F.struct(F.lit(right_name).alias("side"), F.col("r_rows").alias("n_rows")),
        )).alias("s"),
    )
    return stacked.select("s.side", "key", "s.n_rows").filter("n_rows > 0")


def heavy_keys(states: DataFrame, left_name: str, right_name: str, min_share: float) -> DataFrame:
    """Keys that hold at least ``min_share`` of a side's rows with a key.

    Rolled up from the states of :func:`eager_join_aggregate`: ``side, key,
    n_rows, total``. The totals are one row per side (proven: two), so their
    broadcast is bounded.
    """
    rows = side_rows(states, left_name, right_name)
    totals = rows.groupBy("side").agg(F.sum("n_rows").alias("total"))
    return rows.join(F.broadcast(totals), "side").filter(F.col("n_rows") >= F.lit(min_share) * F.col("total"))
