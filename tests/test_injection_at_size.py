"""Injected edges are many times their targets: how they meet the pool."""

import math

import pytest
from pyspark.sql import functions as F

from flowmill.operators import adversarial
from flowmill.operators.ranking import HASHES, mixed_number

BUDGETS = (0, 1, 3, 8)


def _tables(spark):
    targets = spark.range(40).select((F.col("id") + 1000).alias("flow_id"), (F.col("id") * 50).alias("ms"), F.lit("a").alias("src"), F.lit("b").alias("dst"))
    pool = spark.range(0, 27_000, 3).select(F.col("id").alias("flow_id"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("bytes"))
    return targets, pool


def _broadcast(plan: str) -> str:
    """The lines of a plan that lie below a broadcast."""
    found, above = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if above is not None and depth > above:
            found.append(line)
            continue
        above = depth if "BroadcastExchange" in line else None
    return "\n".join(found)


@pytest.mark.parametrize("packed", [0, adversarial.PACKED_POOL])
def test_the_multiplied_side_is_never_broadcast(spark, monkeypatch, packed):
    monkeypatch.setattr(adversarial, "PACKED_POOL", packed)
    targets, pool = _tables(spark)
    plan = adversarial.inject_edges(targets, pool, 1000, BUDGETS)._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan and "explode" not in _broadcast(plan)


@pytest.mark.parametrize("packed", [0, adversarial.PACKED_POOL])
def test_either_way_the_same_edges_are_drawn(spark, monkeypatch, packed):
    monkeypatch.setattr(adversarial, "PACKED_POOL", packed)
    targets, pool = _tables(spark)
    values = [r["bytes"] for r in pool.orderBy("flow_id").collect()]
    want = {(t, b, i): values[math.floor(mixed_number(i, t, seed=4) / HASHES * len(values))] for t in range(1000, 1040) for b in BUDGETS for i in range(b)}
    got = adversarial.inject_edges(targets, pool, 1000, BUDGETS, seed=3).collect()
    assert len(got) == len(want) and {(r["target_id"], r["budget"], r["i"]): r["bytes"] for r in got} == want
    assert adversarial.inject_edges(targets, pool, 1000, (0,)).isEmpty()
