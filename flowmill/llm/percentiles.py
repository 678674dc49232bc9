"""Percentiles per group of columns too large to sort.

**Exact bisection.** Per (group, field, percentile) an interval of values is
kept that holds the wanted rank. Each pass splits every open interval into
``sections`` parts, counts the rows below each midpoint (as counts per part,
folded on the map side), and narrows the interval to the smallest and largest
value of the part that holds the rank. An interval with one distinct value is
resolved. Parts are cut evenly, on a log scale while an interval spans orders
of magnitude; any monotone cut gives the same exact result. With 1024 parts a
pass resolves ten bits, so billions of rows take 4 to 6 passes, and from the
second on only rows inside open intervals are kept (written once to the shared
folder), a few thousandths of the input.

**Mergeable states.** ``value_states`` folds any part of the data (a day, a
file) to counts, minima and maxima per cell of a fixed log grid. States of
separate parts are combined by adding (``merge_states``), and bisection over
their cumulative counts (``percentiles_of_states``) gives a percentile with its
bounds; the relative error is at most ``2 ** (1 / cells_per_octave) - 1``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.plans.shared import broadcast_if_small, materialise

SECTIONS = 1024
#: Intervals above this many rows are joined by a shuffle instead of a broadcast.
BROADCAST_INTERVALS = 100_000
CELLS_PER_OCTAVE = 32


def long_values(df: DataFrame, group: Column, fields: dict[str, Column]) -> DataFrame:
    """``grp, field, x``: one row per row and field with a group and a usable
    value (finite and not negative; null, NaN and negative values are left aside)."""
    each = df.select(group.alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), c.cast("double").alias("x")) for n, c in fields.items()
    ])).alias("v")).select("grp", "v.field", "v.x")
    return each.filter("grp IS NOT NULL AND x >= 0").filter(~F.isnan("x") & (F.col("x") < float("inf")))


def _ranks(percentiles: list[float]) -> Column:
    """Per percentile its 1-based rank: the smallest k with k >= p * n."""
    return F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("n")), F.lit(1)).cast("bigint").alias("rank")) for p in percentiles]))


def _section(x: Column, lo: Column, hi: Column, sections: int) -> Column:
    """The part of [lo, hi] that ``x`` falls into; not decreasing in ``x``."""
    linear = (x - lo) / (hi - lo)
    log = (F.log1p(x) - F.log1p(lo)) / (F.log1p(hi) - F.log1p(lo))
    at = F.floor(F.when(hi > 4 * (lo + 1), log).otherwise(linear) * sections)
    return F.least(F.greatest(at, F.lit(0)), F.lit(sections - 1)).cast("int")


def _inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Values with the interval they lie in (intervals of a group are disjoint)."""
    bounds = broadcast_if_small(intervals.select("grp", "field", "lo", "hi"), BROADCAST_INTERVALS)
    return values.join(bounds, ["grp", "field"]).filter("x >= lo AND x <= hi")


def _narrow(values: DataFrame, intervals: DataFrame, sections: int) -> DataFrame:
    """One pass: intervals (grp, field, lo, hi, ranks) to narrower ones per rank.

    Percentiles that share an interval share its counts. ``ranks`` holds
    (p, rank inside the interval).
    """
    inside = _inside(values, intervals).withColumn("part", _section(F.col("x"), F.col("lo"), F.col("hi"), sections))
    parts = inside.groupBy("grp", "field", "lo", "hi", "part").agg(F.sum("w").alias("c"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    below = F.sum("c").over(Window.partitionBy("grp", "field", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    cumulated = parts.withColumn("upto", below)
    asked = intervals.select("grp", "field", "lo", "hi", F.explode("ranks").alias("r"))
    hit = asked.join(cumulated, ["grp", "field", "lo", "hi"]).filter("r.rank <= upto AND r.rank > upto - c")
    return hit.groupBy("grp", "field", F.col("min_x").alias("lo"), F.col("max_x").alias("hi")).agg(
        F.collect_list(F.struct(F.col("r.p").alias("p"), (F.col("r.rank") - F.col("upto") + F.col("c")).alias("rank"))).alias("ranks")
    )


def exact_percentiles(df: DataFrame, group: Column, fields: dict[str, Column], percentiles: list[float], sections: int = SECTIONS) -> DataFrame:
    """``grp, field, p, value, n, passes``: exact order statistics.

    ``value`` is the element of rank ``max(1, ceil(p * n))`` of the group's
    usable values, ``n`` their number, ``passes`` the passes over rows it took.
    Groups without usable values do not appear; an empty table gives no row.
    Ties and repeated rows count as they stand. Nothing is collected but the
    number of open intervals.
    """
    source = long_values(df, group, fields).withColumn("w", F.lit(1).cast("bigint"))
    sizes = materialise(source.groupBy("grp", "field").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "p5-sizes")
    ranked = sizes.select("grp", "field", "lo", "hi", _ranks(percentiles).alias("r"))
    state = ranked.groupBy("grp", "field", "lo", "hi").agg(F.collect_list("r").alias("ranks")).withColumn("passes", F.lit(1))
    done, open_ = state.filter("lo = hi"), state.filter("lo < hi").drop("passes")
    turn = 1
    while not open_.isEmpty():
        turn += 1  # every pass narrows every open interval, so this ends
        step = materialise(_narrow(source, open_, sections).withColumn("passes", F.lit(turn)), "p5-intervals")
        done = done.unionByName(step.filter("lo = hi"))
        open_ = step.filter("lo < hi").drop("passes")
        if turn == 2:  # from here on only the rows inside open intervals count, equal ones folded
            source = materialise(_inside(source, open_).groupBy("grp", "field", "x").agg(F.sum("w").alias("w")), "p5-rows")
    return _result(done, sizes)


def value_states(df: DataFrame, part: Column, group: Column, fields: dict[str, Column]) -> DataFrame:
    """``part, grp, field, cell, n, min_x, max_x``: the mergeable state of each part.

    A cell holds values whose ``log2(1 + x)`` agrees to 1 / CELLS_PER_OCTAVE, so
    a state has at most a few thousand rows, however many rows it stands for.
    Rows whose part is null form a part of their own (null).
    """
    cell = F.floor(F.ln(1 + F.col("x")) / math.log(2) * CELLS_PER_OCTAVE).cast("int")
    tagged = df.select(F.struct(part.alias("part"), group.alias("grp")).alias("_g"), *[c.alias(f"_x{i}") for i, c in enumerate(fields.values())])
    values = long_values(tagged, F.when(F.col("_g.grp").isNotNull(), F.col("_g")), {n: F.col(f"_x{i}") for i, n in enumerate(fields)})
    return values.groupBy(F.col("grp.part").alias("part"), F.col("grp.grp").alias("grp"), "field", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x")
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of any parts combined: ``grp, field, cell, n, min_x, max_x``."""
    return states.groupBy("grp", "field", "cell").agg(F.sum("n").alias("n"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))


def percentiles_of_states(states: DataFrame, percentiles: list[float]) -> DataFrame:
    """``grp, field, p, low, high, n`` from merged states alone: the element of
    rank ``max(1, ceil(p * n))`` lies in [low, high], the values seen in its cell.
    Windows run over cells, not rows: a few thousand per group."""
    w = Window.partitionBy("grp", "field")
    upto = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = states.withColumn("upto", upto).withColumn("total", F.sum("n").over(w)).withColumnRenamed("n", "c").withColumnRenamed("total", "n")
    asked = cells.select("*", _ranks(percentiles).alias("r")).filter("r.rank <= upto AND r.rank > upto - c")
    return asked.select("grp", "field", F.col("r.p").alias("p"), F.col("min_x").alias("low"), F.col("max_x").alias("high"), "n")


def _result(done: DataFrame, sizes: DataFrame) -> DataFrame:
    resolved = done.select("grp", "field", F.explode("ranks").alias("r"), F.col("lo").alias("value"), "passes")
    n = broadcast_if_small(sizes.select("grp", "field", "n"), BROADCAST_INTERVALS)
    return resolved.join(n, ["grp", "field"]).select("grp", "field", F.col("r.p").alias("p"), "value", "n", "passes")
