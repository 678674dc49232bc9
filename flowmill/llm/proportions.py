"""A sample whose category shares match targets, and where they cannot.

1. *Rake.* Rows are counted per cell (combination of categories; few, checked
   against ``max_cells``), and iterative proportional fitting over all margins
   gives each cell a weight. The first margin is fitted last, so it is met
   whatever the others ask for.
2. *Draw.* Every row gets the exponential key ``-ln(u) / weight``, ``u`` being a
   hash of its own key, and one threshold over all rows draws the sample.
3. *Repair.* Where the draw leaves a class of the first margin below its whole
   quota (its share, at least its minimum, at most its rows), the rows with the
   next larger keys are added; where it is above, those with the largest keys
   leave. So the sample holds each class's ``quota`` smallest keys.
4. *Report.* Gaps of the draw and of the repaired sample; a class is short where
   the repair used up all its rows and its target or minimum is not reached.

Rows are never gathered: they are counted per cell, counted per (class, bucket
of the key), and filtered by their class's cut, where only the rows of the one
bucket the cut falls into (1 / ``BUCKETS`` of a class) are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8192


@dataclass(frozen=True)
class Margin:
    """Target shares of one category column of the cells; None: those the table has."""

    column: str
    shares: dict | None


def rake(counts: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Cell totals after proportional fitting of ``counts`` to each margin.

    ``codes[m][i]`` is cell ``i``'s category in margin ``m`` and ``targets[m]``
    that margin's wanted totals. Categories without rows stay at 0; the shares
    of the others are then met as far as the margins allow.
    """
    fitted = counts.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weights=fitted, minlength=len(target))
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            worst = max(worst, float(np.max(np.abs(np.where(have > 0, factor - 1, 0)), initial=0.0)))
            fitted = fitted * factor[code]
        if worst < tol:
            break
    return fitted


def whole_quotas(wanted: np.ndarray, available: np.ndarray, least: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers near ``wanted``, at least ``least``, at most ``available``,
    adding up to ``total`` where that can be had.

    Largest remainders first. Rows a short category cannot give are spread over
    the others in proportion; minimums are paid for by categories above theirs,
    by short ones only if no other is left.
    """
    low = np.minimum(least, available)
    quota = np.clip(np.floor(wanted + 1e-9).astype(np.int64), low, available)
    while (gap := total - int(quota.sum())) != 0:
        room = available - quota if gap > 0 else quota - low
        if gap < 0 and (spare := np.where(wanted > available, 0, room)).sum() > 0:
            room = spare
        if room.sum() == 0:
            break
        share = np.where(room > 0, np.maximum(wanted, 1e-9), 0.0)
        step = np.minimum(np.floor(abs(gap) * share / share.sum()).astype(np.int64), room)
        if step.sum() == 0:  # hand out single rows, most underfilled (overfilled) first
            lag = (wanted - quota) if gap > 0 else (quota - wanted)
            order = [i for i in np.lexsort((np.arange(len(lag)), -lag)) if room[i] > 0][: abs(gap)]
            step[order] = 1
        quota = quota + step if gap > 0 else quota - step
    return quota


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by key and seed, the same on any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)


def bounded(df: DataFrame, limit: int, what: str) -> list:
    """The rows of ``df``; raises if there are more than ``limit``."""
    out = df.limit(limit + 1).collect()
    if len(out) > limit:
        raise ValueError(f"more than {limit} {what}")
    return out


@dataclass
class Plan:
    """What was decided; everything is per cell or per class, nothing per row."""

    total: int
    column: str
    cells: list[dict]
    #: class -> available, wanted, weight (mean), least, quota, cut (bucket), rest (rows of the cut's bucket)
    classes: dict = field(default_factory=dict)
    threshold: float = 0.0


def proportional_plan(
    df: DataFrame, cells: dict[str, Column], key: Column, margins: list[Margin], minimums: dict, share: float, seed: int = 17, max_cells: int = 256
) -> tuple[DataFrame, Plan]:
    """Rows with their keys, and the plan for them.

    ``cells`` names the category columns; rows with a null category are not
    usable and left out. The sample has ``floor(share * usable rows)`` rows.
    The first margin's column carries ``minimums``. ``key`` should be unique.
    """
    names = list(cells)
    # the row travels as one struct, so its own column names cannot clash
    rows = df.select(F.struct("*").alias("_row"), F.struct(*[c.alias(n) for n, c in cells.items()]).alias("_cell"), uniform(key, seed).alias("_u"), key.alias("_key"))
    rows = rows.filter(" AND ".join(f"_cell.`{n}` IS NOT NULL" for n in names))
    found = bounded(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")), max_cells, "cells of categories")
    counts = np.array([r["n"] for r in found], dtype=np.int64)
    total = int(np.floor(counts.sum() * share + 1e-9))
    codes, targets = [], []
    for m in reversed(margins):  # the first one is fitted last
        values = sorted({r["_cell"][m.column] for r in found} | set(m.shares or ()), key=str)
        at = {v: i for i, v in enumerate(values)}
        codes.append(np.array([at[r["_cell"][m.column]] for r in found], dtype=np.int64))
        shares = m.shares if m.shares is not None else {v: counts[codes[-1] == i].sum() / max(counts.sum(), 1) for v, i in at.items()}
        targets.append(np.array([shares.get(v, 0.0) * total for v in values]))
    fitted = rake(counts, codes, targets) if len(found) else counts.astype(float)
    weight = np.divide(fitted, counts, out=np.zeros(len(found)), where=counts > 0)
    first = margins[0].column
    plan = Plan(total, first, [{"cell": r["_cell"].asDict(), "available": int(counts[i]), "weight": float(weight[i]), "fitted": float(fitted[i])} for i, r in enumerate(found)])
    values = sorted({c["cell"][first] for c in plan.cells}, key=str)
    available, wanted = (np.array([sum(c[k] for c in plan.cells if c["cell"][first] == v) for v in values]) for k in ("available", "fitted"))
    least = np.array([minimums.get(v) or 0 for v in values], dtype=np.int64)
    # a class without a target is drawn for its minimum only
    quota = whole_quotas(wanted, np.where(wanted > 0, available, np.minimum(least, available)), least, total) if values else available
    for i, v in enumerate(values):
        plan.classes[v] = {"available": int(available[i]), "wanted": float(wanted[i]), "weight": float(wanted[i] / available[i]), "least": int(least[i]), "quota": int(quota[i])}
    rows = _keyed(rows, plan, names)
    _cut(rows, plan)
    return rows, plan


def _keyed(rows: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """``_x``, the exponential key at the class's mean weight 1 (so that a class's
    keys spread evenly over the buckets whatever its weight), and ``_bucket``.
    ``_x / weight of the class`` is the key all rows are compared by."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema["_cell"].dataType.fields}
    schema = ", ".join([*(f"`c_{n}` {types[n]}" for n in names), "_class_weight double", "_relative double"])
    of = lambda c: plan.classes[c["cell"][plan.column]]["weight"]
    relative = lambda c: max(c["weight"] / of(c), 1e-9) if of(c) > 0 else 1.0
    # one row per cell, at most max_cells: the broadcast is bounded
    table = F.broadcast(rows.sparkSession.createDataFrame([(*[c["cell"][n] for n in names], of(c), relative(c)) for c in plan.cells], schema))
    joined = rows.join(table, [F.col(f"_cell.{n}") == F.col(f"c_{n}") for n in names]).withColumn("_x", -F.ln("_u") / F.col("_relative"))
    return joined.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_x"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def _cut(rows: DataFrame, plan: Plan) -> None:
    """The threshold of the draw and each class's cut, from counts per (class,
    bucket): at most classes * BUCKETS rows reach the driver."""
    counted = rows.groupBy(F.col(f"_cell.`{plan.column}`").alias("c"), "_bucket").agg(F.count(F.lit(1)).alias("n"))
    held = {v: np.zeros(BUCKETS, dtype=np.int64) for v in plan.classes}
    for r in counted.collect():
        held[r["c"]][r["_bucket"]] = r["n"]
    for v, c in plan.classes.items():
        upto = np.cumsum(held[v])
        c["cut"] = int(np.searchsorted(upto, c["quota"])) if c["quota"] else -1
        c["rest"] = int(c["quota"] - (upto[c["cut"]] - held[v][c["cut"]])) if c["quota"] else 0

    def below(t: float) -> float:
        edge = {v: (1 - np.exp(-c["weight"] * t)) * BUCKETS for v, c in plan.classes.items()}
        return sum(float((n * np.clip(edge[v] - np.arange(BUCKETS), 0, 1)).sum()) for v, n in held.items())

    drawable = sum(c["available"] for c in plan.classes.values() if c["weight"] > 0)
    lo, hi = 0.0, 1.0
    while drawable and below(hi) < min(plan.total, drawable * (1 - 1e-9)) and hi < 1e12:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < plan.total else (lo, mid)
    plan.threshold = hi if drawable and plan.total else 0.0


def draw_counts(rows: DataFrame, plan: Plan) -> dict:
    """class -> rows whose key is within the threshold: the draw before its repair."""
    drawn = rows.filter(F.col("_x") <= F.col("_class_weight") * F.lit(plan.threshold))
    return {r["c"]: r["n"] for r in drawn.groupBy(F.col(f"_cell.`{plan.column}`").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class


def proportional_sample(rows: DataFrame, plan: Plan) -> DataFrame:
    """The repaired sample: in each class the ``quota`` smallest exponential keys.
    Whole buckets below the cut pass through; only the bucket of the cut is
    ranked. Ties fall to the smaller key. Output: the columns of the sampled table."""
    kind = rows.schema["_cell"].dataType[plan.column].dataType.simpleString()
    cuts = [(v, c["cut"], c["rest"]) for v, c in plan.classes.items() if c["quota"] > 0]
    # one row per class, at most max_cells: the broadcast is bounded
    table = F.broadcast(rows.sparkSession.createDataFrame(cuts, f"_class {kind}, _cut int, _rest bigint"))
    joined = rows.join(table, F.col(f"_cell.`{plan.column}`") == F.col("_class")).filter("_bucket <= _cut")
    whole = joined.filter("_bucket < _cut")
    w = Window.partitionBy("_class").orderBy("_x", "_key")
    edge = joined.filter("_bucket = _cut").withColumn("_rank", F.row_number().over(w)).filter("_rank <= _rest").drop("_rank")
    return whole.unionByName(edge).select("_row.*")


def gap_report(plan: Plan, drawn: dict, targets: list[tuple]) -> list[tuple]:
    """Per target ``(value, share, minimum)``: available, drawn, taken and the
    residual gaps ``(value, share, minimum, available, wanted, drawn, taken,
    actual share, gap, short of share, short of minimum)``. A class is short if
    all its rows are taken and still do not reach the target, or the minimum."""
    size = sum(c["quota"] for c in plan.classes.values())
    out = []
    for value, share, least in targets:
        c = plan.classes.get(value, {"available": 0, "quota": 0})
        available, taken, wanted = c["available"], c["quota"], share * plan.total
        actual = taken / size if size else 0.0
        used_up = taken == available
        out.append((value, share, least, available, wanted, drawn.get(value, 0), taken, actual, actual - share, used_up and taken < wanted, used_up and taken < least))
    return out
