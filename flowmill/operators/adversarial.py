"""Attacks on a flow detector, as table transformations with a budget column.

Randomness is a hash of keys, so a sweep is one plan over (row, budget) and the
same on every run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.functions.mathx import probit
from flowmill.operators import prototypes
from flowmill.operators.clean import feasible
from flowmill.operators.features import FeaturePipeline
from flowmill.operators.ranking import ranked, uniform
from flowmill.plans.shared import materialise

BUDGETS = (0, 1, 2, 4, 8, 16, 32, 64)
SIGMAS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)
_DURATIONS = ("FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT")
#: A pool of at most so many edges is broadcast, as arrays of 4096 values (32 MB of 8 bytes each); a larger one is joined by a shuffle.
PACKED_POOL, PACKED_BITS = 4_000_000, 12


def hashed_uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return uniform(*parts, seed=seed)


def inject_edges(targets: DataFrame, pool: DataFrame, window_ms: int, budgets: tuple = BUDGETS, spread: str = "all_strata", strata: int = 4, seed: int = 0) -> DataFrame:
    """Benign-looking edges placed before each target, for every budget.

    ``targets``: ``flow_id, ms, src, dst``; ``pool``: edges to copy ``bytes``
    from. Output: ``target_id, budget, i, ms, src, dst, bytes, is_injected``.
    Injected edges are context only, never targets. A budget of 0 injects
    nothing. ``single_stratum`` puts all into the latest stratum, ``all_strata``
    spreads them evenly. The pool is drawn by rank (a hash decides), once per
    target and ``i`` for all budgets: targets are dealt out before they are
    multiplied, and a pool of up to ``PACKED_POOL`` edges comes to them as packed
    values; a larger one is met by a shuffle. The multiplied side is never
    broadcast (the planner takes it to be as small as ``targets``).
    """
    if spread not in ("single_stratum", "all_strata"):
        raise ValueError(f"unknown spread {spread!r}")
    n = pool.count()
    if not n:
        raise ValueError("the pool of benign edges is empty")
    wanted = [b for b in budgets if b > 0]
    # twice the usual slices: as many as those of a join before, the planner would leave them out and merge the join's, which it takes to be small
    parts = 2 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = targets.filter(F.lit(bool(wanted))).select(F.col("flow_id").alias("target_id"), F.col("ms").alias("at"), "src", "dst").repartition(parts, "target_id")
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(wanted, default=1) - 1))))
    pick = F.least(F.floor(hashed_uniform(F.col("i"), F.col("target_id"), seed=seed + 1) * n).cast("bigint"), F.lit(n - 1))
    each = each.withColumn("_pick", pick)  # not nullable, nor is its block: else a filter on the join's keys would draw again
    numbered = ranked(pool.select("flow_id", "bytes").withColumn("_all", F.lit(0)), ["_all"], [F.col("flow_id")]).select((F.col("rank") - 1).alias("_pick"), "bytes")
    if n <= PACKED_POOL:
        block = F.shiftright("_pick", PACKED_BITS)
        packed = numbered.groupBy(block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_pick", "bytes"))).getField("bytes").alias("_bytes"))
        drawn = each.withColumn("_block", block).join(F.broadcast(packed), "_block").withColumn("bytes", F.get("_bytes", F.col("_pick").bitwiseAND(F.lit((1 << PACKED_BITS) - 1)).cast("int")))
    else:
        drawn = each.join(numbered.hint("merge"), "_pick")
    drawn = drawn.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in wanted or [1]]))).filter("i < budget")
    u = hashed_uniform(F.col("target_id"), F.col("budget"), F.col("i"), seed=seed)
    width = F.lit(window_ms / strata)
    stratum = F.lit(strata - 1) if spread == "single_stratum" else F.pmod(F.col("i"), F.lit(strata))
    begin = F.col("at") - F.lit(window_ms) + stratum * width
    ms = F.least(F.floor(begin + u * width).cast("bigint"), F.col("at") - 1)
    return drawn.select("target_id", "budget", "i", ms.alias("ms"), "src", "dst", "bytes", F.lit(True).alias("is_injected"))


def with_injected(edges: DataFrame, injected: DataFrame) -> DataFrame:
    """Edges and injected edges together (``is_injected`` tells them apart)."""
    own = edges.select("ms", "src", "dst", "bytes", F.lit(False).alias("is_injected"))
    return own.unionByName(injected.select("ms", "src", "dst", "bytes", "is_injected"))


def jitter(df: DataFrame, key: str, sigmas: tuple = SIGMAS, seed: int = 0) -> DataFrame:
    """Flows under log-normal jitter of their gaps, for every sigma: ``sigma``,
    ``factor`` (mean over directions), the jittered columns made feasible, and
    the cost ``duration_change`` and ``rate_change``. Sigma 0 changes nothing."""
    each = df.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    f = {}
    for i, d in enumerate(("SRC_TO_DST_IAT", "DST_TO_SRC_IAT")):
        if f"{d}_AVG" in df.columns:
            u = hashed_uniform(F.col(key), F.lit(i), seed=seed) * (1 - 1e-12) + 5e-13  # inside (0, 1)
            f[d] = F.exp(probit(u) * F.col("sigma"))
    for i, (d, c) in enumerate(f.items()):
        each = each.withColumn(f"_f{i}", c).withColumns({f"{d}_{s}": F.col(f"{d}_{s}") * F.col(f"_f{i}") for s in ("MIN", "AVG", "MAX", "STDDEV") if f"{d}_{s}" in df.columns})
    factor = sum((F.col(f"_f{i}") for i in range(1, len(f))), F.col("_f0")) / len(f) if f else F.lit(1.0)
    each = each.withColumn("factor", factor).withColumns({c: F.col(c) * F.col("factor") for c in _DURATIONS if c in df.columns})
    moved = feasible(each.drop(*[f"_f{i}" for i in range(len(f))]))
    return moved.withColumn("duration_change", F.col("factor") - 1).withColumn("rate_change", 1 / F.col("factor") - 1)


def perturb(df: DataFrame, key: str, columns: list[str], epsilons: tuple, sign_seed: int = 0) -> DataFrame:
    """Flows moved to a corner of the relative box of each epsilon, by hashed
    signs, then made feasible: the proposals of a sign-gradient attack."""
    each = df.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    moved = {c: F.col(c).cast("double") * (1 + F.col("epsilon") * F.when(hashed_uniform(F.col(key), F.lit(i), seed=sign_seed) < 0.5, -1.0).otherwise(1.0)) for i, c in enumerate(columns)}
    return feasible(each.withColumns(moved))


def spsa_attack(df: DataFrame, vector: str, direction: list[float], epsilon: float, steps: int = 20, seed: int = 0) -> DataFrame:
    """``attacked``: each vector moved within ``epsilon`` of itself (relative,
    per entry) so that its product with ``direction`` grows, by simultaneous
    random perturbation (two evaluations a step). Runs on Arrow batches: a row
    is attacked alone, so there is no shuffle."""
    d = np.array(direction, dtype=float)

    def run(v: pd.Series) -> pd.Series:
        x0 = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        lo, hi = x0 - epsilon * np.abs(x0), x0 + epsilon * np.abs(x0)
        x, rng = x0.copy(), np.random.default_rng(seed)
        for _ in range(steps if epsilon > 0 else 0):
            delta = rng.choice([-1.0, 1.0], size=x.shape[1])
            up, down = np.clip(x + 0.1 * np.abs(x) * delta, lo, hi), np.clip(x - 0.1 * np.abs(x) * delta, lo, hi)
            gain = (up - down) @ d
            x = np.clip(x + np.sign(gain)[:, None] * epsilon * 0.15 * np.abs(x0) * delta, lo, hi)
        return pd.Series(list(x))

    attack = F.pandas_udf(run, "array<double>")
    return df.withColumn("attacked", attack(F.transform(F.col(vector), lambda y: y.cast("double"))))


def poison_drift(bank: DataFrame, poison: list[float], rate: float, momentum: float = 0.99, steps: int = 200, gate: float | None = None, seed: int = 0, margin: float = 0.2, tau: float = 0.1) -> DataFrame:
    """Per class: how far its first prototype moves under ``steps`` slow updates
    of which a share ``rate`` carries ``poison``, which is accepted only if its
    evidence reaches ``gate`` (None: no gate). A fold over the steps, in one
    expression. Output: ``class_id, drift, accepted, attempted``."""
    p = F.lit([float(x) for x in poison])
    z = vec.unit(p)
    accept = lambda cur: F.lit(True) if gate is None else F.exp((vec.dot(z, cur) - 1 + margin) / tau) >= gate

    def step(s, i):
        tried = uniform(i, seed=seed) < rate
        ok = tried & accept(s["v"])
        moved = vec.unit(F.zip_with(s["v"], z, lambda a, b: a * momentum + b * (1 - momentum)))
        return F.struct(F.when(ok, moved).otherwise(s["v"]).alias("v"), (s["a"] + ok.cast("int")).alias("a"), (s["t"] + tried.cast("int")).alias("t"))

    first = bank.filter("sub_id = 0")
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("proto").alias("v"), F.lit(0).alias("a"), F.lit(0).alias("t")), step)
    r = first.withColumn("_r", run)
    far = F.sqrt(vec.total(F.zip_with(F.col("_r.v"), F.col("proto"), lambda a, b: (a - b) * (a - b))))
    return r.select("class_id", far.alias("drift"), F.col("_r.a").alias("accepted"), F.col("_r.t").alias("attempted"))


def evasion_summary(df: DataFrame, groups: list[str], evaded: Column) -> DataFrame:
    """Attack success rate per group."""
    return df.groupBy(*groups).agg(F.avg(evaded.cast("double")).alias("asr"), F.count(F.lit(1)).alias("n"))


def breakdown_budget(summary: DataFrame, groups: list[str], budget: str, rate: str = "asr", at: float = 0.5) -> DataFrame:
    """The smallest budget at which the success rate reaches ``at`` (null if none)."""
    return summary.groupBy(*groups).agg(F.min(F.when(F.col(rate) >= at, F.col(budget))).alias("breakdown"))


# --- attacks on raw flows: re-transformed, scored and judged anew ----------------


@dataclass
class Judge:
    """A fitted detector of raw flows: features, a prototype bank and thresholds."""

    pipeline: FeaturePipeline
    bank: DataFrame
    margin: float = 0.2
    tau: float = 0.1
    theta_unknown: float = 0.5
    theta_defer: float = 0.1

    def vectors(self, raw: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``z``: all features anew from the raw columns, so descriptors
        that follow from a changed column change with it."""
        names = list(self.pipeline.columns())
        return self.pipeline.transform(raw, keep).select(*keep, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("z"))

    def verdicts(self, raw: DataFrame, keep: list[str]) -> DataFrame:
        z = materialise(self.vectors(raw, keep), "judged")  # so that scoring does not inline the features
        return prototypes.decide(prototypes.evidence(prototypes.cosines(z, self.bank, "z"), self.margin, self.tau), self.theta_unknown, self.theta_defer)


def evade(benign: int) -> Column:
    """The objective of passing as benign: its cosine less the best other one."""
    named = F.arrays_zip("classes", "cos")
    best = lambda keep: F.array_max(F.transform(F.filter(named, keep), lambda t: t["cos"]))
    return best(lambda t: t["classes"] == benign) - best(lambda t: t["classes"] != benign)


def avoid_unknown() -> Column:
    """The objective of not being held for unknown: all evidence."""
    return F.col("evidence_total")


def search_attack(raw: DataFrame, key: str, columns: list[str], epsilon: float, judge: Judge, goal: Callable[[], Column] | Column, rounds: int = 3, candidates: int = 8, seed: int = 0) -> DataFrame:
    """``key, score_before, decision_before, score, decision`` and the attacked
    ``columns``: each flow moved inside the box of relative width ``epsilon``
    around itself towards a larger ``goal``, and always onto the feasible set.

    Rounds of simultaneous random perturbation: every round proposes
    ``candidates`` sign patterns at half the last step, all flows are
    transformed and judged as one table, and each keeps its best proposal (its
    own place is one of them, so the score never falls). A flow's proposals are
    a fixed number, so nothing grows but by the input; lineage is cut per round.
    """
    goal = goal() if callable(goal) else goal
    origin = {c: F.col(f"_o_{c}") for c in columns}
    begin = raw.select(key, *[F.col(c).cast("double").alias(f"_o_{c}") for c in columns])
    state, rest = raw, [c for c in raw.columns if c != key]  # making a proposal feasible may move any column, so all are kept

    def judged(df: DataFrame) -> DataFrame:
        return judge.verdicts(df, ["_cand_row"]).select("_cand_row.*", goal.alias("score"), "decision")

    for r in range(rounds):
        step = epsilon * 0.5**r
        c = F.col("_cand")
        each = state.join(begin, key).withColumn("_cand", F.explode(F.sequence(F.lit(0), F.lit(candidates if epsilon > 0 else 0))))
        moved = {}
        for i, n in enumerate(columns):
            sign = F.when(uniform(F.col(key), c, i, r, seed=seed) < 0.5, -1.0).otherwise(1.0)
            inside = F.greatest(F.least(F.col(n) + step * F.abs(origin[n]) * sign, origin[n] + epsilon * F.abs(origin[n])), origin[n] - epsilon * F.abs(origin[n]))
            moved[n] = F.when(c == 0, F.col(n).cast("double")).otherwise(inside)
        proposals = each.withColumns(moved)
        # the flow's own place is not moved onto the feasible set: it is what was seen
        proposals = feasible(proposals.filter(c > 0)).unionByName(proposals.filter(c == 0), allowMissingColumns=True) if epsilon > 0 else proposals
        # written first: inlined into 150 features, the rules would be computed over and over
        proposals = materialise(proposals.select(key, "_cand", *rest), "proposals").withColumn("_cand_row", F.struct(key, "_cand", *rest))
        scored = judged(proposals)
        best = scored.groupBy(key).agg(
            F.max_by(F.struct("score", "decision", *rest), F.struct("score", -F.col("_cand"))).alias("b"),
            *([F.max(F.when(F.col("_cand") == 0, F.struct("score", "decision"))).alias("_first")] if r == 0 else []),
        )
        first = [F.col("_first.score").alias("score_before"), F.col("_first.decision").alias("decision_before")] if r == 0 else []
        best = materialise(best.select(key, *first, "b.*"), "attack")
        if r == 0:
            begun = best.select(key, "score_before", "decision_before")
        state = best.select(key, *rest)
    return begun.join(best.select(key, "score", "decision", *columns), key)


def injection_shift(lists: DataFrame, injected: DataFrame, beta: float = 0.2) -> DataFrame:
    """``target_id, budget, mean_shift, trimmed_shift``: how far the plain and the
    trimmed mean of a target's neighbour list move when edges are injected.

    ``lists``: ``target_id, flow_id, value`` (capped lists); ``injected``:
    ``target_id, budget, i, value``. Folds and joins only; a list and its
    injections are bounded by the cap and the budget.
    """
    from flowmill.operators.robust import trimmed_mean

    budgets = injected.select("target_id", "budget").distinct()
    own = lists.select("target_id", "flow_id", "value")
    both = own.join(budgets, "target_id").select("target_id", "budget", "flow_id", "value").unionByName(injected.select("target_id", "budget", (-1 - F.col("i")).cast("bigint").alias("flow_id"), "value"))
    one = lambda df, by: (df.groupBy(*by).agg(F.avg("value").alias("mean")), trimmed_mean(df.withColumn("weight", F.lit(1.0)), by, beta).withColumnRenamed("agg", "trimmed"))
    (m0, t0), (m1, t1) = one(own, ["target_id"]), one(both, ["target_id", "budget"])
    clean = m0.join(t0, "target_id").withColumnsRenamed({"mean": "_m", "trimmed": "_t"})
    return m1.join(t1, ["target_id", "budget"]).join(clean, "target_id").select("target_id", "budget", F.abs(F.col("mean") - F.col("_m")).alias("mean_shift"), F.abs(F.col("trimmed") - F.col("_t")).alias("trimmed_shift"))
