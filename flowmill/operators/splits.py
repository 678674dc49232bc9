"""Splits, thinning, holdouts and the audits that catch leakage.

Per-class temporal cuts use :func:`flowmill.operators.ranking.ranked`, so a
class that holds most rows is never gathered into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ranking import hash_order, mixed, ranked, uniform
from flowmill.plans.shared import materialise

UNKNOWN = "UNKNOWN"


def temporal_split(df: DataFrame, label: str, time: str, key: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Protocol A: ``df`` with ``split``; per class the earliest 70 % train, the
    next 15 % val, the rest test (bounds rounded down; ties in time by key)."""
    r = ranked(df, [label], [F.col(time), F.col(key)])
    n = F.col("group_rows")
    a, b = F.floor(n * F.lit(shares[0])), F.floor(n * F.lit(shares[0] + shares[1]))
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").otherwise("test")
    return r.withColumn("split", split).drop("rank", "group_rows")


def leave_classes_out(split: DataFrame, label: str, held: list[str]) -> DataFrame:
    """Protocol B: held classes leave train and val and are UNKNOWN in test."""
    out = F.coalesce(F.col(label).isin(held), F.lit(False))
    return split.filter(~out | (F.col("split") == "test")).withColumn("target", F.when(out, UNKNOWN).otherwise(F.col(label)))


def leave_member_out(split: DataFrame, label: str, family: str, held: str) -> DataFrame:
    """Protocol B2: one member of a family is held out, its siblings stay known."""
    return leave_classes_out(split, label, [held]).withColumn("sibling", F.coalesce((F.col(family) == F.lit(held)) & (F.col(label) != F.lit(held)), F.lit(False)))


def holdout_sets(classes: list[str], size: int, repeats: int, seed: int = 0) -> list[tuple[str, ...]]:
    """Distinct subsets of ``size`` classes, at most ``repeats``, by a seeded
    order of all subsets. Works on class names only."""
    if size > len(classes):
        raise ValueError("the holdout is larger than the set of classes")
    rng = _lcg(seed)
    out: dict[tuple[str, ...], None] = {}
    most = math.comb(len(classes), size)
    names = sorted(classes)
    while len(out) < min(repeats, most):
        pool = list(names)
        out[tuple(sorted(pool.pop(next(rng) % len(pool)) for _ in range(size)))] = None
    return list(out)


def _lcg(seed: int):
    x = seed * 2_654_435_761 + 1
    while True:
        x = (x * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % (1 << 64)
        yield x >> 33


def host_disjoint(df: DataFrame, host: str, key: str, seed: int = 3, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Protocol D: all rows of a source host in one split, by a hash of the host.
    No shuffle: the split is a column."""
    u = uniform(F.col(host), seed=seed)
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))


def cross_dataset(tables: dict[str, DataFrame], source: str, target: str, columns: list[str]) -> DataFrame:
    """Protocol C: train on one dataset, test on another, on shared columns."""
    pick = lambda n, s: tables[n].select(*columns, F.lit(n).alias("dataset"), F.lit(s).alias("split"))
    return pick(source, "train").unionByName(pick(target, "test"))


def temporal_quota(df: DataFrame, label: str, time: str, key: str, quotas: dict[str, int], bins: int = 100, seed: int = 1) -> DataFrame:
    """Thins majority classes evenly over time: the class is cut into ``bins``
    runs of equal count, and each gives ``ceil(quota / bins)`` rows at most, in
    hash order. Classes without a quota are kept whole."""
    r = ranked(df, [label], [F.col(time), F.col(key)])
    quota = F.lit(None).cast("bigint")
    for k, q in quotas.items():
        quota = F.when(F.col(label) == k, F.lit(q)).otherwise(quota)
    binned = r.withColumn("_bin", F.floor((F.col("rank") - 1) * F.lit(bins) / F.col("group_rows"))).withColumn("_quota", quota).withColumn("_h", hash_order(key, seed))
    whole, thin = binned.filter("_quota IS NULL"), binned.filter("_quota IS NOT NULL")
    # ranks in a bin: a bin is 1 / bins of a class, and ranked() splits it further
    kept = ranked(thin.drop("rank", "group_rows"), [label, "_bin"], [F.col("_h"), F.col(key)]).filter(F.col("rank") <= F.ceil(F.col("_quota") / F.lit(bins)))
    return whole.select(df.columns).unionByName(kept.select(df.columns))


def head_quota(df: DataFrame, label: str, time: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """Thins by taking the earliest ``quota`` rows of each class that has one."""
    r = ranked(df, [label], [F.col(time), F.col(key)])
    keep = F.lit(True)
    for k, q in quotas.items():
        keep = F.when(F.col(label) == k, F.col("rank") <= q).otherwise(keep)
    return r.filter(keep).select(df.columns)


def plan_quotas(counts: dict[str, int], total: int, minority: int, benign: str, benign_floor: float = 0.5) -> dict[str, int]:
    """Quotas of the majority classes: minorities stay whole, the benign class
    gets at least ``benign_floor`` of the target, the rest is shared by size."""
    small = sum(n for n in counts.values() if n < minority)
    large = {c: n for c, n in counts.items() if n >= minority}
    if sum(counts.values()) <= total or not large:
        return {}
    left = max(total - small, 0)
    out: dict[str, int] = {}
    if benign in large:
        share = large[benign] / sum(large.values())
        out[benign] = min(large[benign], max(int(total * benign_floor), int(left * share)))
        left = max(left - out[benign], 0)
    rest = {c: n for c, n in large.items() if c != benign}
    return out | {c: min(n, int(left * n / sum(rest.values()))) for c, n in rest.items()}


def random_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same on every run: the smallest
    hashes (a local top n in each partition, then one merge)."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def redraw(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement: each draw picks a rank by hash and joins it."""
    total = df.count()
    if not total:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), (mixed(F.col("id"), seed=seed) % F.lit(total) + 1).alias("_at"))
    r = ranked(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(key)])
    return r.join(draws, F.col("rank") == F.col("_at")).select(*df.columns, "draw")


def audit(split: DataFrame, label: str, time: str, features: list[str]) -> DataFrame:
    """Per split and class: rows, share of the split, time range, and rows whose
    features occur in train as well (0 for train itself)."""
    h = [F.xxhash64(*features).alias("_a"), F.xxhash64(F.lit(11), *features).alias("_b")]
    hashed = split.select("split", label, time, *h)
    seen = hashed.filter("split = 'train'").select("_a", "_b").distinct().withColumn("_seen", F.lit(1))
    marked = hashed.join(seen, ["_a", "_b"], "left")
    per = marked.groupBy("split", label).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"),
        F.sum(F.when((F.col("split") != "train") & F.col("_seen").isNotNull(), 1).otherwise(0)).alias("in_train"),
    )
    totals = per.groupBy("split").agg(F.sum("n_rows").alias("_t"))
    return per.join(F.broadcast(totals), "split").withColumn("share", F.col("n_rows") / F.col("_t")).drop("_t")  # one row per split


def require_clean(split: DataFrame, label: str, time: str, features: list[str], coverage: bool = True) -> None:
    """Raises if an evaluation row also stands in train, or (with ``coverage``)
    if an evaluation split has a class that train has not."""
    rows = audit(split, label, time, features).collect()  # splits x classes
    if sum(r["in_train"] for r in rows):
        raise ValueError("rows of train occur again in an evaluation split")
    known = {r[label] for r in rows if r["split"] == "train"}
    if coverage and (missing := {r[label] for r in rows} - known):
        raise ValueError(f"classes absent from train: {sorted(missing, key=str)}")


def unseen_pairs(test: DataFrame, train: DataFrame, source: str, target: str) -> DataFrame:
    """Share of test rows whose (source, target) pair is new."""
    known = train.select(source, target).distinct().withColumn("_k", F.lit(1))
    pairs = test.groupBy(source, target).agg(F.count(F.lit(1)).alias("n"))  # folded, so heavy pairs are one row
    return pairs.join(known, [source, target], "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("test_rows"), F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("n"))), F.lit(0)).alias("unseen_rows")
    ).withColumn("unseen_rate", F.coalesce(F.try_divide(F.col("unseen_rows").cast("double"), F.col("test_rows")), F.lit(0.0)))


def host_concentration(df: DataFrame, label: str, host: str) -> DataFrame:
    """Per class: rows, distinct hosts, the busiest host (ties: the smaller) and
    its share. A class of few hosts can be told by its hosts alone."""
    per = df.groupBy(label, host).agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(label).agg(
        F.sum("n").alias("n_rows"), F.count(host).alias("n_hosts"), F.max("n").alias("top_rows"),
        F.min_by(host, F.struct(-F.col("n"), F.col(host))).alias("top_host"),
    )
    return top.withColumn("top_share", F.col("top_rows") / F.col("n_rows"))


def class_weights(counts: DataFrame, n: str = "n", beta: float = 0.999) -> DataFrame:
    """Effective-number weights (1 - b) / (1 - b^n)."""
    return counts.withColumn("weight", F.lit(1 - beta) / (1 - F.pow(F.lit(beta), F.col(n))))



def near_duplicate_rate(test: DataFrame, train: DataFrame, features: list[str], key: str, radius: float = 1e-6, width: float = 0.05) -> DataFrame:
    """One row: test rows, those within ``radius`` (Euclidean, null as 0) of a train
    row, and their share.

    Rows meet in cells of four projections (unit vectors over disjoint features,
    so a projection moves by at most the distance); a test row also looks into the
    cells beyond borders within the radius, 16 at most. Only keys meet; vectors
    of the few that met are fetched and compared.
    """
    value = lambda names: F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) + F.lit(0.0) for c in names])
    groups = [g for g in (features[k::4] for k in range(4)) if g]
    sums = F.array(*[F.aggregate(value(g), F.lit(0.0), lambda a, x: a + F.greatest(F.least(x, F.lit(1e6)), F.lit(-1e6))) / math.sqrt(len(g)) for g in groups])
    cell = lambda shift: F.transform("_s", lambda v: F.floor((v + shift) / F.lit(width) - F.lit(0.3719)))
    reach = radius * (1 + 1e-9) + 1e-9
    choices = F.transform(F.arrays_zip(cell(F.lit(-reach)).alias("a"), cell(F.lit(reach)).alias("b")), lambda t: F.array_distinct(F.array(t["a"], t["b"])))
    empty = F.array().cast("array<bigint>")
    probes = F.aggregate(choices, F.array(empty), lambda acc, c: F.flatten(F.transform(acc, lambda h: F.transform(c, lambda x: F.concat(h, F.array(x))))))
    classes = lambda df: df.select(F.xxhash64(value(features)).alias("_a"), F.xxhash64(F.lit(7), value(features)).alias("_b"), sums.alias("_s"))
    t = materialise(classes(train).groupBy("_a", "_b").agg(F.first("_s").alias("_s")).select("_a", "_b", cell(F.lit(0.0)).alias("_c")), "near-train")
    e = materialise(classes(test).groupBy("_a", "_b").agg(F.first("_s").alias("_s"), F.count(F.lit(1)).alias("n")).select("_a", "_b", "n", F.explode(probes).alias("_c")), "near-test")
    met = materialise(t.withColumnsRenamed({"_a": "ta", "_b": "tb"}).join(e.withColumnsRenamed({"_a": "ea", "_b": "eb"}), "_c").select("ta", "tb", "ea", "eb", "n").distinct(), "near-met")
    vectors = lambda df, a, b, v: df.select(F.xxhash64(value(features)).alias(a), F.xxhash64(F.lit(7), value(features)).alias(b), value(features).alias(v)).join(met.select(a, b).distinct(), [a, b], "left_semi").groupBy(a, b).agg(F.first(v).alias(v))
    both = met.join(vectors(train, "ta", "tb", "f"), ["ta", "tb"]).join(vectors(test, "ea", "eb", "g"), ["ea", "eb"])
    near = F.sqrt(F.aggregate(F.zip_with("f", "g", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) <= radius
    hit = both.filter(near).select("ea", "eb", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_near"))
    out = test.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_near", hit.scalar())
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_near").cast("double"), F.col("n_rows")), F.lit(0.0)))
