"""A bank of class prototypes: scoring by evidence, three-way decisions, and new
classes added by appending rows.

A bank is a DataFrame ``class_id INT, sub_id INT, proto ARRAY<DOUBLE>, trained
BOOLEAN``. It is small by construction (classes times sub-prototypes) and its
size is checked; it enters a plan as one scalar subquery, so scoring is a
projection: no join, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import vec
from flowmill.functions.mathx import log_sum_exp
from flowmill.plans.shared import materialise

MAX_BANK = 10_000


def class_means(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """A bank of one unit-norm mean per class: one fold of ``size`` averages,
    partial on the map side, so a class of any share costs one row per task."""
    means = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("class_id")).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)])
    return means.select("class_id", F.lit(0).alias("sub_id"), vec.unit(F.array(*[f"_{i}" for i in range(size)])).alias("proto"), F.lit(True).alias("trained"))


def sub_prototypes(df: DataFrame, label: str, vector: str, size: int, per_class: int = 2, rounds: int = 5) -> DataFrame:
    """A bank of up to ``per_class`` prototypes per class, by cosine k-means of a
    few rounds. The first seed of a class is its vector of smallest hash, each
    further one the vector least like the seeds so far (a class of fewer
    distinct directions gets fewer); each seed and each round is one fold."""
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    own, v, h = F.col(label).cast("int").alias("class_id"), F.transform(F.col(vector), lambda x: x.cast("double")), F.xxhash64(F.col(vector))
    seed = lambda d, at: d.select("class_id", F.lit(at).alias("sub_id"), vec.unit(F.col("v")).alias("proto"), F.lit(True).alias("trained"))
    bank = materialise(seed(rows.groupBy(own).agg(F.min_by(v, h).alias("v")), 0), "seeds")
    for at in range(1, per_class):
        mine = F.filter("_bank", lambda b: b["class_id"] == F.col(label).cast("int"))[0]["subs"]
        like = F.array_max(F.transform(mine, lambda b: vec.cosine(F.col(vector), b["proto"])))
        far = rows.withColumn("_bank", _packed(bank)).withColumn("_like", like).filter(F.col("_like") < 1 - 1e-9)
        bank = materialise(bank.unionByName(seed(far.groupBy(own).agg(F.min_by(v, F.struct("_like", h)).alias("v")), at)), "seeds")
    df = rows
    for _ in range(rounds):
        near = nearest_own(df, bank, label, vector)
        means = near.groupBy(F.col(label).cast("int").alias("class_id"), "sub_id").agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)])
        bank = materialise(means.select("class_id", "sub_id", vec.unit(F.array(*[f"_{i}" for i in range(size)])).alias("proto"), F.lit(True).alias("trained")), "bank")
    return bank


def _packed(bank: DataFrame) -> Column:
    """The whole bank as one array of classes in a scalar subquery, sorted, each
    with its sub-prototypes."""
    per = bank.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("sub_id", "proto"))).alias("subs"))
    return per.agg(F.array_sort(F.collect_list(F.struct("class_id", "subs"))).alias("bank")).scalar()


def check_bank(bank: DataFrame) -> DataFrame:
    """The bank, after checking that it is small enough to ship to each task."""
    if bank.limit(MAX_BANK + 1).count() > MAX_BANK:
        raise ValueError(f"a bank may hold at most {MAX_BANK} prototypes")
    return bank


def nearest_own(df: DataFrame, bank: DataFrame, label: str, vector: str) -> DataFrame:
    """``df`` with ``sub_id``: the nearest sub-prototype of the row's own class."""
    own = F.filter("_bank", lambda b: b["class_id"] == F.col(label).cast("int"))[0]["subs"]
    scored = F.transform(own, lambda b: F.struct((-vec.dot(F.col(vector), b["proto"])).alias("d"), b["sub_id"].alias("s")))
    return df.withColumn("_bank", _packed(bank)).withColumn("sub_id", F.array_min(scored)["s"]).drop("_bank")


def cosines(df: DataFrame, bank: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``classes`` (ids, ascending) and ``cos`` (largest cosine per
    class over its sub-prototypes, in the order of ``classes``)."""
    packed = df.withColumn("_bank", _packed(check_bank(bank)))
    score = lambda t, s: F.coalesce(F.try_divide(vec.dot(t["z"], s["proto"]), t["n"]), F.lit(0.0))
    best = vec.let(
        F.struct(F.col(vector).alias("z"), vec.norm(F.col(vector)).alias("n"), F.col("_bank").alias("b")),
        lambda t: F.transform(t["b"], lambda c: F.array_max(F.transform(c["subs"], lambda s: score(t, s)))),
    )
    return packed.withColumns({"classes": F.transform("_bank", lambda b: b["class_id"]), "cos": best}).drop("_bank")


def evidence(df: DataFrame, margin: float = 0.2, tau: float = 0.1, clamp: float = 15.0) -> DataFrame:
    """Evidence of the Dirichlet head from ``cos``: ``log_e``, ``strength`` (S),
    ``p``, ``vacuity`` and ``evidence_total``. log S is shifted by its maximum."""
    log_e = F.transform("cos", lambda c: F.greatest(F.least((c - 1 + margin) / tau, F.lit(clamp)), F.lit(-clamp)))
    n = F.size("cos").cast("double")
    out = df.withColumn("log_e", log_e).withColumn("_ls", log_sum_exp(F.concat("log_e", F.array(F.ln(n))))).withColumn("strength", F.exp("_ls"))
    return out.withColumns({
        "p": vec.let(F.struct("log_e", "strength"), lambda t: F.transform(t["log_e"], lambda x: (F.exp(x) + 1) / t["strength"])), "vacuity": n / F.col("strength"),
        "evidence_total": vec.total(F.transform("log_e", lambda x: F.exp(x))),
    }).drop("_ls")


def decide(df: DataFrame, theta_unknown: float | None = 0.5, theta_defer: float | None = 0.1) -> DataFrame:
    """``predicted`` (class of the largest p), ``gap`` (its lead over the second)
    and ``decision``: the class, -1 (unknown: too little evidence) or -2 (defer:
    too small a lead). A threshold of 0 is a threshold; only None means default."""
    tu, td = 0.5 if theta_unknown is None else theta_unknown, 0.1 if theta_defer is None else theta_defer
    two = vec.top_two(F.col("p"))
    out = df.withColumn("predicted", F.element_at("classes", vec.argmax(F.col("p")) + 1)).withColumn("gap", F.coalesce(two[0] - F.try_element_at(two, F.lit(2)), two[0]))
    decision = F.when(F.col("evidence_total") < tu, -1).when(F.col("gap") < td, -2).otherwise(F.col("predicted"))
    return out.withColumn("decision", decision)


def softmax_head(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``p`` as a softmax of cosines, for the plain head."""
    return df.withColumn("p", vec.softmax(F.transform("cos", lambda c: c / temperature)))


def distance_head(df: DataFrame, threshold: float) -> DataFrame:
    """``decision``: the nearest class, or -1 if its cosine distance exceeds the threshold."""
    best = F.array_max("cos")
    return df.withColumn("distance", 1 - best).withColumn("decision", F.when(1 - best > threshold, -1).otherwise(F.element_at("classes", vec.argmax(F.col("cos")) + 1)))


def allocation(counts: DataFrame, label: str, n: str = "n", benign: str = "benign", large: int = 10_000, sizes: tuple[int, int, int] = (4, 2, 1)) -> DataFrame:
    """Sub-prototypes per class: most for benign (any case), two for large
    classes, one for others."""
    return counts.withColumn("n_sub", F.when(F.lower(label) == benign.lower(), sizes[0]).when(F.col(n) >= large, sizes[1]).otherwise(sizes[2]))


def register_class(bank: DataFrame, samples: DataFrame, vector: str, class_id: int, size: int, n_sub: int = 1) -> DataFrame:
    """The bank with one more class: the unit mean of the samples, or, where there
    are at least ``4 * n_sub`` of them, ``n_sub`` prototypes by five rounds of
    cosine k-means. Rows already there are untouched, so no old score changes.
    No samples add nothing."""
    old = bank.select("class_id", "sub_id", "proto", "trained")
    if n_sub > 1 and samples.limit(4 * n_sub).count() >= 4 * n_sub:
        new = sub_prototypes(samples.withColumn("_class", F.lit(class_id)), "_class", vector, size, n_sub)
        return old.unionByName(new.select("class_id", "sub_id", "proto", F.lit(False).alias("trained")))
    mean = samples.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)]).filter(F.col("_0").isNotNull())
    row = mean.select(F.lit(class_id).cast("int").alias("class_id"), F.lit(0).alias("sub_id"), vec.unit(F.array(*[f"_{i}" for i in range(size)])).alias("proto"), F.lit(False).alias("trained"))
    return old.unionByName(row)


def drift(bank: DataFrame, batch: DataFrame, label: str, vector: str, size: int, momentum: float = 0.99) -> DataFrame:
    """The bank after one slow update: in each class the sub-prototype nearest to
    the batch mean moves towards it and is brought back to length 1."""
    means = class_means(batch, label, vector, size).select("class_id", F.col("proto").alias("m"))
    near = bank.join(means, "class_id", "left").withColumn("s", F.when(F.col("m").isNotNull(), vec.dot(F.col("proto"), F.col("m"))))
    best = near.groupBy("class_id").agg(F.max_by("sub_id", F.struct("s", -F.col("sub_id"))).alias("best"))
    moved = vec.unit(F.zip_with("proto", "m", lambda a, b: a * momentum + b * (1 - momentum)))
    return near.join(best, "class_id").select("class_id", "sub_id", F.when((F.col("sub_id") == F.col("best")) & F.col("m").isNotNull(), moved).otherwise(F.col("proto")).alias("proto"), "trained")


def diversity_penalty(bank: DataFrame, most: float = 0.8) -> DataFrame:
    """Per class the summed squared excess of cosines between its sub-prototypes."""
    lists = check_bank(bank).groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("sub_id", "proto"))).alias("m"))
    over = F.transform("m", lambda a: vec.total(F.transform("m", lambda b: F.when(a["sub_id"] == b["sub_id"], 0.0).otherwise(F.pow(F.greatest(vec.dot(a["proto"], b["proto"]) - most, F.lit(0.0)), F.lit(2))))))
    return lists.select("class_id", vec.total(over).alias("penalty"))


def mixed_unknowns(df: DataFrame, key: str, label: str, vector: str, low: float = 0.35, high: float = 0.65, most: float = 0.9) -> DataFrame:
    """Synthetic unknowns: each row blended with one of another class and brought
    to length 1; blends too near (cosine above ``most``) to a parent are dropped.

    Partners are found by rank: rows are ranked in hash order (balanced slices),
    and each is joined with the next rank, so there is one partner per row."""
    from flowmill.operators.ranking import hash_order, ranked, uniform

    r = ranked(df.select(key, label, vector).withColumn("_all", F.lit(0)), ["_all"], [hash_order(key, 13), F.col(key)])
    nxt = r.select((F.col("rank") - 1).alias("rank"), F.col(label).alias("_l"), F.col(vector).alias("_v"), F.col(key).alias("partner"))
    mu = F.lit(low) + uniform(F.col(key), seed=17) * (high - low)
    pair = r.join(nxt, "rank").filter(F.col(label) != F.col("_l")).withColumn("mu", mu)
    mixed = pair.withColumn("mixed", vec.unit(F.zip_with(vector, "_v", lambda a, b: a.cast("double") * F.col("mu") + b.cast("double") * (1 - F.col("mu")))))
    near = F.greatest(vec.cosine(F.col("mixed"), F.col(vector)), vec.cosine(F.col("mixed"), F.col("_v")))
    return mixed.withColumn("nearest", near).filter(F.col("nearest") <= most).select(key, "partner", "mu", "mixed", "nearest")


def anneal(epoch: int, start: float = 0.5, final: float = 0.1, epochs: int = 10, least: float = 0.05) -> float:
    """The temperature of an epoch: geometric from start to final."""
    if epochs <= 0:
        return max(start, least)
    return max(start * (final / start) ** min(1.0, epoch / epochs), least)


def softplus_inverse(y: float) -> float:
    return math.log(math.expm1(y))
