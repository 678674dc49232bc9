"""Splits in which all records linked through an author, source or entity stay together.

Records carry nodes (an entity as it is written); links say which nodes mean
the same. Linked nodes form components, found by hooking and pointer jumping
on DataFrames: every round hooks each root to its smallest neighbour, jumps
pointers until all point at a root, and contracts the links, so rounds are
logarithmic and links vanish as they are used. The component table (node,
component, split) is persisted in the shared folder and can be carried on:
existing components keep their split, new ones fill the deficits of the target
shares (overall and per class), and a merge of components that already have
different splits is quarantined instead of moving published records.

Shares are met without gathering components: only *units* reach the driver.
A component of at least ``heavy_share`` of all rows is a unit of its own (at most
``1 / heavy_share`` exist); all lighter ones are hashed into ``buckets`` buckets
per class, and a bucket is a unit. Both numbers are parameters, not data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.plans.shared import materialise

HEAVY_SHARE = 0.001
BUCKETS = 256
QUARANTINE = "quarantine"


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node reachable.

    Links with a null end are left out, a link of a node to itself just names
    the node, repeated links count once; no links give no rows.
    """
    ends = links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    ends = materialise(ends, "links")
    nodes = ends.select(F.col("lo").alias("node")).union(ends.select("hi")).distinct()
    table = nodes.withColumn("component", F.col("node"))
    edges = ends.filter("lo <> hi")
    while not edges.isEmpty():
        parents = _jump(edges.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("parent")))
        table = materialise(_lift(table, parents, "component"), "components")
        moved = _lift(_lift(edges, parents, "lo"), parents, "hi")
        edges = materialise(
            moved.filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "links"
        )
    return table


def _lift(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    p = parents.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    joined = df.join(p, F.col(column) == F.col("_child"), "left")
    return joined.withColumn(column, F.coalesce("_parent", column)).drop("_child", "_parent")


def _jump(parents: DataFrame) -> DataFrame:
    """Pointers doubled until each points at a root (parents are smaller than
    children, so there are no cycles)."""
    while True:
        up = parents.select(F.col("child").alias("_mid"), F.col("parent").alias("_up"))
        step = parents.join(up, F.col("parent") == F.col("_mid"), "left")
        parents = materialise(step.select("child", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("jumped")), "pointers")
        if parents.filter("jumped").isEmpty():
            return parents.drop("jumped")
        parents = parents.drop("jumped")


def extend_components(links: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``node, component, split, conflict`` of all nodes, old and new.

    ``previous`` is an earlier table ``node, component, split``. Its components
    are carried on under their old name: a new node linked to one joins it and
    gets its split. Where links merge several old components of one split, all
    take the smallest name. Where the splits differ, old nodes keep component
    and split, and the new nodes of the merge get ``QUARANTINE`` and a component
    of their own, so that a component never has two splits and the result can be
    carried on again; ``conflict`` marks both. ``split`` is null for components
    that are new altogether.
    """
    if previous is None:
        return components(links).withColumns({"split": F.lit(None).cast("string"), "conflict": F.lit(False)})
    old = materialise(previous.select("node", F.concat(F.lit("component:"), F.col("component")).alias("held"), "component", F.col("split").alias("was")), "previous")
    named = _known(_known(links, old, "a"), old, "b")
    own = old.select(F.col("held").alias("a"), F.col("held").alias("b")).distinct()
    found = components(named.select("a", "b").unionByName(own))
    splits = old.select(F.col("held").alias("node"), "component", "was").distinct().withColumnRenamed("component", "old_name")
    merged = found.join(splits, "node", "left")
    facts = merged.groupBy("component").agg(F.min("old_name").alias("kept"), F.min("was").alias("one"), F.max("was").alias("other"))
    judged = facts.select("component", "kept", "one", (F.col("one") != F.col("other")).alias("clash"))
    both = merged.join(judged, "component")
    fresh = both.filter("was IS NULL AND old_name IS NULL").select(
        "node", F.when(F.col("clash") & ~F.col("kept").startswith(QUARANTINE), F.concat(F.lit(f"{QUARANTINE} "), "kept")).otherwise(F.coalesce("kept", "component")).alias("component"),
        F.when(F.col("clash"), F.lit(QUARANTINE)).otherwise(F.col("one")).alias("split"), F.coalesce("clash", F.lit(False)).alias("conflict"),
    )
    carried = both.filter("old_name IS NOT NULL").select(F.col("node").alias("held"), "kept", "clash")
    stay = old.join(carried, "held").select(
        "node", F.when(F.col("clash"), F.col("component")).otherwise(F.col("kept")).alias("component"),
        F.col("was").alias("split"), F.coalesce("clash", F.lit(False)).alias("conflict"),
    )
    return stay.unionByName(fresh)


def _known(links: DataFrame, old: DataFrame, end: str) -> DataFrame:
    o = old.select(F.col("node").alias("_node"), "held")
    return links.join(o, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("held", end)).drop("_node", "held")


def _place(units: list, shares: dict[str, float], classes: list[str], already: dict) -> dict:
    """Greedy placement of units (id, {class: rows}), largest first, each into
    the split where it best fills what is missing, per class and overall."""
    names = list(shares)
    vectors = np.zeros((len(units), len(classes) + 1))
    at = {c: i for i, c in enumerate(classes)}
    for i, (_, rows) in enumerate(units):
        for c, n in rows.items():
            vectors[i, at[c]] += n
    have = np.zeros((len(names), len(classes) + 1))
    for (split, c), n in already.items():
        if split in shares:
            have[names.index(split), at[c]] += n
    vectors[:, -1], have[:, -1] = vectors.sum(axis=1), have.sum(axis=1)
    whole = vectors.sum(axis=0) + have.sum(axis=0)
    goal = np.outer(np.array([shares[s] for s in names]), whole)
    scale = 1 / np.maximum(whole, 1)
    scale[-1] *= 2  # the overall shares come first
    out = {}
    for i in np.lexsort((np.arange(len(units)), -(vectors * scale).max(axis=1))):
        v = vectors[i]
        # growth of the squared distance to the goals, relative to each class's size
        cost = ((2 * (have - goal) * v + v * v) * scale * scale / np.maximum(goal * scale, 1e-9)).sum(axis=1)
        s = int(np.argmin(cost))
        have[s] += v
        out[units[i][0]] = names[s]
    return out


def assign_splits(weights: DataFrame, shares: dict[str, float], heavy_share: float = HEAVY_SHARE, buckets: int = BUCKETS, max_classes: int = 256, seed: int = 5) -> DataFrame:
    """``component, split`` for ``weights``: ``component, cls, n, split`` (rows of
    each class in each component; split null where none is assigned yet).

    Components with a split keep it. ``cls`` must be of few values (checked); a
    null class counts as ``?``.
    """
    spark = weights.sparkSession
    weights = materialise(weights.withColumn("cls", F.coalesce(F.col("cls").cast("string"), F.lit("?"))), "weights")
    totals = {r["cls"]: int(r["n"]) for r in weights.groupBy("cls").agg(F.sum("n").alias("n")).limit(max_classes + 1).collect()}
    if len(totals) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    already = {(r["split"], r["cls"]): int(r["n"]) for r in weights.filter("split IS NOT NULL").groupBy("split", "cls").agg(F.sum("n").alias("n")).collect()}
    known = weights.filter("split IS NOT NULL").select("component", "split").distinct()
    new = weights.filter("split IS NULL").drop("split")
    if not totals:
        return known
    size = sum(totals.values())
    # a light component belongs to the class of which it holds the largest part
    total_map = F.create_map(*[F.lit(x) for c, n in totals.items() for x in (c, float(n))])
    part = F.col("n") / F.element_at(total_map, F.col("cls"))
    per = new.groupBy("component").agg(F.sum("n").alias("rows"), F.max_by("cls", F.struct(part, "cls")).alias("main"))
    heavy = F.col("rows") >= F.lit(heavy_share * size)
    bucket = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(buckets))
    units = materialise(per.select("component", F.when(heavy, F.concat(F.lit("="), F.col("component"))).otherwise(F.concat("main", F.lit("#"), bucket.cast("string"))).alias("unit")), "units")
    summed = new.join(units, "component").groupBy("unit", "cls").agg(F.sum("n").alias("n"))
    rows: dict[str, dict] = {}
    for r in summed.orderBy("unit", "cls").collect():  # at most 1 / heavy_share + classes * buckets units
        rows.setdefault(r["unit"], {})[r["cls"]] = int(r["n"])
    placed = _place(list(rows.items()), shares, sorted(totals), already)
    table = spark.createDataFrame(list(placed.items()), "unit string, split string")
    return known.unionByName(units.join(F.broadcast(table), "unit").select("component", "split"))


def attach(records: DataFrame, node: Column, table: DataFrame, counts: DataFrame, total: int, columns: list[str], heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``_row`` (the record as one struct) and ``columns`` of its node's table row.

    Nodes with at least ``heavy_share`` of the records (``counts``: node, n; at
    most ``1 / heavy_share`` of them, a proven bound) are joined by broadcast,
    so their records never meet in one task; all others by a shuffle in which
    no key is heavy. Records without a node, or of none in the table, are left out.
    """
    wide = table.select("node", *columns)
    hot = F.broadcast(materialise(counts.filter(F.col("n") >= F.lit(max(1.0, heavy_share * total))).join(wide, "node").select("node", *columns), "hot"))
    rows = records.select(F.struct("*").alias("_row"), node.alias("node")).filter("node IS NOT NULL")
    near = rows.join(hot, "node")
    far = rows.join(hot.select("node"), "node", "left_anti").join(wide, "node")
    return near.unionByName(far).select("_row", *columns)
