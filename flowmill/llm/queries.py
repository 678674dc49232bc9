"""The queries of problems 2 to 9 and, where SQL can express them, their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import ipv4, ipv4_sql, label_key, label_key_sql, measure
from flowmill.llm import grouped_splits, mixing, overlaps, percentiles, proportions, tokenize, top_items
from flowmill.llm.shared_spans import SentenceRuns, SharedSpans
from flowmill.plans.shared import broadcast_if_small, keep, kept, materialise, shared_dir
from flowmill.sources.tables import table

# --- 2: most frequent items -------------------------------------------------

FREQUENT_SHARE, TOP_K = 0.01, 100


def _p2_fields() -> dict[str, Column]:
    return {"L4_DST_PORT": F.col("L4_DST_PORT").cast("string"), "IPV4_DST_ADDR": ipv4("IPV4_DST_ADDR")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Ports and addresses that hold at least 1 % of the rows with one."""
    return top_items.frequent_items(table(spark, d, "nf_ton_iot_v3"), _p2_fields(), FREQUENT_SHARE).select("field_name", "item")


def p2_top_items(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent ports and addresses with their counts."""
    return top_items.top_items(table(spark, d, "nf_ton_iot_v3"), _p2_fields(), TOP_K).withColumn("item_rank", F.col("item_rank").cast("bigint"))


_P2_COUNTS = f"""SELECT field_name, item, count(*) n FROM (
    SELECT 'L4_DST_PORT' field_name, L4_DST_PORT::VARCHAR item FROM nf_ton_iot_v3
    UNION ALL SELECT 'IPV4_DST_ADDR', {ipv4_sql("IPV4_DST_ADDR")} FROM nf_ton_iot_v3) WHERE item IS NOT NULL GROUP BY 1, 2"""

# --- 3: a sample to target proportions ---------------------------------------

SAMPLE_SHARE = 0.2
MAX_VOCABULARY = 10_000


def _fixed(spark: SparkSession, d: str, name: str) -> list:
    """A small fixed table; raises if it is not small."""
    return proportions.bounded(table(spark, d, name), MAX_VOCABULARY, f"rows of {name}")


def _p3_targets(spark: SparkSession, d: str) -> list:
    return sorted(_fixed(spark, d, "sample_targets"), key=lambda r: r["attack"])


def _p3_usable(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose Attack names a class and whose Label agrees with it; ``attack``
    is the class as spelled in sample_targets (else as in label_vocab),
    ``protocol`` one of tcp, udp, icmp and other (null too)."""
    vocab = table(spark, d, "label_vocab").filter("dataset = 'cicids2018'").select(label_key("raw_label").alias("_key"), "raw_label").dropDuplicates(["_key"])
    targets = table(spark, d, "sample_targets").select(label_key("attack").alias("_key"), F.col("attack").alias("_spelled")).dropDuplicates(["_key"])
    names = vocab.join(targets, "_key", "left").select("_key", F.coalesce("_spelled", "raw_label").alias("attack"))
    protocol = F.when(F.col("PROTOCOL") == 6, "tcp").when(F.col("PROTOCOL") == 17, "udp").when(F.col("PROTOCOL") == 1, "icmp").otherwise("other")
    rows = table(spark, d, "nf_cicids2018_v3").select("flow_id", F.col("Label").alias("label"), protocol.alias("protocol"), label_key("Attack").alias("_key"))
    joined = rows.join(broadcast_if_small(names, MAX_VOCABULARY), "_key")
    return joined.filter(F.col("label") == F.when(F.col("_key") == "benign", 0).otherwise(1)).drop("_key")


def _p3_plan(spark: SparkSession, d: str):
    """Margins: Attack and Label as targeted, and crossing them the protocols in
    the proportions they have."""
    targets = _p3_targets(spark, d)
    shares = {r["attack"]: r["target_share"] for r in targets}
    by_label: dict = {}
    for r in targets:
        by_label[r["label"]] = by_label.get(r["label"], 0.0) + r["target_share"]
    margins = [proportions.Margin("attack", shares), proportions.Margin("label", by_label), proportions.Margin("protocol", None)]
    cells = {n: F.col(n) for n in ("attack", "label", "protocol")}
    rows, plan = proportions.proportional_plan(_p3_usable(spark, d), cells, F.col("flow_id"), margins, {r["attack"]: r["min_rows"] for r in targets}, SAMPLE_SHARE)
    return rows, plan, [(r["attack"], r["target_share"], r["min_rows"]) for r in targets]


_P3_REPORT = (
    "attack string, target_share double, min_rows bigint, available bigint, wanted double, drawn bigint, taken bigint, "
    "actual_share double, gap double, short_of_share boolean, short_of_minimum boolean"
)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per class: target, rows available, drawn and taken, and the gaps left."""
    rows, plan, targets = _p3_plan(spark, d)
    return spark.createDataFrame(proportions.gap_report(plan, proportions.draw_counts(rows, plan), targets), _P3_REPORT)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose gap the repaired sample could not close."""
    return p3_report(spark, d).filter("short_of_share OR short_of_minimum").select("attack")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled flows: flow_id, attack, label, protocol."""
    rows, plan, _ = _p3_plan(spark, d)
    return proportions.proportional_sample(rows, plan).select("flow_id", "attack", "label", "protocol")


def p3_margins(spark: SparkSession, d: str) -> DataFrame:
    """Per category of each margin: its share among usable rows, after raking, and in the sample."""
    rows, plan, _ = _p3_plan(spark, d)
    taken = proportions.proportional_sample(rows, plan).groupBy("attack", "label", "protocol").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per cell
    out = []
    for m in ("attack", "label", "protocol"):
        for v in sorted({c["cell"][m] for c in plan.cells}, key=str):
            mine = [c for c in plan.cells if c["cell"][m] == v]
            share = lambda part, whole: float(part) / max(float(whole), 1e-12)
            out.append((m, str(v), share(sum(c["available"] for c in mine), sum(c["available"] for c in plan.cells)), share(sum(c["fitted"] for c in mine), sum(c["fitted"] for c in plan.cells)),
                        share(sum(r["n"] for r in taken if r[m] == v), sum(r["n"] for r in taken))))
    return spark.createDataFrame(out, "margin string, category string, table_share double, raked_share double, sample_share double")


def p3_sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sample, in one row: its size, distinct flows, flows
    that are not usable, and the classes below their minimum though they have the rows."""
    s = p3_sample(spark, d)
    usable = _p3_usable(spark, d).select("flow_id", "attack", "label")
    per = s.groupBy("attack").agg(F.count(F.lit(1)).alias("taken"))
    have = usable.groupBy("attack").agg(F.count(F.lit(1)).alias("have"))
    goal = table(spark, d, "sample_targets").join(have, "attack", "left").join(per, "attack", "left").na.fill(0, ["have", "taken"])
    low = goal.agg(F.sum(F.when(F.col("taken") < F.least("min_rows", "have"), 1).otherwise(0)).alias("v"))
    odd = s.join(usable, ["flow_id", "attack", "label"], "left_anti").agg(F.count(F.lit(1)).alias("v"))
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("flow_id").alias("n_flows")).withColumns({"not_usable": odd.scalar(), "below_minimum": low.scalar()})


_P3_USABLE = f"""SELECT v.key, count(*) n FROM (SELECT DISTINCT {label_key_sql("raw_label")} AS key FROM label_vocab WHERE dataset = 'cicids2018') v
    JOIN nf_cicids2018_v3 f ON {label_key_sql("f.Attack")} = v.key
    WHERE f.Label = CASE WHEN v.key = 'benign' THEN 0 ELSE 1 END GROUP BY 1"""

# --- 4: records of training in evaluation splits ------------------------------

RADIUS, CELL = 0.01, 0.25
_NOT_FEATURES = {"row_id", "dataset", "canonical_label", "FLOW_START_MILLISECONDS", "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT"}


def _p4_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """All features, and those projected: the continuous ones (not flags, one-hot
    or histogram columns, which tell few records apart)."""
    names = [c for c in df.columns if c not in _NOT_FEATURES]
    dull = ("TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "PROTOCOL_", "pkt_size_hist_norm_", "iat_undefined")
    return names, [c for c in names if not c.startswith(dull)]


def _p4_overlaps(spark: SparkSession, d: str) -> overlaps.Overlaps:
    train = table(spark, d, "train_features")
    val, test = (table(spark, d, f"{s}_features").withColumn("_split", F.lit(s)) for s in ("val", "test"))
    names, spread = _p4_features(train)
    carry = {"e": F.col("row_id"), "split": F.col("_split"), "source": overlaps.normalised(F.col("dataset"))}
    return overlaps.Overlaps(train, val.unionByName(test), names, spread, RADIUS, CELL, {"t": F.col("row_id")}, carry)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation row within distance 0.01."""
    return _p4_overlaps(spark, d).pairs().select(F.least("t", "e").alias("row_a"), F.greatest("t", "e").alias("row_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and dataset: rows, and rows that occur in training exactly,
    nearly, or at all."""
    return _p4_overlaps(spark, d).counts("split", "source")


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation row the number of equal and of other near rows of training."""
    return _p4_overlaps(spark, d).classes().select(F.col("e").alias("row_id"), "split", "source", "n_exact", "n_near")


_F84 = "[" + ", ".join(f"coalesce(x[{i}], 0)" for i in range(1, 85)) + "]"
_P4_VECTORS = f"""v AS (SELECT split, row_id, source, {_F84} f FROM (SELECT split, row_id, source, list_value(*COLUMNS(* EXCLUDE (split, source, {", ".join(sorted(_NOT_FEATURES))}))) x FROM (
    SELECT *, 'train' split, dataset source FROM train_features UNION ALL BY NAME SELECT *, 'val' split, dataset source FROM val_features UNION ALL BY NAME SELECT *, 'test' split, dataset source FROM test_features)))"""
_P4_PAIRS = """t AS (SELECT row_id t, f, f[1] k FROM v WHERE split = 'train'), e AS (SELECT row_id e, split, source, f g, f[1] k FROM v WHERE split <> 'train'),
    c AS (SELECT t, e, split, source, list_distance(f, g) dist FROM t JOIN e ON t.k BETWEEN e.k - 0.01 AND e.k + 0.01 WHERE list_distance(f, g) <= 0.01)"""


# --- 5: percentiles -----------------------------------------------------------

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
_P5_FIELDS = ("FLOW_DURATION_MILLISECONDS", "IN_BYTES")


def _p5_rows(spark: SparkSession, d: str) -> tuple[DataFrame, Column, dict[str, Column]]:
    vocab = table(spark, d, "label_vocab").filter("dataset = 'cicids2018'").select(label_key("raw_label").alias("_key"), F.col("raw_label").alias("attack")).dropDuplicates(["_key"])
    rows = table(spark, d, "nf_cicids2018_v3").select(label_key("Attack").alias("_key"), "FLOW_START_MILLISECONDS", *_P5_FIELDS)
    return rows.join(broadcast_if_small(vocab, MAX_VOCABULARY), "_key"), F.col("attack"), {n: measure(n) for n in _P5_FIELDS}


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of duration and bytes per class, by bisection."""
    rows, group, fields = _p5_rows(spark, d)
    out = percentiles.exact_percentiles(rows, group, fields, PERCENTILES)
    return out.select(F.col("grp").alias("attack"), F.col("field").alias("field_name"), "p", "value", "n")


def _p5_states(spark: SparkSession, d: str) -> DataFrame:
    rows, group, fields = _p5_rows(spark, d)
    return percentiles.value_states(rows, F.floor(F.col("FLOW_START_MILLISECONDS") / 86_400_000), group, fields)


def p5_daily_states(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable state of each day."""
    s = _p5_states(spark, d)
    return s.select(F.col("part").alias("day"), F.col("grp").alias("attack"), F.col("field").alias("field_name"), "cell", "n", "min_x", "max_x")


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with bounds from the daily states alone."""
    merged = percentiles.percentiles_of_states(percentiles.merge_states(_p5_states(spark, d)), PERCENTILES)
    return merged.select(F.col("grp").alias("attack"), F.col("field").alias("field_name"), "p", "low", "high", "n")


_P5_VALUES = f"""SELECT v.raw_label attack, field_name, x, ms FROM (
    SELECT Attack, 'FLOW_DURATION_MILLISECONDS' field_name, FLOW_DURATION_MILLISECONDS x, FLOW_START_MILLISECONDS ms FROM nf_cicids2018_v3
    UNION ALL SELECT Attack, 'IN_BYTES', IN_BYTES, FLOW_START_MILLISECONDS FROM nf_cicids2018_v3) f
    JOIN (SELECT {label_key_sql("raw_label")} AS key, min(raw_label) raw_label FROM label_vocab WHERE dataset = 'cicids2018' GROUP BY 1) v ON {label_key_sql("f.Attack")} = v.key
    WHERE isfinite(x) AND x >= 0"""

# --- 6: splits that keep related records together -------------------------------


def _p6_nodes(spark: SparkSession, d: str, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Flows (with an id of at most ``until``, if given) with their node, and
    rows per (node, address, class).

    A node is the address text as it is written; texts of one address are
    linked through the address. Flows without an address stand alone.
    """
    vocab = table(spark, d, "label_vocab").filter("dataset = 'cicids2018'").select(label_key("raw_label").alias("_key"), F.col("raw_label").alias("cls")).dropDuplicates(["_key"])
    rows = table(spark, d, "nf_cicids2018_v3").select("flow_id", F.col("IPV4_SRC_ADDR").alias("written"), label_key("Attack").alias("_key"))
    if until is not None:
        rows = rows.filter(F.col("flow_id") <= until)
    rows = rows.join(broadcast_if_small(vocab, MAX_VOCABULARY), "_key", "left").withColumn("cls", F.coalesce("cls", F.lit("?"))).drop("_key")
    named = ipv4("written")
    counts = rows.groupBy("written", "cls").agg(F.count(F.lit(1)).alias("n")).withColumn("addr", named)
    flows = rows.withColumn("node", F.when(named.isNotNull(), F.concat(F.lit("text "), F.col("written"))).otherwise(F.concat(F.lit("flow "), F.col("flow_id").cast("string"))))
    return flows, materialise(counts.filter("addr IS NOT NULL").select(F.concat(F.lit("text "), F.col("written")).alias("node"), "addr", "cls", "n"), "texts")


def _links(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("node").alias("a"), F.concat(F.lit("addr "), F.col("addr")).alias("b"))


def _table_of(counts: DataFrame, flows: DataFrame, shares: dict[str, float], previous: DataFrame | None = None) -> DataFrame:
    """The component table: ``node, component, split``. ``previous`` is an earlier
    one; ``counts`` and ``flows`` are then those of all rows so far, old and new."""
    table_ = grouped_splits.extend_components(_links(counts), previous)
    lone = flows.filter(F.col("node").startswith("flow ")).select("node", "cls")
    if previous is None:
        lone = lone.withColumn("split", F.lit(None).cast("string"))
    else:
        table_ = materialise(table_, "extended")
        lone = lone.join(table_.filter(F.col("node").startswith("flow ")).select("node", "split"), "node", "left")
    weights = counts.join(table_, "node").filter("split IS NULL OR split <> 'quarantine'").groupBy("component", "cls", "split").agg(F.sum("n").alias("n"))
    alone = lone.select(F.col("node").alias("component"), "cls", "split", F.lit(1).cast("bigint").alias("n"))
    placed = grouped_splits.assign_splits(weights.select("component", "cls", "split", "n").unionByName(alone), shares)
    known = table_.join(placed.withColumnRenamed("split", "given"), "component", "left").select("node", "component", F.coalesce("split", "given").alias("split"))
    single = placed.filter(F.col("component").startswith("flow ")).select(F.col("component").alias("node"), "component", "split")
    if previous is not None:
        single = single.join(table_.select("node"), "node", "left_anti")
    return materialise(known.unionByName(single), "component-table")


def component_path(spark: SparkSession, d: str) -> str:
    """Where the component tables of ``d`` are kept, one folder per version."""
    return f"{shared_dir(spark)}/flowmill-kept/component-table/{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def _carried(spark: SparkSession, d: str, path: str, flows: DataFrame, counts: DataFrame) -> DataFrame:
    """The newest table under ``path`` carried on to ``flows``, kept as its next
    version; the first one if there is none."""
    return keep(_table_of(counts, flows, _shares(spark, d), kept(spark, path)), path)


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r["split_name"]: r["target_share"] for r in _fixed(spark, d, "split_shares")}


def _attached(flows: DataFrame, components: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    per_node = counts.groupBy("node").agg(F.sum("n").alias("n"))
    total = per_node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    return grouped_splits.attach(flows.drop("node"), _node(), components, per_node, int(total), columns)


def _node() -> Column:
    named = ipv4("written")
    return F.when(named.isNotNull(), F.concat(F.lit("text "), F.col("written"))).otherwise(F.concat(F.lit("flow "), F.col("flow_id").cast("string")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Flows whose address text differs from its plain form while the address
    stands elsewhere in the table in another text."""
    flows, counts = _p6_nodes(spark, d)
    table_ = grouped_splits.extend_components(_links(counts.select("node", "addr").distinct()))
    sizes = table_.filter(F.col("node").startswith("text ")).groupBy("component").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    parted = table_.join(sizes, "component").select("node", "texts")
    odd = flows.filter((ipv4("written").isNotNull()) & (ipv4("written") != F.col("written"))).select("flow_id", "written")
    return _attached(odd, parted, counts.filter(F.col("node") != F.concat(F.lit("text "), F.col("addr"))), ["texts"]).select("_row.flow_id")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every flow with its component and split."""
    flows, counts = _p6_nodes(spark, d)
    components = _table_of(counts, flows, _shares(spark, d))
    return _attached(flows.select("flow_id", "written"), components, counts, ["component", "split"]).select("_row.flow_id", "component", "split")


def p6_extended(spark: SparkSession, d: str) -> DataFrame:
    """Every flow with its component and split, by carrying on the table kept for
    ``d``. Where none is kept yet, that of the flows of the lower half of ids is
    made and kept first; nodes in a kept table never change their split."""
    path = component_path(spark, d)
    if kept(spark, path) is None:
        ends = table(spark, d, "nf_cicids2018_v3").agg(F.min("flow_id").alias("low"), F.max("flow_id").alias("high")).first()
        _carried(spark, d, path, *_p6_nodes(spark, d, ((ends["low"] or 0) + (ends["high"] or 0)) // 2))
    flows, counts = _p6_nodes(spark, d)
    components = _carried(spark, d, path, flows, counts)
    return _attached(flows.select("flow_id", "written"), components, counts, ["component", "split"]).select("_row.flow_id", "component", "split")


def _p6_quarantined(spark: SparkSession, d: str) -> DataFrame:
    """``node, component, split, conflict``: split by the texts as written, then
    carried on when the texts are found to name addresses."""
    _, counts = _p6_nodes(spark, d)
    alone = grouped_splits.assign_splits(counts.select(F.col("node").alias("component"), "cls", "n", F.lit(None).cast("string").alias("split")), _shares(spark, d))
    first = materialise(alone.select(F.col("component").alias("node"), "component", "split"), "texts-split")
    return materialise(grouped_splits.extend_components(_links(counts.select("node", "addr").distinct()), first), "relinked")


def p6_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Address texts whose splits were given before they were known to mean the
    same, with the split they keep; the address that joins them is quarantined
    where their splits differ."""
    return _p6_quarantined(spark, d).select("node", "component", "split", "conflict")


def p6_quarantine_facts(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of it, in one row: nodes, texts that lost their split,
    components with several splits, addresses whose texts differ in split but
    are not marked, and marked ones whose texts do not differ."""
    t = _p6_quarantined(spark, d)
    _, counts = _p6_nodes(spark, d)
    texts = counts.select("node", "addr").distinct()
    per = t.join(texts, "node").groupBy("addr").agg(F.countDistinct("split").alias("k"), F.max("conflict").alias("marked"))
    addr = t.filter(F.col("node").startswith("addr ")).select(F.substring("node", 6, 64).alias("addr"), F.col("split").alias("given"))
    both = per.join(addr, "addr").agg(
        F.sum(F.when((F.col("k") > 1) & ~(F.col("marked") & (F.col("given") == grouped_splits.QUARANTINE)), 1).otherwise(0)).alias("unmarked"),
        F.sum(F.when((F.col("k") == 1) & F.col("marked"), 1).otherwise(0)).alias("wrongly_marked"),
    )
    parted = t.groupBy("component").agg(F.countDistinct("split").alias("k")).agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("parted"))
    lost = t.filter(F.col("node").startswith("text ")).agg(F.sum(F.when(F.col("split").isNull() | (F.col("split") == grouped_splits.QUARANTINE), 1).otherwise(0)).alias("lost"))
    one = lambda df, c: df.select(F.coalesce(c, F.lit(0)).cast("bigint")).scalar()
    return t.agg(F.count(F.lit(1)).alias("n_nodes")).withColumns({"lost_split": one(lost, "lost"), "parted_components": one(parted, "parted"), "unmarked": one(both, "unmarked"), "wrongly_marked": one(both, "wrongly_marked")})


def _split_facts(spark: SparkSession, d: str, splits: DataFrame) -> DataFrame:
    flows = table(spark, d, "nf_cicids2018_v3").select("flow_id", ipv4("IPV4_SRC_ADDR").alias("addr"))
    j = materialise(flows.join(splits, "flow_id"), "split-facts")
    several = lambda by: j.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("n")).select(F.coalesce("n", F.lit(0)).cast("bigint")).scalar()
    names = table(spark, d, "split_shares").select(F.col("split_name").alias("split"))
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("flow_id").alias("n_flows")).withColumns({
        "parted_addresses": several("addr"), "parted_components": several("component"),
        "no_split": j.join(names, "split", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar(),
    })


def p6_splits_facts(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits, in one row: every flow has one, and no
    address and no component has two."""
    return _split_facts(spark, d, p6_splits(spark, d))


def p6_extended_facts(spark: SparkSession, d: str) -> DataFrame:
    """The same of the carried-on table, and the nodes of its first version that moved."""
    out = p6_extended(spark, d)
    path = component_path(spark, d)
    first, last = kept(spark, path, 1), kept(spark, path)
    moved = first.select("node", F.col("split").alias("was")).join(last.select("node", "split"), "node", "left").filter(~F.col("split").eqNullSafe(F.col("was")))
    return _split_facts(spark, d, out).withColumn("moved", moved.agg(F.count(F.lit(1)).alias("n")).scalar())


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split, per class and overall (class ``all``)."""
    flows, counts = _p6_nodes(spark, d)
    components = _table_of(counts, flows, _shares(spark, d))
    placed = _attached(flows.select("flow_id", "written", "cls"), components, counts, ["split"]).groupBy("_row.cls", "split").agg(F.count(F.lit(1)).alias("n"))
    both = placed.select("cls", "split", "n").unionByName(placed.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit("all").alias("cls"), "split", "n"))
    totals = both.groupBy("cls").agg(F.sum("n").alias("total"))
    return both.join(totals, "cls").select("cls", "split", "n", (F.col("n") / F.col("total")).alias("share"))


# --- 7 and 8: token ids, mixing sources ---------------------------------------------


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenize.encode(table(spark, d, "documents"), F.col("text"), {"doc_id": F.col("doc_id")})


def _p8_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_weights").select("source", "target_share", "max_repeats")


def _p8_records(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source (as spelled in source_weights, else null), size in tokens;
    written once, as texts are to be encoded only once."""
    names = broadcast_if_small(_p8_targets(spark, d).select(label_key("source").alias("_key"), F.col("source").alias("_spelled")).dropDuplicates(["_key"]), MAX_VOCABULARY)
    counted = tokenize.count_tokens(table(spark, d, "documents"), F.col("text"), {"doc_id": F.col("doc_id"), "_key": label_key("source")})
    named = counted.join(names, "_key", "left").select("doc_id", F.col("_spelled").alias("source"), F.col("n_tokens").alias("size"))
    return materialise(named, "token-counts")


def _p8_rates(spark: SparkSession, d: str, records: DataFrame) -> DataFrame:
    return materialise(mixing.source_rates(records, _p8_targets(spark, d)), "rates")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share within their repeats."""
    return _p8_rates(spark, d, _p8_records(spark, d)).filter("short").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per use of a document."""
    records = _p8_records(spark, d)
    return mixing.emit(mixing.mix(records, _p8_rates(spark, d, records), "doc_id")).select("doc_id", "source", F.col("size").alias("n_tokens"), "copy_no")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rate, tokens used and the share reached."""
    records = _p8_records(spark, d)
    rates = _p8_rates(spark, d, records)
    return mixing.share_report(mixing.mix(records, rates, "doc_id"), rates)


# --- 9: long exact spans -----------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common stretch of at least 160 characters."""
    return SharedSpans(table(spark, d, "documents"), "doc_id", "text").pairs()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per document: how much of it stands in others, and in earlier ones."""
    r = SharedSpans(table(spark, d, "documents"), "doc_id", "text").report()
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return r.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "copies", "n_chars", "shared_chars", "repeated_chars", share.alias("shared_share"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every text without the sentences that a non-first sentence run covers."""
    return SentenceRuns(table(spark, d, "documents"), "doc_id", "text").cleaned().withColumnRenamed("doc", "doc_id")


def p9_run_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a whole run of sentences of 160 characters in common."""
    return SentenceRuns(table(spark, d, "documents"), "doc_id", "text").pairs()


QUERIES = {f.__name__: f for f in (
    p2_found, p2_top_items, p3_found, p3_report, p3_sample, p3_margins, p3_sample_facts, p4_found, p4_report, p4_rows, p5_percentiles, p5_daily_states, p5_merged,
    p6_found, p6_splits, p6_extended, p6_report, p6_quarantine, p6_quarantine_facts, p6_splits_facts, p6_extended_facts, p7_ids, p8_found, p8_mixture, p8_report, p9_found, p9_report, p9_cleaned, p9_run_pairs,
)}

SQL = {
    "p2_found": f"SELECT field_name, item FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) t FROM ({_P2_COUNTS})) WHERE n >= 0.01 * t",
    "p2_top_items": f"""SELECT field_name, item, n, item_rank FROM (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n DESC, item) item_rank
        FROM ({_P2_COUNTS})) WHERE item_rank <= {TOP_K}""",
    "p3_found": f"""WITH u AS ({_P3_USABLE}), s AS (SELECT floor(coalesce(sum(n), 0) / 5) size FROM u)
        SELECT t.attack FROM sample_targets t CROSS JOIN s LEFT JOIN u ON u.key = {label_key_sql("t.attack")}
        WHERE coalesce(u.n, 0) < t.target_share * s.size OR coalesce(u.n, 0) < t.min_rows""",
    "p3_sample_facts": f"SELECT floor(sum(n) / 5)::BIGINT n_rows, floor(sum(n) / 5)::BIGINT n_flows, 0::BIGINT not_usable, 0::BIGINT below_minimum FROM ({_P3_USABLE})",
    "p4_found": f"WITH {_P4_VECTORS}, {_P4_PAIRS} SELECT least(t, e) row_a, greatest(t, e) row_b FROM c",
    "p4_rows": f"""WITH {_P4_VECTORS}, {_P4_PAIRS}, n AS (SELECT e, count(*) FILTER (dist = 0) a, count(*) FILTER (dist > 0) b FROM c GROUP BY 1)
        SELECT e.e row_id, split, replace(lower(source), '_', ' ') source, coalesce(a, 0) n_exact, coalesce(b, 0) n_near FROM e LEFT JOIN n ON n.e = e.e""",
    "p4_report": f"""WITH {_P4_VECTORS}, {_P4_PAIRS}, n AS (SELECT e, count(*) FILTER (dist = 0) a, count(*) FILTER (dist > 0) b FROM c GROUP BY 1)
        SELECT split, replace(lower(source), '_', ' ') source, count(*) n_rows, count(*) FILTER (a > 0) exact_rows, count(*) FILTER (b > 0) near_rows, count(*) FILTER (a + b > 0) overlap_rows FROM e LEFT JOIN n ON n.e = e.e GROUP BY 1, 2""",
    "p5_percentiles": f"""WITH v AS ({_P5_VALUES}), r AS (SELECT *, row_number() OVER (PARTITION BY attack, field_name ORDER BY x) k, count(*) OVER (PARTITION BY attack, field_name) n FROM v)
        SELECT attack, field_name, p.p, x AS value, n FROM r JOIN (SELECT unnest({PERCENTILES})::DOUBLE p) p ON k = greatest(1, ceil(p.p * n))""",
    "p6_found": f"""WITH t AS (SELECT flow_id, IPV4_SRC_ADDR w, {ipv4_sql("IPV4_SRC_ADDR")} addr FROM nf_cicids2018_v3),
        many AS (SELECT addr FROM t WHERE addr IS NOT NULL GROUP BY 1 HAVING count(DISTINCT w) > 1)
        SELECT flow_id FROM t JOIN many USING (addr) WHERE w <> addr""",
    "p6_splits_facts": "SELECT count(*) n_rows, count(*) n_flows, 0::BIGINT parted_addresses, 0::BIGINT parted_components, 0::BIGINT no_split FROM nf_cicids2018_v3",
    "p6_extended_facts": "SELECT count(*) n_rows, count(*) n_flows, 0::BIGINT parted_addresses, 0::BIGINT parted_components, 0::BIGINT no_split, 0::BIGINT moved FROM nf_cicids2018_v3",
    "p6_quarantine_facts": f"""SELECT count(DISTINCT w) + count(DISTINCT addr) n_nodes, 0::BIGINT lost_split, 0::BIGINT parted_components, 0::BIGINT unmarked, 0::BIGINT wrongly_marked
        FROM (SELECT IPV4_SRC_ADDR w, {ipv4_sql("IPV4_SRC_ADDR")} addr FROM nf_cicids2018_v3) WHERE addr IS NOT NULL""",
    "p5_daily_states": f"""SELECT floor(ms / 86400000)::BIGINT AS day, attack, field_name, floor(ln(1 + x) / ln(2) * 32)::INT cell, count(*) n, min(x) min_x, max(x) max_x FROM ({_P5_VALUES}) GROUP BY 1, 2, 3, 4""",
    "p5_merged": f"""WITH c AS (SELECT attack, field_name, floor(ln(1 + x) / ln(2) * 32)::INT cell, count(*) c, min(x) low, max(x) high FROM ({_P5_VALUES}) GROUP BY 1, 2, 3),
        u AS (SELECT *, sum(c) OVER w upto, sum(c) OVER (PARTITION BY attack, field_name) n FROM c WINDOW w AS (PARTITION BY attack, field_name ORDER BY cell ROWS UNBOUNDED PRECEDING))
        SELECT attack, field_name, p.p, low, high, n::BIGINT n FROM u JOIN (SELECT unnest({PERCENTILES})::DOUBLE p) p ON greatest(1, ceil(p.p * n)) BETWEEN upto - c + 1 AND upto""",
    "p9_found": """WITH w AS (SELECT DISTINCT doc_id, substr(text, i, 160) x FROM (SELECT doc_id, text, unnest(range(1, n_chars - 158)) i FROM documents WHERE n_chars >= 160)),
        h AS (SELECT md5(x) k, list(doc_id) ids FROM w GROUP BY x HAVING count(*) > 1), s AS (SELECT DISTINCT list_sort(ids) ids FROM h), e AS (SELECT ids, unnest(ids) a FROM s)
        SELECT DISTINCT a doc_a, b doc_b FROM (SELECT a, unnest(ids) b FROM e) WHERE a < b""",
}
