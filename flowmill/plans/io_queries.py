"""Sources and sinks: each query writes a table, reads it back and returns it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.plans.shared import new_path
from flowmill.sources import io
from flowmill.sources.tables import table



def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Flows through CSV: names from the header, declared types."""
    path = new_path(spark, "csv")
    t = table(spark, d, "nf_unsw_nb15_v3").select("L4_DST_PORT", "FLOW_START_MILLISECONDS", "IN_BYTES", "Label")
    t.write.option("header", True).csv(path)
    return io.read_flows_csv(spark, path).groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.min("FLOW_START_MILLISECONDS").alias("first_ms"), F.max("L4_DST_PORT").alias("top_port"), F.count("IN_BYTES").alias("known_bytes"))


def parquet_projection(spark: SparkSession, d: str) -> DataFrame:
    return io.read_parquet(spark, f"{d}/nf_unsw_nb15_v3.parquet", ["flow_id", "Attack"])


def parquet_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """A table partitioned by label; a filter on it prunes folders."""
    path = new_path(spark, "partitioned")
    io.write_parquet(table(spark, d, "nf_unsw_nb15_v3").select("flow_id", "Attack", "Label"), path, ["Label"])
    return io.read_parquet(spark, path).filter("Label = 1").select("flow_id", "Attack")


def report_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Per-dataset counts as a nested JSON report, flattened to a row each."""
    v = table(spark, d, "label_vocab").groupBy("dataset", "family").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = v.groupBy("dataset").agg(F.struct(F.avg("n").alias("macro_f1"), F.map_from_entries(F.collect_list(F.struct("family", "n"))).alias("per_class")).alias("r"))
    text = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "r")))).alias("report"))
    return io.flatten_models(text, "report", ["benign", "other", "dos"])


def registry_skip(spark: SparkSession, d: str) -> DataFrame:
    """Planned runs (orders) less the completed ones (orders with status F)."""
    o = table(spark, d, "orders")
    return io.pending_runs(o.select(F.col("o_orderkey").alias("run_id")), o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")))


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, some broken, read back."""
    path = new_path(spark, "log")
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "{broken").otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    e.write.text(path)
    return io.read_events(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def vectors_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written and read again: length and sum of each."""
    path = new_path(spark, "vectors")
    io.write_vectors(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), path)
    v = io.read_vectors(spark, path)
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows per family as one CSV file, read back."""
    path = new_path(spark, "report")
    io.write_csv(table(spark, d, "label_vocab").groupBy("dataset", "family").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("dataset string, family string, n bigint").csv(path)


def json_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows per class as a JSON report, saved, loaded and read by dotted names."""
    path = f"{new_path(spark, 'report')}.json"
    counts = table(spark, d, "nf_unsw_nb15_v3").groupBy("Label").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows
    io.save_json(io.assemble_report(classes={str(r["Label"]): {"n": r["n"], "none": float("nan")} for r in counts}, absent=None), path)
    r = io.load_json(path)
    return spark.createDataFrame([(k, io.nested(r, f"classes.{k}.n"), io.nested(r, f"classes.{k}.none", "null")) for k in r["classes"]], "label string, n bigint, none string")


def checkpoint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Class means saved as a model's state in two versions, the newest read back."""
    import numpy as np

    path, rng = new_path(spark, "checkpoint"), np.random.default_rng(1)
    means = {str(r["label"]): np.array([r["a"], r["b"]]) for r in table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0]).alias("a"), F.avg(F.col("embedding")[1]).alias("b")).collect()}  # one row per class
    for epoch in (1, 2):
        io.save_checkpoint(spark, path, epoch, {k: v * epoch for k, v in means.items()}, {"epoch": epoch}, rng)
    got = io.load_checkpoint(spark, path)
    return spark.createDataFrame([(int(k), got["epoch"], round(float(v[0]), 6), round(float(v[1]), 6)) for k, v in got["parameters"].items()], "label int, epoch int, first double, second double")


def pipeline_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A fitted pipeline saved, loaded and applied: rows whose features changed by it."""
    from flowmill.operators.features import FeaturePipeline

    t, path = table(spark, d, "nf_unsw_nb15_v3"), f"{new_path(spark, 'pipeline')}.json"
    p = FeaturePipeline().fit(t)
    p.save(path)
    a, b = (x.transform(t, ["flow_id"]) for x in (p, FeaturePipeline.load(path)))
    names = [c for c in a.columns if c != "flow_id"]
    h = lambda df, n: df.select("flow_id", F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias(n))
    return h(a, "x").join(h(b, "y"), "flow_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("x") != F.col("y")).cast("bigint")).alias("changed"))


QUERIES = {f.__name__: f for f in (csv_scan, parquet_projection, parquet_partitioned, report_flatten, registry_skip, json_paths, event_log, vectors_roundtrip, csv_report, json_report, checkpoint_roundtrip, pipeline_roundtrip)}

SQL = {
    "vectors_roundtrip": "SELECT vec_id, len(embedding) n, round(list_sum(embedding::DOUBLE[]), 6) total FROM embeddings",
    "csv_report": "SELECT dataset, family, count(*) n FROM label_vocab GROUP BY 1, 2",
    "json_report": "SELECT coalesce(Label::VARCHAR, 'None') AS label, count(*) n, NULL::VARCHAR AS none FROM nf_unsw_nb15_v3 GROUP BY 1",
    "checkpoint_roundtrip": "SELECT label, 2 epoch, round(2 * avg(embedding[1]::DOUBLE), 6) AS first, round(2 * avg(embedding[2]::DOUBLE), 6) AS second FROM embeddings GROUP BY 1",
    "pipeline_roundtrip": "SELECT count(*) n_rows, 0::BIGINT changed FROM nf_unsw_nb15_v3",
    "csv_scan": "SELECT Label, count(*) n, min(FLOW_START_MILLISECONDS) first_ms, max(L4_DST_PORT) top_port, count(IN_BYTES) known_bytes FROM nf_unsw_nb15_v3 GROUP BY 1",
    "parquet_projection": "SELECT flow_id, Attack FROM nf_unsw_nb15_v3",
    "parquet_partitioned": "SELECT flow_id, Attack FROM nf_unsw_nb15_v3 WHERE Label = 1",
    "report_flatten": """WITH v AS (SELECT dataset, family, count(*)::DOUBLE n FROM label_vocab GROUP BY 1, 2) SELECT dataset model, avg(n) macro_f1, max(n) FILTER (family = 'benign') f1_benign, max(n) FILTER (family = 'other') f1_other, max(n) FILTER (family = 'dos') f1_dos FROM v GROUP BY 1""",
    "registry_skip": "SELECT o_orderkey run_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "json_paths": "SELECT json_extract_string(props, '$.k') k, count(*) n FROM events GROUP BY 1",
    "event_log": "SELECT event_type, count(*) n FROM events WHERE event_type <> 'error' GROUP BY 1",
}
