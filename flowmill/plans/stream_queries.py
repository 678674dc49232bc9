"""Streaming: each query runs a stream over the whole table to its end and
returns what the sink holds; the SQL says what a batch would have given."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.text import ipv4, measure
from flowmill.operators import encoder, prototypes
from flowmill.plans import flow_queries
from flowmill.plans.eval_queries import _chain
from flowmill.plans.graph_queries import EV, H
from flowmill.plans.shared import new_path
from flowmill.sources.tables import table
from flowmill.streaming import detector


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    static = table(spark, d, name)
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(path) if _folder(spark, path) else spark.readStream.schema(static.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(df: DataFrame, schema: str | None = None) -> DataFrame:
    """Runs a stream over all input there is into a table in the shared folder."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    out = new_path(spark, f"sink-{name}")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, f"stream-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return _source(spark, d, "events").select(F.col("event_id").alias("flow_id"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"))


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    bank = prototypes.class_means(e.filter("label < 8"), "label", "embedding", 64)
    v = detector.verdicts(_source(spark, d, "embeddings"), bank, "embedding", 0.05, 0.0005)
    return run_to_end(v.select("vec_id", "predicted", "decision", F.round(F.round("evidence_total", 9), 6).alias("evidence")))


def stream_node_rates(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(detector.node_rates(_events(spark, d).select("flow_id", "src", "ms", "ts"), (H, 6 * H, 24 * H), "1 hour")).drop("ms")


def stream_bins(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour and type of all bins the watermark has closed."""
    b = run_to_end(detector.binned_counts(_events(spark, d), "ts", "dst", "1 hour", "1 hour"))
    return b.select(F.unix_millis("start").alias("start_ms"), "dst", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = run_to_end(detector.session_counts(_events(spark, d), "ts", "src", "1 hour", "1 hour"))
    return s.groupBy("src").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n"))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """The raw flows that are edges, as a stream in order of arrival, late ones too."""
    t = _source(spark, d, flow_queries.FLOWS).filter(F.col("FLOW_START_MILLISECONDS").between(flow_queries.LOW, flow_queries.HIGH))
    out = t.select("flow_id", F.col("FLOW_START_MILLISECONDS").alias("ms"), ipv4("IPV4_SRC_ADDR").alias("src"), ipv4("IPV4_DST_ADDR").alias("dst"), F.coalesce(measure("IN_BYTES"), F.lit(0.0)).alias("bytes"), F.coalesce(F.col("L4_DST_PORT"), F.lit(0)).alias("port"))
    return out.filter("src IS NOT NULL AND dst IS NOT NULL").withColumn("ts", F.timestamp_millis("ms"))


def stream_flow_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flows of each source in the 1, 30 and 300 s before each of its flows."""
    return run_to_end(detector.node_rates(_flows(spark, d).select("flow_id", "src", "ms", "ts"))).drop("ms")


def stream_memory(spark: SparkSession, d: str) -> DataFrame:
    """The memory of each flow's source after it; sources silent for 600 s are forgotten."""
    gates = {g: encoder.given(2, 4, f"gru.{g}") for g in "zrn"}
    x = F.array(F.log1p("bytes") / 10, F.col("port").cast("double") / 65535)
    m = run_to_end(detector.node_memories(_flows(spark, d).select("flow_id", "src", "ms", "ts", x.alias("x")), gates, 2))
    return m.select("flow_id", "src", *[F.round(F.col("memory")[i], 6).alias(f"m{i}") for i in range(2)])


def stream_live(spark: SparkSession, d: str) -> DataFrame:
    """A stream scored by a bank that grows: all rows before and after class 8 is
    registered on the running detector."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("z"))
    live = detector.LiveDetector(spark, new_path(spark, "bank"), "z", 64, theta_unknown=0.05, theta_defer=0.0005)
    live.start(prototypes.class_means(e.filter("y < 8"), "y", "z", 64))
    parts = []
    for step in (0, 1):
        out = new_path(spark, "live")
        stream = _source(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("z"))
        q = stream.writeStream.foreachBatch(live.to(out, ["vec_id", "decision"])).option("checkpointLocation", new_path(spark, "live-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        parts.append(spark.read.schema("vec_id bigint, decision int, batch int").parquet(out).select(F.lit(step).alias("registered"), "vec_id", "decision"))
        if step == 0:
            live.register(e.filter("y = 8"), 8)
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (stream_verdicts, stream_node_rates, stream_bins, stream_sessions, stream_flow_rates, stream_memory, stream_live)}


def _verdict_sql() -> str:
    from flowmill.plans.eval_queries import SQL as E

    return f"SELECT vec_id, predicted, decision, evidence FROM ({E['evidence_verdict']})"


_live = lambda step, known: f"SELECT {step} registered, vec_id, decision FROM (WITH {_chain(known)} SELECT vec_id, decision FROM sc)"
SQL = {
    "stream_live": f"{_live(0, 8)} UNION ALL {_live(1, 9)}",
    "stream_flow_rates": flow_queries.SQL["flow_history"].replace("SELECT flow_id, count", "SELECT flow_id, src, count"),
    "stream_verdicts": _verdict_sql(),
    "stream_node_rates": f"WITH {EV} SELECT flow_id, src::VARCHAR src, " + ", ".join(f"count(*) OVER (PARTITION BY src ORDER BY ms RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) n_{s}" for s, w in (("short", H), ("mid", 6 * H), ("long", 24 * H))) + " FROM ev",
    "stream_bins": f"WITH {EV} SELECT ms // {H} * {H} start_ms, dst, count(*) n FROM ev GROUP BY 1, 2 HAVING ms // {H} * {H} + {H} <= (SELECT max(ms) FROM ev) - {H}",
}
