"""Streams give what a batch gives, in any arrival order the watermark allows."""

import random

import pytest
from pyspark.sql import functions as F

from flowmill.plans.stream_queries import run_to_end
from flowmill.streaming import detector

WIDTHS = (1_000, 5_000, 20_000)


def _flows():
    rng = random.Random(6)
    return [(i, rng.randrange(120_000), f"n{rng.randrange(6)}") for i in range(400)]


def _write(spark, path, data, batches):
    """One file per micro-batch, in time order across files."""
    order = sorted(data, key=lambda r: r[1])
    step = -(-len(order) // batches)
    for k in range(batches):
        part = order[k * step : (k + 1) * step]
        random.Random(k).shuffle(part)
        df = spark.createDataFrame(part, "flow_id bigint, ms bigint, src string").withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    schema = "flow_id bigint, ms bigint, src string, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 4])
def test_rates_equal_the_batch(spark, tmp_path, batches):
    data = _flows()
    _write(spark, str(tmp_path / "in"), data, batches)
    got = {r["flow_id"]: (r["n_short"], r["n_mid"], r["n_long"]) for r in run_to_end(detector.node_rates(_stream(spark, str(tmp_path / "in")), WIDTHS, "1 minute")).collect()}
    for i, t, s in data:
        # a record sees those before it in time; ties in other batches may come later
        times = [u for _, u, x in data if x == s and u <= t]
        assert got[i] == tuple(sum(u >= t - w for u in times) for w in WIDTHS)


def test_state_is_evicted(spark, tmp_path):
    data = [(i, i * 1_000, "only") for i in range(300)] + [(1000, 5, "silent")]
    _write(spark, str(tmp_path / "in"), data, 6)
    q = detector.node_rates(_stream(spark, str(tmp_path / "in")), WIDTHS, "1 second").writeStream.format("memory").queryName("evict").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    p = detector.progress(q)
    assert p["rows"] == 301 and p["state_rows"] == 1 and p["p99_ms"] >= p["p50_ms"] > 0


def test_out_of_order_batches_raise(spark):
    seen = []
    strict = detector.StrictOrder(lambda b, i: seen.append(i))
    frame = lambda *ms: spark.createDataFrame([(m,) for m in ms], "ms bigint")
    strict(frame(5, 1), 0)
    strict(frame(7, 6), 1)
    with pytest.raises(detector.OutOfOrder):
        strict(frame(3), 2)
    assert seen == [0, 1]
