"""The component table as it is kept and carried on."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.llm import grouped_splits, queries
from flowmill.plans.shared import keep, kept, versions

DIR = "/root/testdata/sf0.001"
SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}


def _inputs(spark, texts, lone):
    counts = spark.createDataFrame([(f"text {w}", a, "c", n) for w, a, n in texts], "node string, addr string, cls string, n bigint")
    return counts, spark.createDataFrame([(f"flow {i}", "c") for i in lone], "node string, cls string")


def test_known_nodes_keep_their_split_and_stand_once(spark):
    texts = [(f"t{i}", f"a{i}", 1 + i % 7) for i in range(40)]
    first = queries._table_of(*_inputs(spark, texts[:20], range(10)), SHARES)
    both = queries._table_of(*_inputs(spark, texts + [("t0 ", "a0", 2)], range(20)), SHARES, first)
    a, b = ({r["node"]: (r["component"], r["split"]) for r in t.collect()} for t in (first, both))
    assert set(Counter(r["node"] for r in both.collect()).values()) == {1}
    assert all(b[n] == v for n, v in a.items()) and b["text t0 "] == b["text t0"]
    assert {f"flow {i}" for i in range(20)} <= set(b) and all(s in SHARES for _, s in b.values())


def test_a_table_with_quarantine_can_be_carried_on(spark):
    old = spark.createDataFrame([("b", "b", "test"), ("d", "d", "val"), ("e", "e", "train")], "node string, component string, split string")
    links = lambda *x: spark.createDataFrame(x, "a string, b string")
    once = grouped_splits.extend_components(links(("b", "bad"), ("bad", "d")), old)
    twice = grouped_splits.extend_components(links(("bad", "more"), ("e", "new")), once).collect()
    got = {r["node"]: r["split"] for r in twice}
    assert len(twice) == len(got) == 6
    assert got == {"b": "test", "d": "val", "e": "train", "bad": "quarantine", "more": "quarantine", "new": "train"}


def test_versions_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert kept(spark, path) is None
    keep(spark.range(3), path)
    keep(spark.range(5), path)
    assert versions(spark, path) == [1, 2] and kept(spark, path).count() == 5 and kept(spark, path, 1).count() == 3


def test_query_carries_on_the_table_of_the_first_part(spark):
    run = entry.queries()["p6_extended"]
    got = {r["flow_id"]: (r["component"], r["split"]) for r in run(spark, DIR).collect()}
    ids = [r[0] for r in spark.read.parquet(f"{DIR}/nf_cicids2018_v3.parquet").select("flow_id").collect()]
    assert sorted(got) == sorted(ids)
    path = queries.component_path(spark, DIR)
    first, whole = (kept(spark, path, v).select("node", F.col("split").alias(f"s{v}")) for v in (1, 2))
    assert 0 < first.count() < whole.count() and first.join(whole, "node").filter("s1 = s2").count() == first.count()
    assert {r["flow_id"]: (r["component"], r["split"]) for r in run(spark, DIR).collect()} == got
