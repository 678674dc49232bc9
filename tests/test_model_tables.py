"""Model queries on tables with untidy, unknown and missing labels."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.functions.text import label_key
from flowmill.plans import model_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def untidy(spark, tmp_path_factory):
    """The smallest tables, every third label respelled, every tenth null."""
    d = tmp_path_factory.mktemp("untidy")
    spelled = F.concat(F.upper(F.regexp_replace("canonical_label", "_", " ")), F.lit(" "))
    for n in ("train_features", "test_features"):
        t = spark.read.parquet(f"{DIR}/{n}.parquet")
        label = F.when(F.col("row_id") % 10 != 0, F.when(F.col("row_id") % 3 == 0, spelled).otherwise(F.col("canonical_label")))
        t.withColumn("canonical_label", label).write.parquet(f"{d}/{n}.parquet")
    spark.read.parquet(f"{DIR}/label_vocab.parquet").write.parquet(f"{d}/label_vocab.parquet")
    return str(d)


def test_untidy_labels_are_labels(spark, untidy):
    vocabulary = spark.read.parquet(f"{untidy}/label_vocab.parquet").select(label_key("canonical_label").alias("k")).distinct()
    for got, n in zip(model_queries._tables(spark, untidy), ("train_features", "test_features"), strict=True):
        named = spark.read.parquet(f"{untidy}/{n}.parquet").withColumn("k", label_key("canonical_label")).join(vocabulary, "k")
        assert sorted(r[0] for r in got.select("row_id").collect()) == sorted(r[0] for r in named.select("row_id").collect())
        assert named.filter("canonical_label LIKE '% '").count() > 0


def test_rows_without_label_have_a_score_and_count_as_pairs(spark, untidy):
    test = spark.read.parquet(f"{untidy}/test_features.parquet")
    q = entry.queries()
    assert sorted(r[0] for r in q["reconstruction_score"](spark, untidy).select("row_id").collect()) == sorted(r[0] for r in test.select("row_id").collect())
    assert q["identity_audit"](spark, untidy).first()["test_rows"] == test.na.drop(subset=["IPV4_SRC_ADDR", "IPV4_DST_ADDR"]).count()


def test_models_see_all_features(spark, monkeypatch):
    from flowmill.operators import baselines

    told = {}
    monkeypatch.setattr(baselines, "tabular", lambda kind, train, test, features, label, **more: told.update({kind: (features, more)}) or test.withColumn("predicted", F.col("y")))
    monkeypatch.setattr(baselines, "reconstruction_error", lambda train, test, features: told.update(pca=(features, {})) or test.withColumn("score", F.lit(0.0)))
    for n in ("baseline_forest", "baseline_extra_trees", "baseline_perceptron", "reconstruction_score"):
        entry.queries()[n](spark, DIR)
    assert [len(set(told[k][0])) for k in ("rf", "et", "mlp", "pca")] == [84] * 4
    assert told["rf"][1] == told["et"][1] == {"trees": 100} and told["mlp"][1] == {"hidden": (128, 64), "iterations": 200}
