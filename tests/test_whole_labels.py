"""Label queries over every writing of a label."""

import duckdb
import pytest
from pyspark.errors import PySparkException

import __spark_entry__ as entry
from flowmill.functions.text import label_key_sql
from flowmill.operators import clean
from flowmill.sources.tables import feature_columns, table

DIR = "/root/testdata/sf0.01"


def _sql(spark, name, sql):
    con = duckdb.connect()
    con.register(name, table(spark, DIR, name).toArrow())
    return con.sql(sql).fetchall()


def test_medians_of_all_features_and_writings(spark):
    names = feature_columns(table(spark, DIR, "train_features"))
    want = _sql(spark, "train_features", f"SELECT {', '.join(f'round(quantile_cont({c}, 0.5), 9)' for c in names)} FROM train_features WHERE {label_key_sql('canonical_label')} = 'benign'")[0]
    got = dict(tuple(r) for r in entry.queries()["class_medians"](spark, DIR).collect())
    assert len(got) == 84 and all(got[c] == pytest.approx(v, abs=1e-8) for c, v in zip(names, want, strict=True))


def test_strict_labels_of_every_row_that_names_a_class(spark):
    want = _sql(spark, "nf_bot_iot_v3", f"SELECT flow_id FROM nf_bot_iot_v3 WHERE {label_key_sql('Attack')} IN ('dos', 'ddos', 'reconnaissance', 'theft', 'benign')")
    q = entry.queries()
    got = [r["flow_id"] for r in q["canonical_labels_strict_all"](spark, DIR).collect()]
    assert sorted(got) == sorted(r[0] for r in want) and len(got) > q["canonical_labels_strict"](spark, DIR).count()


def test_unknown_labels_raise(spark):
    df = spark.createDataFrame([(1, " dDoS"), (2, "no such class")], "flow_id bigint, Attack string")
    vocab = table(spark, DIR, "label_vocab")
    assert clean.canonical_labels(df.filter("flow_id = 1"), vocab, "bot_iot", strict=True).first()["canonical_label"] == "ddos"
    with pytest.raises(PySparkException, match="label unknown"):
        clean.canonical_labels(df, vocab, "bot_iot", strict=True).collect()
