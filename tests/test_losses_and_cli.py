"""Special functions against known values; the command line end to end."""

import math

import pytest
from pyspark.sql import functions as F

from flowmill import cli
from flowmill.functions import vec
from flowmill.operators import losses


def _values(spark, make, xs):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(make(F.col("x"))).collect()]


def test_gamma_functions(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.3, 250.0]
    assert _values(spark, losses.lgamma, xs) == pytest.approx([math.lgamma(x) for x in xs], abs=1e-9)
    euler = 0.5772156649015329
    assert _values(spark, losses.digamma, [0.5, 1.0, 2.0, 3.0]) == pytest.approx([-euler - 2 * math.log(2), -euler, 1 - euler, 1.5 - euler], abs=1e-9)


def test_uniform_dirichlet_has_no_divergence(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0],), ([5.0, 1.0, 1.0],)], "a array<double>")
    kl = [r[0] for r in df.select(losses.dirichlet_kl(F.col("a"))).collect()]
    assert abs(kl[0]) < 1e-9 and kl[1] > 0.5


def test_evidence_for_the_truth_costs_less(spark):
    df = spark.createDataFrame([([3.0, -3.0, -3.0], 0), ([3.0, -3.0, -3.0], 1)], "e array<double>, y int")
    right, wrong = [r[0] for r in df.select(losses.evidential(F.col("e"), F.col("y"))).collect()]
    assert 0 < right < wrong


def test_norms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    r = df.select(vec.layer_norm(F.col("v")).alias("l"), vec.rms_norm(F.col("v")).alias("r"), vec.unit(F.col("v")).alias("u")).collect()
    assert sum(r[0]["l"]) == pytest.approx(0, abs=1e-9) and sum(x * x for x in r[0]["r"]) / 3 == pytest.approx(1, abs=1e-4)
    assert sum(x * x for x in r[0]["u"]) == pytest.approx(1) and r[1]["u"] == [0.0, 0.0, 0.0]


def test_stages_run_one_after_another(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{d}/nf_cicids2018_v3.parquet").filter("Attack IN ('Benign', 'Bot', 'FTP-BruteForce')")
    raw.withColumn("FLOW_START_MILLISECONDS", F.col("FLOW_START_MILLISECONDS") % 1000 + 1_500_000_000_000).write.parquet(str(tmp_path / "raw"))
    out = {n: str(tmp_path / n) for n in ("clean", "split", "features", "answer")}
    cli.main(["prepare", "--input", str(tmp_path / "raw"), "--vocabulary", f"{d}/label_vocab.parquet", "--dataset", "cicids2018", "--output", out["clean"]])
    cli.main(["split", "--input", out["clean"], "--output", out["split"]])
    cli.main(["--set", "features.quantiles=20", "features", "--input", out["split"], "--output", out["features"], "--state", str(tmp_path / "state.json")])
    cli.main(["query", "class_counts", "--tables", d, "--output", out["answer"]])
    n = spark.read.parquet(out["clean"]).count()
    made = spark.read.parquet(out["features"])
    assert made.count() == n and {r[0] for r in made.select("split").distinct().collect()} == {"train", "val", "test"}
    assert spark.read.parquet(out["answer"]).count() > 0
    with pytest.raises(KeyError):
        cli.main(["--set", "no.such=1", "query", "class_counts", "--tables", d, "--output", out["answer"]])
