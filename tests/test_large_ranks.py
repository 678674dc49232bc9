"""Draws and weights beyond 1,000,003 rows."""

from pyspark.sql import functions as F

from flowmill.operators import metrics, splits


def test_draws_reach_every_part_of_a_large_table(spark):
    n = 3_000_009
    got = [r["id"] for r in splits.redraw(spark.range(n), 300, "id", 4).collect()]
    assert len(got) == 300 and all(60 < sum(k * n / 3 <= i < (k + 1) * n / 3 for i in got) < 140 for k in range(3))


def test_keys_beyond_the_modulus_have_their_own_weights(spark):
    weights = lambda k: [r["n"] for r in metrics.bootstrap_means(spark.createDataFrame([(k, 1.0)], "k bigint, v double"), {"v": F.col("v")}, "k", 200).orderBy("resample").collect()]
    a, b, c = (weights(7 + i * 1_000_003) for i in (0, 1, 2))
    assert a != b and b != c and all(0.7 < sum(x) / 200 < 1.3 for x in (a, b, c))
