"""The registered feature queries fit as many quantiles as the operator's default."""

import __spark_entry__ as entry
from flowmill.operators import features

DIR = "/root/testdata/sf0.001"


def test_feature_queries_ask_for_a_thousand_quantiles(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(features, "knots_fit", lambda df, cols, n=1000, shape=None: asked.append(n) or {c: [0.0, 1.0] for c in cols})
    for name in ("quantile_knots", "te1_conditioned", "feature_pipeline"):
        entry.queries()[name](spark, DIR)
    assert asked and set(asked) == {1000}
