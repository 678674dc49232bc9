"""Attribution queries use every entry of the vectors and every class."""

import numpy as np
import pytest

import __spark_entry__ as entry
from flowmill.plans import eval_queries as ev

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["vec_id"]: np.array(r["z"], dtype=float) for r in ev._emb(spark, DIR).collect()}


@pytest.fixture(scope="module")
def protos(spark):
    return {r["class_id"]: np.array(r["proto"], dtype=float) for r in ev._bank(ev._emb(spark, DIR)).collect()}


def test_kernel_shap_covers_all_entries(spark, vectors, protos):
    score = lambda v: v @ protos[0] / np.linalg.norm(v)
    base = score(np.full(ev.DIM, 0.05))
    got = {r["vec_id"]: r["total"] for r in entry.queries()["kernel_shap"](spark, DIR).collect()}
    assert set(got) == set(vectors)
    assert all(abs(got[i] - (score(z) - base)) < 1e-3 for i, z in vectors.items())


def test_integrated_gradients_run_fifty_steps(spark, vectors, protos):
    got = {r["vec_id"]: r["attributed"] for r in entry.queries()["integrated_gradients"](spark, DIR).collect()}
    predicted = {r["vec_id"]: r["predicted"] for r in ev._own(spark, DIR).select("vec_id", "predicted").collect()}
    assert set(got) == set(vectors)
    for i, z in vectors.items():
        p = protos[predicted[i]]
        base, total = p * 0.5 + 0.01, 0.0
        for k in range(50):
            x = base + (z - base) * ((k + 0.5) / 50)
            n = np.linalg.norm(x)
            total += (z - base) @ ((p / n - (x @ p) * x / n**3) / ev.TAU) / 50
        assert abs(got[i] - total) < 1e-9


def test_stability_compares_all_known_classes(spark, vectors, protos):
    import pandas as pd

    got = {r["vec_id"]: r["stability"] for r in entry.queries()["stability_spearman_known"](spark, DIR).collect()}
    assert set(got) == set(vectors)
    for i, z in list(vectors.items())[:5]:
        ranks = pd.DataFrame({c: np.round(z * protos[c] / ev.TAU, 9) for c in range(ev.KNOWN)}).rank()
        rho = np.corrcoef(ranks.to_numpy().T)
        assert abs(got[i] - rho[np.triu_indices(ev.KNOWN, 1)].mean()) < 1e-5
