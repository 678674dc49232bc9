"""Training by full gradient steps over a DataFrame, with early stopping and
checkpoints.

Parameters are small (bounded by classes and widths, never by rows). An epoch is
one pass: every batch adds its gradient to that of its partition, partitions are
summed entry by entry in the cluster, and one row per entry reaches the driver,
which takes the step (Adam). Validation rows go through the same pass. A run
under ``path`` writes a checkpoint per epoch and goes on after the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.sources.io import load_checkpoint, save_checkpoint

Loss = Callable[[dict, np.ndarray, np.ndarray], tuple[float, dict]]


@dataclass
class Fit:
    """Parameters of the best epoch, and the losses of all."""

    parameters: dict
    history: list[dict] = field(default_factory=list)
    best: int = 0
    stopped: bool = False


def _pass(df: DataFrame, parameters: dict, loss: Loss) -> tuple[dict, list[float]]:
    """Gradient over the training rows, and sums and numbers of both losses."""
    names, shapes = list(parameters), {n: p.shape for n, p in parameters.items()}
    total = sum(p.size for p in parameters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, told = np.zeros(total), np.zeros(4)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, held = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for part, mask in ((0, ~held), (2, held)):
                if mask.any():
                    value, g = loss(parameters, x[mask], y[mask])
                    told[part] += value
                    told[part + 1] += mask.sum()
                    if part == 0:
                        grad += np.concatenate([g[n].ravel() for n in names])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total + 4, dtype=np.int32)), pa.array(np.concatenate([grad, told]))], ["i", "v"])

    sums = {r["i"]: r["v"] for r in df.select("x", "y", "held").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat, at, grads = np.array([sums.get(i, 0.0) for i in range(total + 4)]), 0, {}
    for n in names:
        size = int(np.prod(shapes[n]))
        grads[n] = flat[at : at + size].reshape(shapes[n])
        at += size
    return grads, list(flat[total:])


def descend(train: DataFrame, val: DataFrame, x: Column, y: Column, parameters: dict, loss: Loss, epochs: int = 20, rate: float = 0.05, patience: int = 5, least_gain: float = 1e-5, path: str | None = None) -> Fit:
    """Fits ``parameters`` (named arrays) to ``loss(parameters, X, y) -> (sum of
    losses, gradients of the sum)``; stops after ``patience`` epochs without a
    better validation loss. Rows whose vector or target is null are left out."""
    spark = train.sparkSession
    pick = lambda d, held: d.select(F.transform(x, lambda v: v.cast("double")).alias("x"), y.cast("double").alias("y"), F.lit(held).alias("held")).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = pick(train, False).unionByName(pick(val, True))
    p = {n: np.array(v, dtype=float) for n, v in parameters.items()}
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in p.items()}
    fit, lowest, begin = Fit(dict(p)), float("inf"), 0
    if path and (saved := load_checkpoint(spark, path)):
        begin, held = saved["epoch"] + 1, saved["parameters"]
        p = {n: held[n] for n in p}
        moments = {n: (held[f"{n}.m"], held[f"{n}.v"]) for n in p}
        fit = Fit({n: held[f"{n}.best"] for n in p}, saved["facts"]["history"], saved["facts"]["best"], saved["facts"]["stopped"])
        lowest = saved["facts"]["lowest"]
    for epoch in range(begin, epochs):
        if fit.stopped:
            break
        grads, (a, n, va, vn) = _pass(rows, p, loss)
        here = {"epoch": epoch, "train_loss": float(a / max(n, 1)), "val_loss": float(va / vn if vn else a / max(n, 1))}
        fit.history.append(here)
        if here["val_loss"] < lowest - least_gain:
            lowest, fit.best, fit.parameters = here["val_loss"], epoch, {k: v.copy() for k, v in p.items()}
        fit.stopped = epoch - fit.best >= patience
        for k in p:
            g = grads[k] / max(n, 1)
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = m, v
            p[k] = p[k] - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        if path:
            state = p | {f"{k}.m": moments[k][0] for k in p} | {f"{k}.v": moments[k][1] for k in p} | {f"{k}.best": fit.parameters[k] for k in p}
            save_checkpoint(spark, path, epoch, state, {"history": fit.history, "best": fit.best, "stopped": bool(fit.stopped), "lowest": float(lowest)})
    return fit


def am_softmax_loss(scale: float = 10.0, margin: float = 0.2) -> Loss:
    """Additive-margin softmax over cosines to the rows of ``w`` (classes x size)."""

    def loss(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        w, at = p["w"], y.astype(int)
        wn, xn = np.linalg.norm(w, axis=1, keepdims=True) + 1e-12, np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        unit, z = w / wn, x / xn
        cos = z @ unit.T
        logits = scale * cos
        logits[np.arange(len(x)), at] -= scale * margin
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        value = -np.log(q[np.arange(len(x)), at] + 1e-300).sum()
        q[np.arange(len(x)), at] -= 1
        d = scale * (q.T @ z)  # by the unit rows
        return float(value), {"w": (d - (d * unit).sum(axis=1, keepdims=True) * unit) / wn}

    return loss


def fit_head(train: DataFrame, val: DataFrame, vector: str, label: str, classes: int, size: int, seed: int = 0, **settings) -> Fit:
    """A prototype per class, learned (labels are 0 .. classes - 1)."""
    start = np.random.default_rng(seed).normal(size=(classes, size))
    return descend(train, val, F.col(vector), F.col(label), {"w": start}, am_softmax_loss(), **settings)


def autoencoder_loss(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Squared error of ``tanh(x a + b) c + d`` against x, mean over entries."""
    h = np.tanh(x @ p["a"] + p["b"])
    e = h @ p["c"] + p["d"] - x
    g = 2 * e / x.shape[1]
    back = (g @ p["c"].T) * (1 - h * h)
    return float((e * e).mean(axis=1).sum()), {"a": x.T @ back, "b": back.sum(axis=0), "c": h.T @ g, "d": g.sum(axis=0)}


def fit_autoencoder(train: DataFrame, val: DataFrame, vector: Column, size: int, hidden: int = 16, seed: int = 0, **settings) -> Fit:
    """One tanh layer down to ``hidden`` entries and back."""
    r = np.random.default_rng(seed)
    start = {"a": r.normal(size=(size, hidden)) / np.sqrt(size), "b": np.zeros(hidden), "c": r.normal(size=(hidden, size)) / np.sqrt(hidden), "d": np.zeros(size)}
    return descend(train, val, vector, F.lit(0.0), start, autoencoder_loss, **settings)


def reconstruction_error(vector: Column, fit: Fit) -> Column:
    """Mean squared error of a vector's reconstruction, in Arrow batches."""
    p = fit.parameters

    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        e = np.tanh(x @ p["a"] + p["b"]) @ p["c"] + p["d"] - x
        return pd.Series((e * e).mean(axis=1))

    return F.pandas_udf(run, "double")(F.transform(vector, lambda x: x.cast("double")))
