"""The detector as a Structured Streaming query with bounded state.

``verdicts`` scores every record of a stream by evidence against a prototype
bank (a projection: no state, no shuffle). ``node_rates`` keeps, per source,
the times of the last ``long_ms`` in keyed state and emits for every record how
many of its source's records lie in each window; state older than the long
window is evicted as the watermark moves, and sources that fall silent are
dropped by an event-time timer. ``binned_counts`` counts per tumbling bin.
Batch and stream give the same rows for the same records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowmill.operators import prototypes
from flowmill.plans.shared import keep, kept

RATES = "flow_id bigint, src string, ms bigint, n_short bigint, n_mid bigint, n_long bigint"


def verdicts(stream: DataFrame, bank: DataFrame, vector: str, theta_unknown: float = 0.5, theta_defer: float = 0.1, margin: float = 0.2, tau: float = 0.1) -> DataFrame:
    """One verdict per record: ``decision, predicted, evidence_total, vacuity,
    gap`` beside the record's own columns."""
    packed = bank.select("class_id", "sub_id", "proto").collect() if bank.limit(prototypes.MAX_BANK + 1).count() <= prototypes.MAX_BANK else None
    if packed is None:
        raise ValueError(f"a bank may hold at most {prototypes.MAX_BANK} prototypes")
    from flowmill.functions import vec

    classes = sorted({r["class_id"] for r in packed})
    # a stream cannot hold a scalar subquery of a batch table: the bank is a literal
    subs = F.lit([[list(map(float, r["proto"])) for r in packed if r["class_id"] == c] for c in classes])
    score = lambda t, p: F.coalesce(F.try_divide(vec.dot(t["z"], p), t["n"]), F.lit(0.0))
    cos = vec.let(F.struct(F.col(vector).alias("z"), vec.norm(F.col(vector)).alias("n")), lambda t: F.transform(subs, lambda c: F.array_max(F.transform(c, lambda p: score(t, p)))))
    scored = stream.withColumns({"classes": F.lit(classes), "cos": cos})
    return prototypes.decide(prototypes.evidence(scored, margin, tau), theta_unknown, theta_defer).drop("classes", "cos", "log_e", "strength", "p")


def binned_counts(stream: DataFrame, time: str, key: str, width: str = "1 second", lateness: str = "5 minutes") -> DataFrame:
    """Records per (tumbling bin, key); bins are closed by the watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str, lateness: str = "5 minutes") -> DataFrame:
    """Records per session of a key (a gap closes it)."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def _rates(widths: tuple[int, int, int]):
    long = widths[2]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, held = (np.array(x, dtype=np.int64) for x in (state.get if state.exists else ([], [])))
        new = pd.concat(list(batches)).sort_values(["ms", "flow_id"], kind="stable")
        times = new["ms"].to_numpy(dtype=np.int64)
        at, where = np.unique(np.concatenate([kept, times]), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([held, np.ones(len(times))])).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        upto = total[np.searchsorted(at, times, side="right")]
        out = {"flow_id": new["flow_id"].to_numpy(), "src": str(key[0]), "ms": times}
        for name, w in zip(("n_short", "n_mid", "n_long"), widths, strict=True):
            out[name] = upto - total[np.searchsorted(at, times - w, side="left")]
        last = int(at[-1])
        recent = at >= last - long
        state.update((at[recent].tolist(), count[recent].tolist()))
        if state.getCurrentWatermarkMs() < last + long:
            state.setTimeoutTimestamp(last + long)
        yield pd.DataFrame(out)

    return step


def node_rates(stream: DataFrame, widths: tuple[int, int, int] = (1_000, 30_000, 300_000), lateness: str = "5 minutes") -> DataFrame:
    """``flow_id, src, ms, n_short, n_mid, n_long`` of every record of a stream
    ``flow_id, src, ms, ts`` (ts a TIMESTAMP of ms).

    A source's records are taken in time order within a micro-batch. State holds
    the distinct times of one long window per source with their counts: at most
    one entry per millisecond, however many records there are.
    """
    keyed = stream.withWatermark("ts", lateness).withColumn("src", F.col("src").cast("string"))
    return keyed.groupBy("src").applyInPandasWithState(_rates(widths), RATES, "times array<bigint>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


class LiveDetector:
    """A detector whose bank can grow while its stream runs.

    The bank is a table kept in versions under ``path``. Every micro-batch is
    scored by the version that is newest when it starts (a join of the stream
    with a static table, inside ``foreachBatch``); :meth:`register` appends a class as the
    next version, so old classes keep their rows and their scores.
    """

    def __init__(self, spark: SparkSession, path: str, vector: str, size: int, **head):
        self.spark, self.path, self.vector, self.size, self.head = spark, path, vector, size, head

    def start(self, bank: DataFrame) -> None:
        """Keeps the first version, if there is none yet."""
        if kept(self.spark, self.path) is None:
            keep(prototypes.check_bank(bank.select("class_id", "sub_id", "proto", "trained")), self.path)

    def register(self, samples: DataFrame, class_id: int, n_sub: int = 1) -> None:
        keep(prototypes.register_class(kept(self.spark, self.path), samples, self.vector, class_id, self.size, n_sub), self.path)

    def score(self, batch: DataFrame) -> DataFrame:
        margin, tau = self.head.get("margin", 0.2), self.head.get("tau", 0.1)
        scored = prototypes.evidence(prototypes.cosines(batch, kept(self.spark, self.path), self.vector), margin, tau)
        return prototypes.decide(scored, self.head.get("theta_unknown", 0.5), self.head.get("theta_defer", 0.1))

    def to(self, out: str, columns: list[str]):
        """For ``foreachBatch``: scores a batch and writes it under its number, so
        a batch that runs again replaces itself."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.score(batch).select(*columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        return write


def _memory(gates: dict, size: int, forget_ms: int):
    z, r, n = (np.array(gates[k], dtype=float) for k in "zrn")
    squash = lambda v: 1 / (1 + np.exp(-v))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, h = state.get if state.exists else (None, [0.0] * size)
        h = np.array(h)
        new = pd.concat(list(batches)).sort_values(["ms", "flow_id"], kind="stable")
        out = []
        for at, x in zip(new["ms"], new["x"], strict=True):
            if last is not None and at - last > forget_ms:
                h = np.zeros(size)
            xh = np.concatenate([x, h])
            gz, gr = squash(z @ xh), squash(r @ xh)
            h = (1 - gz) * np.tanh(n @ np.concatenate([x, gr * h])) + gz * h
            last = int(at)
            out.append(h.tolist())
        state.update((last, h.tolist()))
        if state.getCurrentWatermarkMs() < last + forget_ms:
            state.setTimeoutTimestamp(last + forget_ms)
        yield pd.DataFrame({"flow_id": new["flow_id"].to_numpy(), "src": str(key[0]), "memory": out})

    return step


def node_memories(stream: DataFrame, gates: dict[str, list[list[float]]], size: int, forget_ms: int = 600_000, lateness: str = "5 minutes") -> DataFrame:
    """``flow_id, src, memory``: the gated memory of a record's source after it, of
    a stream ``flow_id, src, ms, ts, x`` (x an array).

    State is one vector per source that was active within ``forget_ms``; an
    event-time timer evicts the others. Records are taken in time order within
    a micro-batch.
    """
    keyed = stream.withWatermark("ts", lateness).withColumn("src", F.col("src").cast("string"))
    return keyed.groupBy("src").applyInPandasWithState(_memory(gates, size, forget_ms), "flow_id bigint, src string, memory array<double>", "last bigint, memory array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class OutOfOrder(ValueError):
    """A micro-batch holds records older than ones already taken."""


class StrictOrder:
    """For ``foreachBatch``: hands each batch on, or raises :class:`OutOfOrder`
    if it starts before the last one ended."""

    def __init__(self, handle, time: str = "ms"):
        self.handle, self.time, self.last = handle, time, None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        low, high = batch.agg(F.min(self.time), F.max(self.time)).first()
        if low is not None:
            if self.last is not None and low < self.last:
                raise OutOfOrder(f"batch {batch_id} starts at {low}, after {self.last}")
            self.last = high
        self.handle(batch, batch_id)


def footprint(spark: SparkSession, bank: DataFrame, query=None) -> dict:
    """Bytes the driver's JVM uses, numbers in the model, and rows and bytes of state."""
    r = spark._jvm.java.lang.Runtime.getRuntime()
    size = bank.agg(F.coalesce(F.sum(F.size("proto")), F.lit(0)).alias("n")).first()["n"]
    ops = query.lastProgress["stateOperators"] if query is not None and query.lastProgress else []
    return {"jvm_bytes": int(r.totalMemory() - r.freeMemory()), "parameters": int(size), "state_rows": sum(o["numRowsTotal"] for o in ops), "state_bytes": sum(o["memoryUsedBytes"] for o in ops)}


def progress(query) -> dict:
    """Rows per second, state rows, and latency percentiles of a query's
    micro-batches (whole batches, sink included)."""
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    took = np.array([p["durationMs"].get("triggerExecution", 0) for p in steps] or [0.0])
    rows = sum(p["numInputRows"] for p in steps)
    q = {f"p{int(k)}_ms": float(np.percentile(took, k)) for k in (50, 90, 95, 99)}
    state = sum(s["numRowsTotal"] for s in steps[-1]["stateOperators"]) if steps else 0
    return {"batches": len(steps), "rows": rows, "rows_per_s": rows / max(took.sum() / 1000, 1e-9), "state_rows": state, "mean_ms": float(took.mean()), "max_ms": float(took.max()), **q}
