"""Files in and out: CSV and Parquet scans, JSON reports, registries, events."""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill import schema
from flowmill.plans.shared import exists, keep, kept, read_text, write_text

#: File names of the raw datasets.
DISPLAY = {"cicids2018": "NF-CICIDS2018-v3", "ton_iot": "NF-ToN-IoT-v3", "unsw_nb15": "NF-UNSW-NB15-v3", "bot_iot": "NF-BoT-IoT-v3"}


def dataset_file(dataset: str) -> str:
    if dataset not in DISPLAY:
        raise ValueError(f"unknown dataset {dataset!r}")
    return f"{DISPLAY[dataset]}.csv"


def read_flows_csv(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Raw flows from CSV by header name (any column order), declared types, bad
    values as null. Splits of large files are Spark's; ``n`` limits rows."""
    with_header = spark.read.option("header", True).csv(path, schema=None).columns
    types = {f.name: f.dataType for f in schema.FLOW_SCHEMA}
    declared = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in with_header])
    df = spark.read.schema(declared).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df if n is None else df.limit(n)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; with ``columns`` only those are read. A missing path raises."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A Parquet table, by (dataset, split) or the like if asked. Rows are not
    gathered: each task writes its own files."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 64) -> None:
    """A bucketed table: later joins and folds on the keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_vectors(df: DataFrame, path: str) -> None:
    """Arrays of doubles as Parquet (tensors and matrices, one row per vector)."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header. For reports only: one task writes."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if hasattr(x, "asDict"):
        return _plain(x.asDict(True))
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def save_json(value: Any, path: str) -> None:
    """Rows, arrays and the like become plain JSON; NaN and infinities null.
    Written through the session's file systems, so a shared folder will do."""
    write_text(SparkSession.active(), path, json.dumps(_plain(value), indent=2))


def load_json(path: str) -> Any:
    return json.loads(read_text(SparkSession.active(), path))


def save_checkpoint(spark: SparkSession, path: str, epoch: int, parameters: dict, facts: dict | None = None, rng: Any = None) -> None:
    """A model's state as the next version under ``path``: parameters (arrays of
    any shape) as a table, the rest (epoch, facts, generator state) as JSON."""
    rows = [(n, [int(k) for k in v.shape], [float(x) for x in v.ravel()]) for n, v in ((n, np.asarray(v, dtype=float)) for n, v in parameters.items())]
    told = json.dumps({"epoch": epoch, "facts": _plain(facts or {}), "rng": rng.bit_generator.state if rng is not None else None})
    rows.append(("", [], []))
    keep(spark.createDataFrame(rows, "name string, shape array<int>, x array<double>").withColumn("state", F.when(F.col("name") == "", F.lit(told))).coalesce(1), path)


def load_checkpoint(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest (or given) version as ``epoch, parameters, facts, rng`` (a
    generator that goes on where the saved one was); None if there is none."""
    df = kept(spark, path, version)
    if df is None:
        return None
    rows = df.collect()  # one row per parameter
    told = json.loads(next(r["state"] for r in rows if r["name"] == ""))
    rng = None
    if told["rng"] is not None:
        rng = np.random.default_rng()
        rng.bit_generator.state = told["rng"]
    return {"epoch": told["epoch"], "facts": told["facts"], "rng": rng, "parameters": {r["name"]: np.array(r["x"], dtype=float).reshape(r["shape"]) for r in rows if r["name"]}}


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_vectors` wrote."""
    return spark.read.parquet(path)


def assemble_report(**families: Any) -> dict:
    """A run report of the families that are there (None is left out)."""
    return {k: _plain(v) for k, v in families.items() if v is not None}


def nested(report: dict, dotted: str, other: Any = None) -> Any:
    """The value at ``a.b.c``, or ``other``."""
    for part in dotted.split("."):
        if not isinstance(report, dict) or part not in report:
            return other
        report = report[part]
    return report


def flatten_models(df: DataFrame, text: str, classes: list[str]) -> DataFrame:
    """Reports as JSON text ``{model: {macro_f1, per_class: {class: f1}}}`` to one
    row per model, with a column per class."""
    shape = "map<string, struct<macro_f1: double, per_class: map<string, double>>>"
    each = df.select(F.explode(F.from_json(text, shape)).alias("model", "r"))
    return each.select("model", F.col("r.macro_f1").alias("macro_f1"), *[F.try_element_at(F.col("r.per_class"), F.lit(c)).alias(f"f1_{c}") for c in classes])


def flatten_entries(df: DataFrame, text: str, shape: str) -> DataFrame:
    """Reports as JSON arrays of structs to one row per entry (sweeps of attacks,
    explanations, deployments)."""
    return df.select(F.inline(F.from_json(text, f"array<struct<{shape}>>")))


class Registry:
    """Completed runs, one small JSON file each in a folder of the shared store.

    A run is registered by creating its file, which only one writer can, so
    appending is idempotent, needs no reading and suits many writers. Files that
    are not JSON are skipped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, run_id: str) -> str:
        return f"{self.path}/{hashlib.sha256(run_id.encode()).hexdigest()}.json"

    def runs(self) -> DataFrame:
        """``run_id, facts`` (a map of JSON texts) of every registered run."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "run_id string, facts map<string,string>")
        text = self.spark.read.option("wholetext", True).text(self.path)
        return text.select(F.get_json_object("value", "$.run_id").alias("run_id"), F.from_json("value", "map<string,string>").alias("facts")).filter("run_id IS NOT NULL")

    def is_complete(self, run_id: str) -> bool:
        return exists(self.spark, self._file(run_id))

    def register(self, run_id: str, **facts: Any) -> bool:
        return write_text(self.spark, self._file(run_id), json.dumps(_plain({"run_id": run_id, **facts})), overwrite=False)


def pending_runs(planned: DataFrame, done: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs that are not among the completed ones."""
    return planned.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


class EventLog:
    """Events as JSON lines with the UTC time and seconds since the start, in a
    folder of the shared store: one small file per event, so that writers never
    meet and nothing is rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.began = spark, path.rstrip("/"), time.time()

    def log(self, event: str, **facts: Any) -> None:
        row = {"event": event, "time": datetime.now(timezone.utc).isoformat(), "elapsed_s": round(time.time() - self.began, 3), **facts}
        write_text(self.spark, f"{self.path}/{time.time_ns()}-{uuid.uuid4().hex}.json", json.dumps(_plain(row)) + "\n", overwrite=False)

    def metric(self, name: str, value: float, step: int | None = None) -> None:
        self.log("metric", name=name, value=value, step=step)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log or registry as a table; broken lines are dropped."""
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter("_corrupt_record IS NULL").drop("_corrupt_record") if "_corrupt_record" in raw.columns else raw
