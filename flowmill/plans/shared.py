"""Where intermediate results live, and how lineage is cut.

A cluster names a folder all executors share in ``spark.checkpoint.dir``; it is
read from the session. Only where it is unset (tests on one machine) a
temporary folder is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="flowmill-shared-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/flowmill-{name}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is then the cluster's to clear
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, and is
    columnar and compressed, so later passes read only what they need.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that ``materialise`` wrote so far. For long sessions, once the
    results made from it have been read; else it happens at exit."""
    while _written:
        _drop(spark, _written.pop())


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Writes a small text file where ``path`` points (any file system Spark knows).
    Without ``overwrite`` an existing file stays and False is returned; of two
    writers only one succeeds."""
    fs, p = _at(spark, path)
    if not overwrite and fs.exists(p):
        return False
    try:
        out = fs.create(p, overwrite)
    except Exception:
        if not overwrite and fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file; raises if it is missing."""
    fs, p = _at(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(int(size))).decode("utf-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of the table kept under ``path``, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    whole = [f.getPath() for f in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(w.getName()) for w in whole)


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the next version under ``path`` and read it back.

    Unlike ``materialise``, nothing is dropped at exit, and no version is ever
    overwritten.
    """
    spark = df.sparkSession
    to = f"{path}/{max(versions(spark, path), default=0) + 1}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def kept(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest (or the given) version under ``path``; None if there is none."""
    there = versions(spark, path)
    return spark.read.parquet(f"{path}/{version or there[-1]}") if there else None


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven to hold at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows. Beyond it the join is left to
    a shuffle (with AQE's skew handling), so the result never depends on size.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
