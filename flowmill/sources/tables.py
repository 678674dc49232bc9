"""Scans of the test and production tables (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``{directory}/{name}.parquet``; the session's time zone is set to UTC,
    as all epoch arithmetic is in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def flows_events(spark: SparkSession, directory: str) -> DataFrame:
    """Adapter: ``events`` as flows (source = user, destination = event type)."""
    return table(spark, directory, "events").select(
        F.col("event_id").alias("flow_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.col("user_id").alias("src"),
        F.col("event_type").alias("dst"),
        F.col("value").alias("bytes"),
    )


def flows(spark: SparkSession, directory: str, name: str = "nf_cicids2018_v3") -> DataFrame:
    """A raw flow table as it is."""
    return table(spark, directory, name)


def feature_columns(df: DataFrame) -> list[str]:
    """The features of a feature table: all columns between dataset and canonical_label."""
    c = df.columns
    return c[c.index("dataset") + 1 : c.index("canonical_label")]
