"""python -m flowmill.cli COMMAND: the batch stages, and any registered query.

    prepare  --input TABLE --vocabulary TABLE --dataset NAME --output DIR
    split    --input DIR --output DIR
    features --input DIR --output DIR --state FILE
    query    NAME --tables DIR --output DIR
Settings: ``--config FILE`` (several) and ``--set key=value`` (several).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from flowmill import config
from flowmill.operators import clean, features, splits
from flowmill.sources import io


def prepare(spark: SparkSession, a: argparse.Namespace, cfg: dict) -> None:
    raw = io.read_flows_csv(spark, a.input) if a.input.endswith(".csv") else io.read_parquet(spark, a.input)
    kept = clean.canonical_labels(clean.drop_unusable(raw), io.read_parquet(spark, a.vocabulary), a.dataset, strict=True)
    io.write_parquet(clean.deduplicate(kept), a.output)


def split(spark: SparkSession, a: argparse.Namespace, cfg: dict) -> None:
    df = io.read_parquet(spark, a.input)
    out = splits.temporal_split(df, "canonical_label", "FLOW_START_MILLISECONDS", "flow_id")
    io.write_parquet(out, a.output, ["split"])


def fit_features(spark: SparkSession, a: argparse.Namespace, cfg: dict) -> None:
    df, f = io.read_parquet(spark, a.input), cfg["features"]
    pipe = features.FeaturePipeline(f["quantiles"], f["clip"], f["te1"], f["te2"], f["temporal"]).fit(df.filter("split = 'train'"))
    pipe.save(a.state)
    io.write_parquet(pipe.transform(df, ["flow_id", "canonical_label", "split"]), a.output, ["split"])


def query(spark: SparkSession, a: argparse.Namespace, cfg: dict) -> None:
    from flowmill.plans import registry

    io.write_parquet(registry.queries()[a.name](spark, a.tables), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowmill")
    p.add_argument("--config", action="append")
    p.add_argument("--set", action="append", dest="overrides")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, wanted in (("prepare", prepare, ("input", "vocabulary", "dataset", "output")), ("split", split, ("input", "output")), ("features", fit_features, ("input", "output", "state")), ("query", query, ("tables", "output"))):
        s = sub.add_parser(name)
        if name == "query":
            s.add_argument("name")
        for w in wanted:
            s.add_argument(f"--{w}", required=True)
        s.set_defaults(run=run)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    cfg = config.load(a.config, a.overrides)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a, cfg)


if __name__ == "__main__":
    main()
