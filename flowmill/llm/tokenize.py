"""Encoding of a corpus with a public tokenizer, as a DataFrame operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession

from flowmill.llm.bpe import DEFAULT_DIR, encoder

VOCABULARY = f"{DEFAULT_DIR}/byte_bpe_50k.json"
_sent: dict[tuple[str, str], Broadcast] = {}


def _shipped(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The encoder, built once on the driver and sent to the workers, which then
    need no vocabulary file; a few MB, bounded by the vocabulary."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(encoder(vocabulary))
    return _sent[key]


def _texts(df: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in keep.items()], text.cast("string").alias("_text"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_text"), more])


def encode(df: DataFrame, text: Column, keep: dict[str, Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``ids`` (array of int): each text's token ids.

    No special tokens: strings that look like them are ordinary text. Null and
    empty texts give an empty list. A text is encoded whole, in one batch; rows
    stay where they are (no shuffle), one encoder lives in each Python worker.
    """
    rows = _texts(df, text, keep)
    sent = _shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for b in batches:
            at = b.schema.get_field_index("_text")
            packed = [enc.encode_packed(t) if t else b"" for t in b.column(at).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), ids], [*(n for i, n in enumerate(b.schema.names) if i != at), "ids"])

    return rows.mapInArrow(run, _schema(rows, "ids array<int>"))


def count_tokens(df: DataFrame, text: Column, keep: dict[str, Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens``: as :func:`encode`, but only the
    number of ids leaves the worker. 0 for null and empty texts."""
    rows = _texts(df, text, keep)
    sent = _shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for b in batches:
            at = b.schema.get_field_index("_text")
            n = pa.array([len(enc.encode_packed(t)) // 4 if t else 0 for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), n], [*(x for i, x in enumerate(b.schema.names) if i != at), "n_tokens"])

    return rows.mapInArrow(run, _schema(rows, "n_tokens bigint"))


def decode(df: DataFrame, ids: Column, keep: dict[str, Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``text``: ids sliced from the vocabulary's byte
    string by its offset table. Null lists give null; ids that do not form
    whole characters give replacement characters."""
    rows = df.select(*[c.alias(n) for n, c in keep.items()], ids.alias("_text"))
    sent = _shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for b in batches:
            at = b.schema.get_field_index("_text")
            out = pa.array([None if x is None else enc.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), out], [*(x for i, x in enumerate(b.schema.names) if i != at), "text"])

    return rows.mapInArrow(run, _schema(rows, "text string"))


