"""Ranks, running sums, quantiles and hash orders that never gather a group into one task.

``row_number() over (partition by label order by time)`` sends a whole label to
one task, and a label may hold most rows. Here rows are range-partitioned by
(group, order), which is balanced whatever the groups' sizes, and sorted inside
each partition; a row's place there is its number in the partition, and the
slices of a group are shifted by what lies before them. One shuffle of rows; the
shifts are one row per (group, partition) met: at most groups + partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.plans.shared import broadcast_if_small, materialise

#: Hashes are below this.
HASHES = 1 << 60


def _running(names: list[str]):
    """Adds the running sum of each named column over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = [0] * len(names)
        for b in batches:
            made = []
            for i, n in enumerate(names):
                v = b.column(b.schema.get_field_index(n)).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(v) + upto[i]
                upto[i] = total[-1] if len(total) else upto[i]
                made.append(pa.array(total, b.schema.field(n).type))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *[f"_c{n}" for n in names]])

    return run


def ranked(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (1-based in its group), ``group_rows``, and for each
    entry of ``sums`` (BIGINT or DOUBLE) its running (``run_<name>``) and group
    total (``all_<name>``).

    ``order`` must be total (end it with a unique key), else ranks of ties are
    arbitrary. Null groups form a group, an empty table gives no row.
    """
    sums = sums or {}
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"_s_{k}") for k, c in sums.items()])
    by = [*[F.col(g).asc() for g in groups], *order]
    # numbers a partition's rows in its order: partition << 33 | place
    placed = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    if sums:
        own = [f"_s_{k}" for k in sums]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields), *(f"`_c{o}` {placed.schema[o].dataType.simpleString()}" for o in own)])
        placed = placed.mapInArrow(_running(own), schema)
    placed = materialise(placed.withColumn("_pid", F.shiftright("_id", 33)), "ranked")
    slices = placed.groupBy(*groups, "_pid").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"),
        *[x for k in sums for x in (F.sum(f"_s_{k}").alias(f"_t_{k}"), F.min_by(F.col(f"_c_s_{k}") - F.coalesce(f"_s_{k}", F.lit(0)), "_id").alias(f"_o_{k}"))],
    )
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    shift = slices.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_pid").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(whole).alias("group_rows"),
        *[(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)) - F.col(f"_o_{k}")).alias(f"_b_{k}") for k in sums], *[F.sum(f"_t_{k}").over(whole).alias(f"all_{k}") for k in sums],
    )
    same = [F.col("_pid") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]]
    out = placed.join(broadcast_if_small(shift, 200_000), same)  # groups + partitions rows: broadcast if counted as few
    return out.select(
        *df.columns, (F.col("_id") + F.col("_shift")).alias("rank"), "group_rows",
        *[(F.col(f"_c_s_{k}") + F.col(f"_b_{k}")).alias(f"run_{k}") for k in sums], *[f"all_{k}" for k in sums],
    )


def quantiles(df: DataFrame, groups: list[str], value: Column, qs: list[float]) -> DataFrame:
    """``groups, q, value, n``: exact quantiles (linear between rows) of each group.

    Null and NaN values are left out. Equal values are folded first, so ranks
    are of distinct values, in balanced slices; groups without values give no row.
    """
    rows = df.select(*groups, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    folded = rows.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_m"))
    r = ranked(folded if groups else folded.withColumn("_all", F.lit(0)), groups or ["_all"], [F.col("_v").asc()], {"m": F.col("_m")})
    at = F.col("_q") * (F.col("all_m") - 1)
    holds = lambda k: (k >= F.col("run_m") - F.col("_m")) & (k < F.col("run_m"))
    asked = r.withColumn("_q", F.explode(F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: holds(F.floor(q * (F.col("all_m") - 1))) | holds(F.ceil(q * (F.col("all_m") - 1))))))
    ends = asked.groupBy(*groups, F.col("_q").alias("q")).agg(
        F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("_lo"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("_hi"), F.max(at - F.floor(at)).alias("_part"), F.max("all_m").alias("n")
    )
    return ends.select(*groups, "q", (F.col("_lo") + F.col("_part") * (F.col("_hi") - F.col("_lo"))).alias("value"), "n")


def mixed(*parts: Column | int, seed: int = 0) -> Column:
    """A number in [0, HASHES) fixed by the parts and the seed, the same in any
    engine that knows MD5."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def mixed_sql(*parts: str | int, seed: int = 0) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(f'({p})' for p in parts)}, '{seed}')), 1, 15))::BIGINT"


def mixed_number(*parts, seed: int = 0) -> int:
    """The same for plain values on the driver."""
    return int(hashlib.md5(":".join([*map(str, parts), str(seed)]).encode()).hexdigest()[:15], 16)


def uniform(*parts: Column | int, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the parts and the seed."""
    return mixed(*parts, seed=seed) / F.lit(float(HASHES))


def uniform_sql(*parts: str | int, seed: int = 0) -> str:
    return f"({mixed_sql(*parts, seed=seed)} / {float(HASHES)!r}::DOUBLE)"


def hash_order(key: str, seed: int = 0) -> Column:
    """A pseudo-random order of keys."""
    return mixed(F.col(key), seed=seed)


def hash_order_sql(key: str, seed: int = 0) -> str:
    return mixed_sql(key, seed=seed)
