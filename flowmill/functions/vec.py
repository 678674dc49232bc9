"""Vectors as ``array<double>``: products, norms, softmax, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    A column used inside a lambda is inlined there and would be computed anew
    for every element; bound to a lambda's own variable it is not.
    """
    return F.transform(F.array(value), use)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(F.struct(v.alias("v"), norm(v).alias("n")), lambda t: F.transform(t["v"], lambda x: F.when(t["n"] > 0, x.cast("double") / t["n"]).otherwise(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(v: Column) -> Column:
    shifted = let(F.struct(v.alias("v"), F.array_max(v).alias("m")), lambda t: F.transform(t["v"], lambda x: F.exp(x - t["m"])))
    return let(shifted, lambda e: let(F.struct(e.alias("e"), total(e).alias("s")), lambda t: F.transform(t["e"], lambda x: x / t["s"])))


def argmax(v: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_two(v: Column) -> Column:
    """The two largest entries, largest first."""
    return F.slice(F.sort_array(v, asc=False), 1, 2)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Mean 0, variance 1 within the vector."""
    n = F.size(v).cast("double")
    centred = let(F.struct(v.alias("v"), (total(F.transform(v, lambda x: x.cast("double"))) / n).alias("m")), lambda t: F.transform(t["v"], lambda x: x - t["m"]))
    return let(centred, lambda c: let(F.struct(c.alias("c"), F.sqrt(dot(c, c) / F.size(c) + eps).alias("s")), lambda t: F.transform(t["c"], lambda x: x / t["s"])))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    """Root mean square 1 within the vector."""
    return let(F.struct(v.alias("v"), F.sqrt(dot(v, v) / F.size(v) + eps).alias("s")), lambda t: F.transform(t["v"], lambda x: x / t["s"]))
