"""Records of evaluation splits that occur, exactly or almost, in training.

**Exactly.** Records are canonicalised (texts: case, punctuation and blanks;
numbers: null reads as 0, as does -0) and hashed to 128 bits; evaluation hashes
are joined with training hashes. Both sides are folded to one row per hash
(*class*) first, so copies cost nothing, and matches are counted by split and
source.

**Almost.** Nearly equal records do not share that hash, so classes also get the
hash of a cell: the numbers are projected to ``PROJECTIONS`` sums of disjoint
groups (unit vectors, so a projection moves by at most the distance), and the
cell is the tuple of sums cut at ``width``. A training class hashes its own
cell; an evaluation class also probes the cell beyond each border within the
radius, at most ``2 ** PROJECTIONS`` in all, about two on average. Two records
within the radius therefore always meet, whatever the data. Meetings are of
keys only; the vectors of classes that met are fetched afterwards and the exact
distance settles it.

Records with NaN or infinite numbers lie within no distance of anything and
match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.plans.shared import materialise

PROJECTIONS = 10
#: Boundaries lie at (k + OFFSET) * width, off the values sums often take.
OFFSET = 0.3719
#: Numbers beyond are cut off before they are projected (cutting brings no records apart).
LARGEST = 1e9


def normalised(c: Column) -> Column:
    """Text for comparing: lower case, one blank for each run of punctuation,
    symbols and blanks, none outside."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def numbers(columns: list[str]) -> Column:
    """The numbers as one array of doubles; null (and -0) as 0."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) + F.lit(0.0) for c in columns])


def record_hash(columns: list[str], texts: list[str] = ()) -> list[Column]:
    """Two 64-bit hashes of the canonical record."""
    parts = [numbers(columns), *[normalised(F.col(f"`{t}`").cast("string")) for t in texts]]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]


def _finite(columns: list[str]) -> Column:
    return F.forall(numbers(columns), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _sums(columns: list[str]) -> Column:
    """The projections: sums of every PROJECTIONS-th number, signs alternating,
    scaled to unit vectors."""
    groups = [columns[k::PROJECTIONS] for k in range(min(PROJECTIONS, len(columns)))]

    def one(names: list[str]) -> Column:
        signs = F.lit([(-1.0) ** i / len(names) ** 0.5 for i in range(len(names))])
        held = F.zip_with(numbers(names), signs, lambda x, s: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)) * s)
        return F.aggregate(held, F.lit(0.0), lambda a, x: a + x)

    return F.array(*[one(g) for g in groups])


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width) - F.lit(OFFSET))


def cell_hash(sums: Column, width: float) -> Column:
    """The hash of a record's own cell: one term per projection, joined by XOR."""
    return F.aggregate(F.transform(sums, lambda v, i: F.xxhash64(i, _cell(v, width))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))


def probes(sums: Column, width: float, radius: float) -> Column:
    """All cells within ``radius``: the own hash and, for each projection near a
    border, the same with that projection's term exchanged."""
    reach = F.lit(radius * (1 + 1e-9) + LARGEST * 1e-14)

    def move(v: Column, i: Column) -> Column:
        low, high, here = _cell(v - reach, width), _cell(v + reach, width), _cell(v, width)
        other = F.when(low != here, low).when(high != here, high)
        return F.when(other.isNotNull(), F.xxhash64(i, other).bitwiseXOR(F.xxhash64(i, here)))

    moves = F.filter(F.transform(sums, move), lambda x: x.isNotNull())
    return F.aggregate(moves, F.array(cell_hash(sums, width)), lambda acc, x: F.concat(acc, F.transform(acc, lambda h: h.bitwiseXOR(x))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


class Overlaps:
    """The overlaps of two tables of records; results are its methods.

    ``columns`` are the numbers compared, ``spread`` those projected (a subset
    that tells records apart), ``carry`` the columns kept of each side. Other
    columns are not looked at, carried ones may be null; empty inputs give no
    rows, repeated rows count as rows.
    """

    def __init__(self, training: DataFrame, evaluation: DataFrame, columns: list[str], spread: list[str], radius: float, width: float, training_carry: dict[str, Column], evaluation_carry: dict[str, Column]):
        if width <= 2 * (radius + LARGEST * 1e-13):
            raise ValueError("the cells must be wider than twice the radius")
        self.columns, self.radius, self.keys = columns, radius, (list(training_carry), list(evaluation_carry))
        self.sources = training, evaluation
        a, b = record_hash(columns)
        sums = _sums(spread)

        def keyed(df: DataFrame, carry: dict[str, Column], cells: Column) -> DataFrame:
            inside = F.transform(F.array(F.struct(sums.alias("s"))), lambda t: cells(t["s"]))[0]  # the sums are computed once
            return df.select(*[c.alias(n) for n, c in carry.items()], a.alias("_a"), b.alias("_b"), inside.alias("_cells"), _finite(columns).alias("_ok"))

        self.t = materialise(keyed(training, training_carry, lambda s: F.array(cell_hash(s, width))).filter("_ok").drop("_ok"), "training-keys")
        self.e = materialise(keyed(evaluation, evaluation_carry, lambda s: probes(s, width, radius)), "evaluation-keys")
        self._near: DataFrame | None = None

    def near(self) -> DataFrame:
        """``ta, tb, ea, eb, distance``: pairs of different classes within the radius."""
        if self._near is None:
            classes = lambda df: df.groupBy("_a", "_b").agg(F.first("_cells").alias("_cells")).withColumn("_h", F.explode("_cells")).drop("_cells")
            t = classes(self.t).withColumnsRenamed({"_a": "ta", "_b": "tb"})
            e = classes(self.e.filter("_ok")).withColumnsRenamed({"_a": "ea", "_b": "eb"})
            met = materialise(t.join(e, "_h").filter("ta <> ea OR tb <> eb").select("ta", "tb", "ea", "eb"), "meetings")
            pair = met.join(self._vectors(0, met, "ta", "tb", "_f"), ["ta", "tb"]).join(self._vectors(1, met, "ea", "eb", "_g"), ["ea", "eb"])
            close = pair.withColumn("distance", F.sqrt(squared_distance(F.col("_f"), F.col("_g")))).filter(F.col("distance") <= self.radius)
            self._near = materialise(close.select("ta", "tb", "ea", "eb", "distance"), "near")
        return self._near

    def _vectors(self, side: int, met: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """The vector of each class of one side that met another."""
        ha, hb = record_hash(self.columns)
        all_ = self.sources[side].select(ha.alias(a), hb.alias(b), numbers(self.columns).alias(name))
        return all_.join(met.select(a, b).distinct(), [a, b], "left_semi").groupBy(a, b).agg(F.first(name).alias(name))

    def pairs(self) -> DataFrame:
        """Every (training, evaluation) pair of rows that are equal or within the
        radius: the carried columns of both sides (their names must differ) and ``distance``."""
        own_t, own_e = self.keys
        t, e = self.t.select(*own_t, F.col("_a").alias("ta"), F.col("_b").alias("tb")), self.e.filter("_ok").select(*own_e, F.col("_a").alias("ea"), F.col("_b").alias("eb"))
        exact = t.join(e, [t["ta"] == e["ea"], t["tb"] == e["eb"]]).select(*own_t, *own_e, F.lit(0.0).alias("distance"))
        close = self.near().join(t, ["ta", "tb"]).join(e, ["ea", "eb"]).select(*own_t, *own_e, "distance")
        return exact.unionByName(close)

    def classes(self) -> DataFrame:
        """Per evaluation record its carried columns, ``n_exact`` and ``n_near``:
        training rows equal to it, and others within the radius."""
        n = self.t.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
        near = self.near().join(n.withColumnsRenamed({"_a": "ta", "_b": "tb"}), ["ta", "tb"]).groupBy(F.col("ea").alias("_a"), F.col("eb").alias("_b")).agg(F.sum("_n").alias("n_near"))
        every = self.e.join(n.withColumnRenamed("_n", "n_exact"), ["_a", "_b"], "left").join(near, ["_a", "_b"], "left")
        return every.select(*self.keys[1], F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"))

    def counts(self, *by: str) -> DataFrame:
        """Per value of the carried evaluation columns ``by``: ``n_rows``, and rows
        that training has exactly, nearly, or at all. Evaluation is folded to
        one row per class and ``by`` before it is joined."""
        folded = self.e.groupBy("_a", "_b", *by).agg(F.count(F.lit(1)).alias("_rows"))
        held = self.t.select("_a", "_b").distinct().withColumn("_exact", F.lit(1))
        near = self.near().select(F.col("ea").alias("_a"), F.col("eb").alias("_b")).distinct().withColumn("_close", F.lit(1))
        j = folded.join(held, ["_a", "_b"], "left").join(near, ["_a", "_b"], "left")
        total = lambda c: F.sum(F.when(c, F.col("_rows")).otherwise(0))
        exact, close = F.col("_exact").isNotNull(), F.col("_close").isNotNull()
        return j.groupBy(*by).agg(F.sum("_rows").alias("n_rows"), total(exact).alias("exact_rows"), total(close).alias("near_rows"), total(exact | close).alias("overlap_rows"))
