"""Problems 2 to 6 against brute force, and on nulls, ties, copies and nothing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import grouped_splits, mixing, overlaps, percentiles, proportions, top_items


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 2 -----------------------------------------------------------------------


def test_top_items_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, None), ("b", None, None), ("c", None, "z"), (None, 3, "z")], "item string, n int, field_name string")
    got = rows(top_items.top_items(df, {"f": F.col("item"), "g": F.col("n")}, 2).orderBy("field_name", "item_rank"))
    assert got == [("f", "a", 2, 1), ("f", "b", 2, 2), ("g", "1", 2, 1), ("g", "2", 1, 2)]


def test_frequent_items_are_exact_and_complete(spark):
    rng = random.Random(1)
    values = [f"v{min(int(rng.paretovariate(0.6)), 5000)}" for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {v for v, n in Counter(values).items() if n >= 0.01 * len(values)}
    assert {r[1] for r in rows(top_items.frequent_items(df, {"v": F.col("v")}, 0.01))} == want


def test_top_items_of_nothing(spark):
    df = spark.createDataFrame([], "v string")
    assert rows(top_items.frequent_items(df, {"v": F.col("v")}, 0.01)) == []


# --- 3 ------------------------------------------------------------------------


def _plan(spark, df, shares, minimums, share=0.5):
    return proportions.proportional_plan(df, {"cat": F.col("cat")}, F.col("id"), [proportions.Margin("cat", shares)], minimums, share)


def test_sample_meets_shares_and_repairs_minimums(spark):
    cats = ["big"] * 3000 + ["mid"] * 900 + ["small"] * 60 + [None] * 40
    df = spark.createDataFrame(list(enumerate(cats)), "id bigint, cat string").withColumn("_bucket", F.lit(1)).withColumn("_cut", F.lit(2))
    r, plan = _plan(spark, df, {"big": 0.5, "mid": 0.49, "small": 0.01}, {"small": 40})
    got = proportions.proportional_sample(r, plan)
    assert got.columns == ["id", "cat", "_bucket", "_cut"]
    n = Counter(x[1] for x in rows(got))
    total = (3000 + 900 + 60) // 2
    assert sum(n.values()) == total and len({x[0] for x in rows(got)}) == total
    assert 40 <= n["small"] <= 45 and n["mid"] == 900  # all of mid there are
    drawn = proportions.draw_counts(r, plan)
    assert abs(sum(drawn.values()) - total) < 60 and drawn["small"] < n["small"] and drawn["mid"] < 900  # before the repair
    report = {x[0]: x for x in proportions.gap_report(plan, drawn, [("big", 0.5, 0), ("mid", 0.49, 0), ("small", 0.01, 40), ("none", 0.1, 5)])}
    assert report["mid"][9] and not report["big"][9] and report["none"][9] and report["none"][10] and not report["small"][10]


def test_sample_is_the_same_on_other_partitions(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 > 0]) for i in range(600)], "id bigint, cat string")
    take = lambda d: sorted(x[0] for x in rows(proportions.proportional_sample(*_plan(spark, d, {"a": 0.5, "b": 0.5}, {}))))
    assert take(df.repartition(1)) == take(df.repartition(7))


def test_sample_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, cat string")
    r, plan = _plan(spark, df, {"a": 1.0}, {"a": 3})
    assert rows(proportions.proportional_sample(r, plan)) == []
    assert proportions.gap_report(plan, {}, [("a", 1.0, 3)])[0][10]


def test_sample_holds_the_smallest_keys_of_each_class_over_crossing_margins(spark):
    rng = random.Random(8)
    data = [(i, "ab"[rng.random() < 0.2], "xyz"[rng.randrange(3)] if rng.random() < 0.9 else "x") for i in range(4000)]
    df = spark.createDataFrame(data, "id bigint, cat string, side string")
    margins = [proportions.Margin("cat", {"a": 0.5, "b": 0.5}), proportions.Margin("side", {"x": 0.2, "y": 0.4, "z": 0.4})]
    r, plan = proportions.proportional_plan(df, {"cat": F.col("cat"), "side": F.col("side")}, F.col("id"), margins, {}, 0.1)
    got = rows(proportions.proportional_sample(r, plan))
    assert len(got) == 400 and abs(Counter(x[1] for x in got)["a"] - 200) <= 1 and abs(Counter(x[2] for x in got)["x"] - 80) < 30
    weight = {(c["cell"]["cat"], c["cell"]["side"]): c["weight"] for c in plan.cells}
    assert np.isclose(sum(c["fitted"] for c in plan.cells if c["cell"]["side"] == "y"), 160, rtol=1e-3)
    keys = {x["id"]: -np.log(x["_u"]) / weight[x["cat"], x["side"]] for x in r.select("_row.*", "_u").collect()}
    for c in "ab":
        mine = sorted(keys[i] for i, cat, _ in data if cat == c)
        taken = sorted(keys[x[0]] for x in got if x[1] == c)
        assert np.allclose(taken, mine[: len(taken)])
    drawn = proportions.draw_counts(r, plan)
    assert drawn == Counter(cat for i, cat, _ in data if keys[i] <= plan.threshold)


def test_too_many_cells_raise(spark):
    df = spark.createDataFrame([(i, f"c{i}") for i in range(30)], "id bigint, cat string")
    with pytest.raises(ValueError, match="more than 20 cells"):
        proportions.proportional_plan(df, {"cat": F.col("cat")}, F.col("id"), [proportions.Margin("cat", {})], {}, 0.5, max_cells=20)


def test_raking_fits_two_margins():
    counts = np.array([50, 10, 20, 20])
    fitted = proportions.rake(counts, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([60.0, 40.0]), np.array([50.0, 50.0])])
    assert np.allclose([fitted[0] + fitted[1], fitted[0] + fitted[2]], [60, 50])


# --- 4 --------------------------------------------------------------------------


@pytest.mark.parametrize("width", [0.05, 1.0])
@pytest.mark.parametrize("n", [12, 3])
def test_near_pairs_lose_nothing(spark, width, n):
    rng = np.random.default_rng(3)
    train = rng.normal(size=(120, n)).round(2)
    train[5, 2], train[6] = np.nan, train[7]
    noise = rng.normal(size=(120, n))
    noise *= rng.uniform(0, 0.02, size=(120, 1)) / np.linalg.norm(noise, axis=1, keepdims=True)
    ev = np.vstack([train + noise, train[:10]])
    names = [f"f{i}" for i in range(n)]
    clean = lambda m: [[None if np.isnan(x) and j == 2 and i % 2 else float(x) for j, x in enumerate(r)] for i, r in enumerate(m)]
    make = lambda m, base: spark.createDataFrame([(base + i, "s", *r) for i, r in enumerate(clean(m))], f"id bigint, distance string, {', '.join(n + ' double' for n in names)}")
    t, e = make(train, 0), make(ev, 1000)
    got = [(r[0], r[1]) for r in rows(overlaps.Overlaps(t, e, names, names, 0.01, width, {"t": F.col("id")}, {"e": F.col("id")}).pairs())]
    read = lambda m: np.array([[0.0 if x is None else x for x in r] for r in clean(m)])
    d = np.linalg.norm(read(train)[:, None] - read(ev)[None], axis=2)
    assert set(got) == {(i, 1000 + j) for i, j in zip(*np.where(d <= 0.01), strict=True)}
    assert len(got) == len(set(got)) > 20


def test_rows_near_all_borders_still_match(spark):
    edge = (overlaps.OFFSET + 3) * 0.25
    names = [f"f{i}" for i in range(overlaps.PROJECTIONS)]  # each is a projection of its own
    t = spark.createDataFrame([(1, *[edge - 2e-4] * 10), (9, *[edge + 2e-4, *[edge - 2e-4] * 9])], "id bigint, " + ", ".join(n + " double" for n in names))
    e = spark.createDataFrame([(2, *[edge + 1e-4] * 10), (3, *[edge + 1] * 10)], t.schema)
    got = overlaps.Overlaps(t, e, names, names, 0.01, 0.25, {"a": F.col("id")}, {"b": F.col("id")}).pairs()
    assert sorted(r[:2] for r in rows(got)) == [(1, 2), (9, 2)]


def test_overlap_classes_and_counts_with_null_sources(spark):
    t = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.505), (4, None), (5, float("nan")), (6, float("inf"))], "id bigint, x double")
    e = spark.createDataFrame([(10, None, 0.5), (11, "s", 0.0), (12, "s", float("nan")), (13, "s", 9.0), (14, "s", float("inf")), (15, "s", -0.0), (None, "s", 0.509)], "id bigint, src string, x double")
    o = overlaps.Overlaps(t, e, ["x"], ["x"], 0.01, 1.0, {"t": F.col("id")}, {"row": F.col("id"), "source": F.col("src")})
    assert {r[0]: r[2:] for r in rows(o.classes())} == {10: (2, 1), 11: (1, 0), 12: (0, 0), 13: (0, 0), 14: (0, 0), 15: (1, 0), None: (0, 3)}
    assert sorted(rows(o.counts("source")), key=str) == [("s", 6, 2, 1, 3), (None, 1, 1, 1, 1)]


def test_canonical_texts(spark):
    df = spark.createDataFrame([("  Ton--IoT!", 1.0), ("ton iot", 1.0), ("toniot", 1.0), (None, 1.0)], "s string, x double")
    h = [tuple(r) for r in df.select(*overlaps.record_hash(["x"], ["s"])).collect()]
    assert h[0] == h[1] and len(set(h)) == 3


def test_overlaps_of_nothing(spark):
    e = spark.createDataFrame([], "id bigint, x double")
    o = overlaps.Overlaps(e, e, ["x"], ["x"], 0.01, 1.0, {"a": F.col("id")}, {"b": F.col("id")})
    assert rows(o.pairs()) == rows(o.classes()) == rows(o.counts("b")) == []


# --- 5 -----------------------------------------------------------------------------


def _wanted(values, p):
    v = sorted(values)
    return v[max(1, int(np.ceil(p * len(v)))) - 1]


@pytest.mark.parametrize("sections", [2, 1024])
def test_percentiles_are_exact(spark, sections):
    rng = np.random.default_rng(2)
    data = {"a": [*rng.lognormal(5, 3, 400), *[7.0] * 300, 0.0, 1e308], "b": [3.0], "c": [1e-9, 1e15, 1e15 + 1]}
    bad = [(None, 1.0), ("a", None), ("a", float("nan")), ("a", -5.0), ("a", float("inf")), ("d", None)]
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + bad, "grp string, x double")
    ps = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(r[0], r[2]): (r[3], r[4]) for r in rows(percentiles.exact_percentiles(df, F.col("grp"), {"x": F.col("x")}, ps, sections))}
    assert got == {(g, p): (_wanted(xs, p), len(xs)) for g, xs in data.items() for p in ps}


def test_merged_states_bound_the_exact_value(spark):
    rng = np.random.default_rng(4)
    xs = rng.lognormal(6, 2, 900)
    df = spark.createDataFrame([(i % 3, "g", float(x)) for i, x in enumerate(xs)], "day int, grp string, x double")
    states = percentiles.value_states(df, F.col("day"), F.col("grp"), {"x": F.col("x")})
    halves = states.filter("part = 0").drop("part"), states.filter("part > 0").drop("part")
    merged = percentiles.merge_states(halves[0].unionByName(halves[1]))
    for _, _, p, low, high, n in rows(percentiles.percentiles_of_states(merged, [0.1, 0.5, 0.99])):
        w = _wanted(xs, p)
        assert low <= w <= high and n == 900 and (high + 1) / (low + 1) <= 2 ** (1 / percentiles.CELLS_PER_OCTAVE) * (1 + 1e-9)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "grp string, x double")
    assert rows(percentiles.exact_percentiles(df, F.col("grp"), {"x": F.col("x")}, [0.5])) == []
    assert rows(percentiles.value_states(df, F.lit(1), F.col("grp"), {"x": F.col("x")})) == []


# --- 6 --------------------------------------------------------------------------------


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(80):03}", f"n{rng.randrange(80):03}") for _ in range(45)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(20)] + [("z", "z"), (None, "z"), ("hub", "h1"), ("hub", "h2"), ("hub", "h3")] * 2
    assert dict(rows(grouped_splits.components(spark.createDataFrame(edges, "a string, b string")))) == _brute(edges)


def test_components_of_nothing(spark):
    assert rows(grouped_splits.components(spark.createDataFrame([], "a string, b string"))) == []


def test_components_are_carried_on_and_conflicts_quarantined(spark):
    old = spark.createDataFrame([("a1", "a1", "train"), ("a2", "a1", "train"), ("b1", "b1", "test"), ("c1", "c1", "train"), ("d1", "d1", "val")], "node string, component string, split string")
    links = spark.createDataFrame([("a2", "new1"), ("a1", "c1"), ("b1", "bad"), ("bad", "d1"), ("x", "y")], "a string, b string")
    got = {r[0]: r[1:] for r in rows(grouped_splits.extend_components(links, old))}
    assert got["new1"] == ("a1", "train", False) and got["c1"][:2] == ("a1", "train")
    assert got["bad"][1:] == ("quarantine", True) and got["b1"] == ("b1", "test", True) and got["d1"] == ("d1", "val", True)
    assert got["x"] == ("x", None, False) == got["y"]


def test_shares_are_met_and_components_stay_whole(spark):
    rng = random.Random(5)
    w = [(f"c{i}", cls, max(1, int(rng.paretovariate(1.0))), None) for i in range(3000) for cls in rng.sample(["p", "q", None], 2)]
    w += [("huge", "p", 4000, None), ("kept", "q", 500, "test")]
    df = spark.createDataFrame(w, "component string, cls string, n bigint, split string")
    got = dict(rows(grouped_splits.assign_splits(df, {"train": 0.7, "val": 0.15, "test": 0.15})))
    assert got["kept"] == "test" and set(got) == {c for c, *_ in w}
    size, total = Counter(), sum(x[2] for x in w)
    for c, _, n, _ in w:
        size[got[c]] += n
    assert all(abs(size[s] / total - t) < 0.02 for s, t in (("train", 0.7), ("val", 0.15), ("test", 0.15)))


# --- 8 -----------------------------------------------------------------------------------


def test_mixture_meets_shares_within_caps(spark):
    rec = [(i, "abc"[i % 3], 10) for i in range(3000)] + [(9000 + i, "d", 1) for i in range(5)] + [(9100, None, 500)]
    records = spark.createDataFrame(rec, "doc bigint, source string, size bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("d", 0.1, 4), ("e", 0.0, 1)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(records, targets)
    r = {x["source"]: x for x in rates.collect()}
    assert r["a"]["total"] == 30505 and r["d"]["short"] and r["d"]["rate"] == 4.0 and r["e"]["rate"] == 0.0 and not r["e"]["short"]
    mixed = mixing.mix(records, rates, "doc")
    m = rows(mixed)
    for s in "ab":
        used = sum(x[2] * x[3] for x in m if x[1] == s)
        assert abs(used / (r[s]["rate"] * 10000) - 1) < 0.05
    assert max(x[3] for x in m if x[1] == "a") <= 2 and all(x[3] == 4 for x in m if x[1] == "d")
    assert mixing.emit(mixed).count() == sum(x[3] for x in m)
    assert abs(sum(x["actual_share"] for x in mixing.share_report(mixed, rates).collect()) - 1) < 1e-9


def test_mixture_of_nothing(spark):
    records = spark.createDataFrame([], "doc bigint, source string, size bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(records, targets)
    assert [(x["size"], x["short"]) for x in rates.collect()] == [(0, False)]
    assert rows(mixing.mix(records, rates, "doc")) == []
    assert mixing.share_report(mixing.mix(records, rates, "doc"), rates).first()["actual_share"] == 0.0
