"""Exact quantiles, range-block sums and the radix split against plain versions,
with many blocks, ties, nulls and NaN."""
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookwatch.functions.prefix import RangeBlocks, running_sums
from bookwatch.functions.quantiles import ValueCounts, quantiles
from bookwatch.operators import evaluate as EV
from bookwatch.operators import preprocess as PP
from bookwatch.operators import profile as PR
from bookwatch.operators import quality as Q
from bookwatch.operators import segments as SG

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def random_values(n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n)
    few = rng.integers(0, 3, n).astype(float)
    return [(float(a), float(b) if i % 5 else None, float("nan") if i % 7 == 0 else float(a) * 2, None)
            for i, (a, b) in enumerate(zip(x, few))]


@pytest.mark.parametrize("partitions", [1, 16])
@pytest.mark.parametrize("rows", [65_536, 100])
def test_quantiles_equal_numpy(spark, partitions, rows):
    data = random_values(2000)
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(partitions)
    got = quantiles(df, ["a", "b", "c", "d"], PROBS, rows=rows)
    for k, c in enumerate("abc"):
        x = [r[k] for r in data if r[k] is not None and not math.isnan(r[k])]
        assert got[c] == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12), c
    assert got["d"] == [None] * len(PROBS)


def test_values_are_never_listed_in_one_task(spark):
    # all values distinct: every block is near its size, and only those that hold a rank are summed
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"))
    counts = ValueCounts(df, ["x"], rows=500)
    sizes = [r["count"] for r in counts.blocks.placed.groupBy("__blk").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 1500 and sum(sizes) == 5000
    assert counts.quantiles([0.5])[0, "x"] == [pytest.approx(4999 * 1.5 / 2)]
    m = counts.moments()[0, "x"]
    assert m["count"] == 5000 and m["var"] == pytest.approx(np.var(np.arange(5000) * 1.5, ddof=1))


def test_medians_by_outcome(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 4.0), (0, None), (1, None), (None, 9.0)], "y int, v double")
    rows = [tuple(r) for r in SG.value_by_outcome(df, "y", "v").collect()]
    assert rows == [(0, 2, 2.5, 2.5, 5.0, "Not Cancelled"), (1, 0, None, None, None, "Cancelled")]


@pytest.mark.parametrize("group", [1, 3, 1024])
def test_running_sums_with_keys_and_groups(spark, group):
    data = [("hot" if i % 3 else f"k{i % 4}", i, i % 11) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    blocks = RangeBlocks(df, [F.col("k"), F.col("t")], rows=50)
    off = {(r["__blk"], r["k"]): r["v__o"] for r in blocks.offsets(["v"], ["k"], group).collect()}
    per = Counter()
    for (b, k), o in sorted(off.items()):
        assert o == per[k]
        per[k] += sum(r["v"] for r in blocks.placed.where((F.col("__blk") == b) & (F.col("k") == k)).collect())
    got = running_sums(df, [F.col("k"), F.col("t").desc()], ["v"], ["k"], inclusive=False, rows=50)
    w = Window.partitionBy("k").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("w"))
    assert got.join(want, ["k", "t"]).where("cum_v <> w").count() == 0 and got.count() == 900


def test_scores_that_are_no_scores(spark):
    data = [(1, 0.9), (0, 0.4), (1, 0.6), (0, 0.2), (0, float("nan")), (1, None), (None, 0.99)]
    df = spark.createDataFrame(data, "y int, p double")
    assert EV.roc_auc(df, "y", "p").first()[0] == 1.0
    assert {r["threshold"] for r in EV.roc_curve(df, "y", "p").collect()} == {None, 0.9, 0.4, 0.6, 0.2}
    sweep = EV.threshold_sweep(df, "y", "p", [0.4, 0.5]).collect()
    assert [(r["precision"], r["recall"]) for r in sweep] == [(0.667, 0.667), (1.0, 0.667)]
    m = EV.model_metrics(df, "m", "y", "p").first()
    assert (m["accuracy"], m["precision"], m["roc_auc"]) == (0.833333, 1.0, 1.0)


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_curves_of_tiny_frames(spark, n):
    fresh = spark.newSession()
    df = fresh.createDataFrame([(i % 2, i / 10) for i in range(n)], "y int, p double")
    for _ in range(3):
        assert EV.roc_auc(df, "y", "p").first()[0] == pytest.approx({2: 1.0, 3: 0.5, 4: 0.75, 5: 0.5}[n])
        assert EV.roc_curve(df, "y", "p").count() == n + 1 == EV.pr_curve(df, "y", "p").count()
    assert EV.roc_auc(df.limit(0), "y", "p").first()[0] is None


def test_models_in_one_scan(spark):
    df = spark.createDataFrame([(i % 2, i / 50, 1 - i / 50, None) for i in range(50)], "y int, a double, b double, c double")
    both = {r["model"]: r for r in EV.metrics_by_model(df, {k: F.col(k) for k in "abc"}, "y").collect()}
    for k in "abc":
        assert both[k] == EV.model_metrics(df, k, "y", k).first()
    assert both["c"]["roc_auc"] is None


def plain_split(rows, frac):
    import hashlib
    out, by = set(), {}
    for k, y in rows:
        if y is not None:
            by.setdefault(y, []).append((hashlib.md5(f"{k}|42".encode()).hexdigest(), k))
    for y, hs in by.items():
        out |= {k for _, k in sorted(hs)[:int(frac * len(hs) + 0.5)]}
    return out


@pytest.mark.parametrize("listed", [1, 10, 1000])
def test_radix_split(spark, listed, monkeypatch):
    monkeypatch.setattr(PP, "LISTED", listed)
    monkeypatch.setattr(PP, "DIGITS", 1)
    rows = [(i, None if i % 10 == 0 else i % 3 % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "booking_id long, is_canceled int")
    train, test = PP.stratified_split(df)
    assert {r[0] for r in test.collect()} == plain_split(rows, 0.2)
    assert train.count() + test.count() == 630  # rows without a target are in neither part
    assert PP.assign_split(df).where("split is null").count() == 70
    assert PP.class_weights(df, weights={0: 1.0, 1: 2.0}).where("weight is null").count() == 70


def test_split_with_repeated_and_missing_keys(spark):
    df = spark.createDataFrame([(7, 0)] * 40 + [(None, 0)] * 10 + [(8, 1)], "booking_id long, is_canceled int")
    train, test = PP.stratified_split(df)
    assert {r[0] for r in train.collect()}.isdisjoint({r[0] for r in test.collect()})
    assert train.where("booking_id is null").count() == 10
    assert PP.stratified_split(df.limit(0))[1].count() == 0


def test_ranks_and_shares_with_one_unique_column(spark):
    df = spark.createDataFrame([(str(i), "x" if i % 3 else "y") for i in range(500)], "u string, s string")
    top = PR.top_categories(df, ["u", "s"], 3)
    assert [(r["value"], r["rank"], r["percentage"]) for r in top.where("column_name = 'u'").orderBy("rank").collect()] == [
        ("0", 1, 0.2), ("1", 2, 0.2), ("10", 3, 0.2)]
    every = PR.feature_balance(df, ["u", "s"])
    assert every.where("column_name = 'u'").agg(F.count_distinct("rank")).first()[0] == 500
    assert {tuple(r) for r in every.where("column_name = 's'").collect()} == {("s", "x", 333, 1, 66.6), ("s", "y", 167, 2, 33.4)}


def test_distinct_counts_without_expand(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (2, float("nan"), "a"), (None, None, "")],
                               "i int, x double, s string")
    report = Q.quality_summary(df, None)
    assert {r["column_name"]: (r["missing_values"], r["unique_values"]) for r in report.collect()} == {
        "i": (1, 2), "x": (1, 2), "s": (1, 2)}
    assert "Expand" not in report._jdf.queryExecution().toString()


def test_density_reaches_where_it_must(spark):
    x = [0.0, 0.1, 0.2, 50.0, None]
    rows = PR.binned_kde(spark.createDataFrame([(v, 3.0) for v in x], "x double, flat double"), ["x", "flat"], 20).collect()
    v = np.array([a for a in x if a is not None])
    bw = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(0, 50, 20)
    want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert {r["column_name"] for r in rows} == {"x"}
    got = {r["grid_index"]: r["density"] for r in rows}
    assert [got[k] for k in range(20)] == pytest.approx(want.tolist(), abs=2e-9)
