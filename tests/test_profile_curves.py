"""Histogram bins against NumPy's rule, and the end points of the curves."""
import numpy as np
import pytest

from bookwatch.operators.evaluate import pr_curve, roc_curve
from bookwatch.operators.profile import histogram


@pytest.mark.parametrize("values", [[5.0] * 4, [0.0, 1.0, 9.0, 9.0], [-2.0, 7.5]])
def test_histogram_keeps_empty_bins(spark, values):
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "x double, y double")
    rows = histogram(df, ["x", "y"], 10).orderBy("bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["bin_start"] for r in rows], edges[:-1]) and {r["column_name"] for r in rows} == {"x"}
    assert histogram(df, ["y"]).collect() == []


def test_curves_have_their_end_points(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.4), (0, 0.1)], "y int, p double")
    roc = [tuple(r) for r in roc_curve(df, "y", "p").collect()]
    assert roc[0] == (None, 0.0, 0.0, 0, 0) and roc[-1] == (0.1, 1.0, 1.0, 2, 2) and len(roc) == 4
    pr = [tuple(r) for r in pr_curve(df, "y", "p").collect()]
    assert pr[0] == (None, 1.0, 0.0, 0, 0) and pr[-1] == (0.1, 0.5, 1.0, 2, 2) and len(pr) == 4
