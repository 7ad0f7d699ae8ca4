"""Work that grows with the tables: read once, cut by rows, cast without failing first."""

import re

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from bookwatch.operators import models as MD
from bookwatch.operators import preprocess as PP
from bookwatch.plans import registry as R
from bookwatch.plans.registry import features
from bookwatch.session import METHOD_BYTES
from bookwatch.sources import bookings as BS

SMALL = "/root/testdata/sf0.001"


def test_whole_numbers_with_zero_fractions_are_cast_once(spark):
    rows = ["2.0", "+3.", "-4.000", " 5.0 ", "7", "1e3", ".0", "", "NaN"]
    df = spark.createDataFrame([(v,) for v in rows], "n string")
    got = [r["n"] for r in df.select(BS.typed("n", BS.T.IntegerType()).alias("n")).collect()]
    assert got == [2, 3, -4, 5, 7, 1000, 0, None, None]
    for bad in ("2 .0", "2.5", "99999999999.0", "x.0"):
        one = spark.createDataFrame([(bad,)], "n string")
        assert one.select(BS.typed("n", BS.T.IntegerType(), "null").alias("n")).first()["n"] is None
        with pytest.raises(Exception, match=re.escape(f"cannot hold the value '{bad}'")):
            one.select(BS.typed("n", BS.T.IntegerType()).alias("n")).collect()
    # the usual spelling never reaches a cast that fails
    plan = df.select(BS.typed("n", BS.T.IntegerType()).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan


def test_readers_keep_projections_compilable(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    BS.bookings(spark, SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == str(METHOD_BYTES)


@pytest.mark.parametrize("query, evaluations", [("csv_mixed_headers", 1), ("score_batch", 1)])
def test_bookings_are_evaluated_once(spark, monkeypatch, query, evaluations):
    plans, read = [], R.bookings
    monkeypatch.setattr(R, "bookings", lambda s, d: plans.append(d) or read(s, d))
    kept, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: kept.append(name) or write(df, name))
    R.QUERIES[query](spark, SMALL)
    assert len(plans) == evaluations and kept.count("bookings") == evaluations


def test_order_lines_are_read_once(spark):
    plan = BS.bookings(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_matrix_partitions_hold_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    monkeypatch.setattr(MD, "MOST_ROWS", 50)
    one = spark.range(1000).coalesce(1)
    sizes = [len(p) for p in MD.dealt(one).rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 60
    few = MD.dealt(spark.range(25).repartition(8))
    assert few.rdd.getNumPartitions() == 3 and few.agg(F.count("*")).first()[0] == 25


def test_boosted_trees_keep_no_table_of_nodes(spark):
    from pyspark.ml.functions import array_to_vector
    x = [F.hash(F.col("id"), F.lit(k)) % 100 / 100.0 for k in range(4)]
    df = spark.range(400).select(array_to_vector(F.array(*x)).alias("features"),
                                 (x[0] + x[1] > 0.2).cast("int").alias("y"), F.lit(1.0).alias("weight")).coalesce(1).persist()
    est = MD.boosted("y", max_iter=4)
    assert not est.getCacheNodeIds()
    trees = est.fit(df).toDebugString.split("\n", 1)[1]
    assert trees == MD.boosted("y", max_iter=4).setCacheNodeIds(True).fit(df).toDebugString.split("\n", 1)[1]
    df.unpersist()


def test_values_are_counted_once_for_medians_and_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 17), float(i) if i % 3 else None, float("nan") if i % 4 == 0 else 1.0 * i,
                                 None, 5) for i in range(60)], "a double, b double, c double, d double, e int")
    cols = ["a", "b", "c", "d", "e"]
    med = PP.fit_medians(df, cols)
    robust = PP.fit_robust(PP.impute(df, med), cols)
    counted, real = [], PP.quantiles
    monkeypatch.setattr(PP, "quantiles", lambda d, c, *more: counted.append(list(c)) or real(d, c, *more))
    assert PP.fit_imputed_robust(df, cols) == (med, robust)
    assert counted == [cols, ["b", "c", "d"]]  # only what misses values is counted again


def test_matrix_leaves_memory_to_the_learners(spark, monkeypatch):
    seen, real = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *level: seen.append(level) or real(self, *level))
    train = features(spark, SMALL)
    MD.fit_bundle(train, "logistic", max_iter=2)
    assert seen == [(StorageLevel.DISK_ONLY,)]


def test_large_matrix_is_dealt_evenly_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    monkeypatch.setattr(MD, "MOST_ROWS", 50)
    cores = spark.sparkContext.defaultParallelism
    for parts, waves in ((3, 1), (9 * cores, 1), (3, 3)):
        rows = cores * 50 * waves - 10
        sizes = [len(p) for p in MD.dealt(spark.range(rows, numPartitions=parts)).rdd.glom().collect()]
        assert len(sizes) == cores * waves and sum(sizes) == rows and max(sizes) <= 60


def test_missing_values_are_told_from_the_counts(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, None, float("nan"), 3), (2.0, 4.0, 5.0, None)], "a double, b double, c double, d int")
    looked, real = [], DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *e: looked.append(self) or real(self, *e))
    med, robust = PP.fit_imputed_robust(df, ["a", "b", "c", "d"])
    assert not any(x is df for x in looked)  # the table is not read again to look for nulls
    assert med == {"a": 1.5, "b": 4.0, "c": 5.0, "d": 3.0} and robust["b"] == (4.0, 1.0)
    sizes = {}
    PP.quantiles(df.where("a is null"), ["a", "d"], [0.5], 10, sizes)
    assert sizes == {"a": 0, "d": 0}
