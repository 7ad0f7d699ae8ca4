"""Invariants: metric consistency, split properties, partition independence,
skew-safe running sums equal plain windows (SURVEY §5 c, d)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookwatch import schema as S
from bookwatch.functions.prefix import exclusive_running_sums, global_running_sums
from bookwatch.operators import decision as DC
from bookwatch.operators import evaluate as EV
from bookwatch.operators import preprocess as PP
from bookwatch.plans.registry import features, scored_test

from .conftest import SF_SMALL


def test_exclusive_running_sums_hot_key(spark):
    # one key holds most rows, with ties on the block column
    rows = [(0 if i % 3 else i, i // 7, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, d long, id long").withColumn("v", (F.col("id") % 5).cast("int"))
    got = exclusive_running_sums(df, ["k"], ["d"], ["id"], {"s": F.col("v")})
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("s_ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    joined = got.join(ref, ["k", "d", "id"])
    assert joined.where(F.col("s") != F.col("s_ref")).count() == 0
    assert joined.count() == 400


def test_global_running_sums_match_window(spark):
    df = spark.createDataFrame([(float(i * 7 % 101) / 7, i % 3) for i in range(300)], "score double, v int") \
              .groupBy("score").agg(F.sum("v").alias("v"))
    for desc in (False, True):
        got = global_running_sums(df, "score", ["v"], n_blocks=8, descending=desc, inclusive=True)
        order = F.desc("score") if desc else F.asc("score")
        ref = df.withColumn("ref", F.sum("v").over(Window.orderBy(order)
                                                   .rowsBetween(Window.unboundedPreceding, 0)))
        bad = got.join(ref, "score").where(F.col("cum_v") != F.col("ref")).count()
        assert bad == 0


def test_auc_equals_ml_evaluator_with_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rows = [(i % 2 if i % 5 else 1, round((i % 13) / 13, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, f"{S.TARGET} int, {S.PROBABILITY} double")
    ours = EV.roc_auc(df).first()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol=S.PROBABILITY, labelCol=S.TARGET, numBins=0)
    ref = ev.evaluate(df.withColumn(S.TARGET, F.col(S.TARGET).cast("double")))
    assert abs(ours - ref) < 1e-12


def test_sweep_matches_metrics_and_tiers(spark):
    sc = scored_test(spark, SF_SMALL).persist()
    sweep = {r["threshold"]: r for r in EV.threshold_sweep(sc, digits=6).collect()}
    m = EV.binary_metrics(EV.apply_threshold(sc, threshold=0.55)).first()
    for k in ("accuracy", "precision", "recall", "f1_score"):
        assert abs(sweep[0.55][k] - m[k]) < 1e-9
    tiers = DC.tier_counts(sc).first()
    assert sum(tiers) == sc.count()
    seg = DC.dashboard_by_segment(sc).agg(F.sum(S.REVENUE_AT_RISK)).first()[0]
    tot = DC.dashboard_totals(sc).first()["total_revenue_at_risk"]
    assert abs(seg - tot) < 0.05
    best = EV.best_threshold(EV.threshold_sweep(sc)).first()
    assert best["f1_score"] == max(r["f1_score"] for r in EV.threshold_sweep(sc).collect())
    sc.unpersist()


def test_split_exact_disjoint_partition_independent(spark):
    f = features(spark, SF_SMALL).select(S.BOOKING_ID, S.TARGET)
    sets = []
    for parts in (1, 5, 16):
        cond = PP.split_condition(f.repartition(parts))
        test = {r[0] for r in f.where(cond).select(S.BOOKING_ID).collect()}
        sets.append(test)
    assert sets[0] == sets[1] == sets[2]
    counts = {r[0]: r[1] for r in f.groupBy(S.TARGET).count().collect()}
    cond = PP.split_condition(f)
    tc = {r[0]: r[1] for r in f.where(cond).groupBy(S.TARGET).count().collect()}
    for y, n in counts.items():
        assert tc[y] == int(0.2 * n + 0.5)
    train_ids = {r[0] for r in f.where(~cond).select(S.BOOKING_ID).collect()}
    assert not (train_ids & sets[0]) and len(train_ids) + len(sets[0]) == f.count()


def test_risk_tier_nan_is_low_and_drivers(spark):
    df = spark.createDataFrame([(float("nan"),), (0.71,), (0.6,), (None,)], f"{S.PROBABILITY} double")
    got = [r[0] for r in df.select(DC.risk_tier()).collect()]
    assert got == ["Low Risk", "High Risk", "Medium Risk", "Low Risk"]
    d2 = spark.createDataFrame([(100, "Online TA", 0, 0.5, "No Deposit", "Transient", 1, 1),
                                (1, "Direct", 2, 0.0, "Non Refund", "Group", 0, 0)],
                               "lead_time int, market_segment string, total_of_special_requests int, "
                               "previous_cancellation_rate double, deposit_type string, customer_type string, "
                               "is_last_minute_booking int, room_type_changed int")
    a, b = [r[0] for r in d2.select(DC.risk_drivers(d2)).collect()]
    assert len(a) == 5 and a[0] == S.RISK_DRIVER_RULES[0][3]
    assert b == [S.NO_DRIVER_TEXT]
    only = d2.select("lead_time")  # absent rule columns are skipped
    assert only.select(DC.risk_drivers(only)).first()[0] == [S.RISK_DRIVER_RULES[0][3]]


def test_one_hot_unknown_is_zero_vector(spark):
    from pyspark.ml.functions import vector_to_array
    tr = spark.createDataFrame([("b",), ("a",), ("c",)], "hotel string")
    m = PP.fit_one_hot(tr, ["hotel"])
    assert PP.one_hot_categories(m, ["hotel"]) == {"hotel": ["a", "b", "c"]}
    te = spark.createDataFrame([("a",), ("z",), (None,)], "hotel string")
    vecs = [r[0] for r in m.transform(te).select(vector_to_array("hotel__ohe")).collect()]
    assert vecs == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_exclusive_running_sums_null_keys(spark):
    rows = [(None, 1, 1), (None, 1, 2), (1, None, 3), (1, None, 4), (1, 2, 5)]
    df = spark.createDataFrame(rows, "k long, d long, id long")
    got = {r["id"]: r["s"] for r in exclusive_running_sums(df, ["k"], ["d"], ["id"], {"s": F.lit(1)}).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2}


def test_queries_partition_independent(spark):
    import __spark_entry__ as E
    from tools.compare import rows_of_spark
    q = E.queries()
    names = ["bookings", "segment_summaries", "roc_auc", "threshold_sweep", "top_categories"]
    results = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        results.append({n: sorted(rows_of_spark(q[n](spark, SF_SMALL))[1], key=str) for n in names})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    for n in names:
        assert results[0][n] == results[1][n], n


def test_model_metrics_single_aggregate_matches_parts(spark):
    rows = [(i % 2 if i % 5 else 1, None if i % 17 == 0 else round((i % 13) / 13, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, f"{S.TARGET} int, {S.PROBABILITY} double")
    m = EV.model_metrics(df, "m", threshold=0.5, digits=None).first()
    auc = EV.roc_auc(df).first()[0]
    bm = EV.binary_metrics(EV.apply_threshold(df, threshold=0.5), digits=None).first()
    assert abs(m["roc_auc"] - auc) < 1e-12
    for k in ("accuracy", "precision", "recall", "f1_score"):
        assert abs(m[k] - bm[k]) < 1e-12
