"""Hand-made edge frames: bucket edges, nulls, unknown values."""
from pyspark.sql import functions as F

from bookwatch import schema as S
from bookwatch.functions import columns as C
from bookwatch.operators import features as FE
from bookwatch.operators import preprocess as PP
from bookwatch.operators import quality as Q

RAW_COLS = [f.name for f in S.RAW_BOOKING_SCHEMA.fields]


def _raw(spark, rows):
    """rows: list of dicts with a subset of raw columns; the rest are null."""
    full = [tuple(r.get(c) for c in RAW_COLS) for r in rows]
    return spark.createDataFrame(full, S.RAW_BOOKING_SCHEMA)


def test_lead_time_bucket_edges(spark):
    vals = [0, 30, 31, 90, 91, 180, 365, 366, 800, 801, -1, None]
    df = spark.createDataFrame([(v,) for v in vals], "lead_time int")
    got = [r[0] for r in df.select(C.lead_time_bucket("lead_time")).collect()]
    assert got == ["0-30 Days", "0-30 Days", "31-90 Days", "31-90 Days", "91-180 Days", "91-180 Days",
                   "181-365 Days", "365+ Days", "365+ Days", None, None, None]


def test_adr_bucket_edges_and_fill(spark):
    vals = [-0.01, 0.0, 50.0, 50.01, 100.0, 300.0, 300.01, 1e9, None]
    df = spark.createDataFrame([(v,) for v in vals], "adr double")
    got = [tuple(r) for r in df.select(C.adr_bucket("adr"), C.adr_bucket_filled("adr")).collect()]
    assert [g[0] for g in got] == [None, "0-50", "0-50", "51-100", "51-100", "201-300", "300+", "300+", None]
    assert [g[1] for g in got][0] == S.INVALID_ADR and got[-1][1] == S.INVALID_ADR


def test_stay_length_month_season(spark):
    df = spark.createDataFrame([(0, "March"), (2, "December"), (5, "July"), (10, "Smarch"), (11, None),
                                (None, "October")], "n int, m string")
    got = df.select(C.stay_length_category("n"), C.month_number("m"), C.season("m")).collect()
    assert [r[0] for r in got] == ["Zero-night stay", "Short stay", "Medium stay", "Long stay",
                                   "Extended stay", "Extended stay"]
    assert [r[1] for r in got] == [3, 12, 7, None, None, 10]
    assert [r[2] for r in got] == ["Spring", "Winter", "Summer", "Autumn", "Autumn", "Autumn"]


def test_derive_features_null_semantics(spark):
    rows = [
        dict(booking_id=1, is_canceled=1, lead_time=7, adr=0.0, stays_in_weekend_nights=0,
             stays_in_week_nights=0, previous_cancellations=1, previous_bookings_not_canceled=1,
             is_repeated_guest=1, deposit_type=None, reserved_room_type="A", assigned_room_type=None,
             arrival_date_month="May", booking_changes=0, total_of_special_requests=0, days_in_waiting_list=0),
        dict(booking_id=2, is_canceled=0, lead_time=None, adr=-6.38, stays_in_weekend_nights=2,
             stays_in_week_nights=1, previous_cancellations=0, previous_bookings_not_canceled=0,
             is_repeated_guest=1, deposit_type="Non Refund", reserved_room_type="B", assigned_room_type="B",
             arrival_date_month=None, booking_changes=2, total_of_special_requests=1, days_in_waiting_list=3),
    ]
    df = _raw(spark, rows)
    out = {r["booking_id"]: r for r in FE.derive_features(df, {"adr_q": 0.0, "value_q": 0.0}).collect()}
    a, b = out[1], out[2]
    assert a["total_nights"] == 0 and a["is_zero_night_stay"] == 1 and a["stay_length_category"] == "Zero-night stay"
    assert a["is_last_minute_booking"] == 1 and a["is_long_lead_booking"] == 0
    assert a["previous_cancellation_rate"] == 0.5 and a["previous_total_bookings"] == 2
    assert a["repeat_guest_with_deposit"] == 1  # null deposit counts as "not No Deposit"
    assert a["repeat_guest_non_refund"] == 0
    assert a["room_type_changed"] == 1  # null != value
    assert a["is_zero_adr"] == 1 and a["is_peak_season"] == 1 and a["arrival_season"] == "Spring"
    assert b["has_invalid_adr"] == 1 and b["adr_bucket"] == S.INVALID_ADR
    assert b["lead_time_bucket"] is None and b["is_last_minute_booking"] == 0  # null compares false
    assert b["previous_cancellation_rate"] == 0.0
    assert b["arrival_month_number"] is None and b["arrival_season"] == "Autumn" and b["is_peak_season"] == 0
    assert b["room_type_changed"] == 0 and b["repeat_guest_non_refund"] == 1 and b["is_waitlisted"] == 1


def test_value_thresholds_interpolate(spark):
    df = spark.createDataFrame([(float(v), 1, 0) for v in [1, 2, 3, 4]],
                               "adr double, stays_in_weekend_nights int, stays_in_week_nights int")
    t = FE.fit_value_thresholds(df)
    assert t["adr_q"] == 3.25 and t["value_q"] == 3.25  # linear interpolation, not an element


def test_ordinal_valid_buckets_never_unknown(spark):
    labels = [(lab,) for lab in S.LEAD_TIME_LABELS] + [("0–30 Days",), (None,)]
    df = spark.createDataFrame(labels, "lead_time_bucket string")
    got = [r[0] for r in df.select(PP.ordinal_expr("lead_time_bucket", S.LEAD_TIME_LABELS)).collect()]
    assert got == [0, 1, 2, 3, 4, -1, -1]  # en dash label is unknown; ASCII labels all encode


def test_required_and_groups(spark):
    df = spark.createDataFrame([(1, 2)], "lead_time int, adr int")
    try:
        Q.require_columns(df, ["lead_time", "adr", "hotel", "is_canceled"])
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "hotel" in str(e) and "is_canceled" in str(e)
    chk = Q.check_groups(df, {"numeric": ["lead_time", "total_nights"]})
    assert chk == {"missing": ["total_nights"], "unused": ["adr"]}
    assert Q.columns_of(df, "numeric") == ["lead_time", "adr"]


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1, None), (4, 1, None), (5, 2, "b")],
                               "booking_id long, x int, y string")
    assert Q.duplicate_count(df).first()[0] == 2
    kept = sorted(r["booking_id"] for r in Q.drop_duplicates(df).collect())
    assert kept == [1, 3, 5]


def test_missing_report_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    rows = Q.missing_report(df).collect()
    assert [(r.column_name, r.missing_count, r.missing_percentage) for r in rows] == [("b", 1, 50.0)]
    empty = spark.createDataFrame([], "is_canceled int, market_segment string")
    from bookwatch.operators import segments as SG
    assert SG.segment_summary(empty, "market_segment").count() == 0


def test_constant_column_correlation_is_null(spark):
    from bookwatch.operators import segments as SG
    df = spark.createDataFrame([(1, 5), (0, 5), (1, 5)], "is_canceled int, c int")
    r = SG.target_correlation(df, ["c"]).first()
    assert r["correlation"] is None


def test_robust_zero_iqr_divides_by_one(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (0,), (3,)], "c int")
    prm = PP.fit_robust(df, ["c"])
    assert prm["c"] == (0.0, 1.0)
    got = [r[0] for r in PP.robust_scale(df, prm).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 3.0]  # the sparse count survives


def test_binned_kde_equals_the_formula(spark):
    import numpy as np

    from bookwatch.operators import profile as PR
    df = spark.createDataFrame([(float((i * 37) % 1000) / 7.0,) for i in range(3000)], "x double")
    exact = {r["grid_index"]: r["density"] for r in PR.binned_kde(df, ["x"], 50).collect()}
    v = np.array([r[0] for r in df.collect()])
    bw = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
    assert max(abs(exact[k] - want[k]) for k in range(50)) < 2e-9
    # densities integrate to about one over the grid
    step = (max(r[0] for r in df.collect()) - min(r[0] for r in df.collect())) / 49
    assert abs(sum(exact.values()) * step - 1.0) < 0.1


def test_csv_nan(spark, tmp_path):
    import os
    from bookwatch.sources.bookings import read_bookings
    p = os.path.join(str(tmp_path), "b.csv")
    with open(p, "w") as fh:
        fh.write("booking_id,adr\n1,NaN\n2,3.5\n")
    got = {r["booking_id"]: r["adr"] for r in read_bookings(spark, p).select("booking_id", "adr").collect()}
    assert got == {1: None, 2: 3.5}


def test_scores_without_a_value_decide_nothing(spark):
    from pyspark.sql import functions as F

    from bookwatch.operators.evaluate import apply_threshold
    df = spark.createDataFrame([(float("nan"),), (None,), (0.9,), (0.1,)], "p double")
    got = apply_threshold(df, "p", 0.5, "c").select(F.col("c")).collect()
    assert [r["c"] for r in got] == [0, 0, 1, 0]
