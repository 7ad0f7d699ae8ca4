"""Named queries over the provided tables and their SQL oracles.

Every query reads the full tables (through ``bookings``) and returns a lazy
DataFrame; the oracle for the same name computes the same result in DuckDB
SQL written independently of the Spark code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import features as FE
from ..operators import preprocess as PP
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import segments as SG
from ..session import written
from ..sources.bookings import bookings
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def eda(spark, d):
    return FE.enrich_eda(bookings(spark, d))


def features(spark, d):
    """The feature table over bookings that are evaluated and written once: the
    thresholds, the split and whatever else is fitted read the written rows."""
    return FE.derive_features(written(bookings(spark, d), "bookings"))


BK = O.with_ctes(O.BOOKINGS)
ED = O.EDA_BASE
FT = O.BASE

CATEGORICAL_EDA = [f.name for f in S.RAW_BOOKING_SCHEMA.fields if f.dataType.typeName() == "string"]
BALANCE_COLS = ["hotel", "market_segment", "deposit_type", "customer_type", "arrival_date_month"]
CORR_COLS = ["is_canceled", "lead_time", "adr", "previous_cancellations", "booking_changes",
             "total_of_special_requests", "stays_in_week_nights", "stays_in_weekend_nights"]
HIST_COLS = [f.name for f in S.RAW_BOOKING_SCHEMA.fields
             if f.dataType.typeName() in ("integer", "double")]


def _cols_sql(cols):
    return ", ".join(cols)


def _unpivot_sql(cols, select_fmt, src="bookings"):
    return "\nUNION ALL\n".join(select_fmt.format(c=c, i=i, src=src) for i, c in enumerate(cols))


# --------------------------------------------------------------------------- sources / audit
register("bookings", BK + "SELECT * FROM bookings")(lambda s, d: bookings(s, d))

register("table_shape", BK + "SELECT count(*) AS n_rows, CAST(33 AS INTEGER) AS n_cols FROM bookings")(
    lambda s, d: Q.table_shape(bookings(s, d)))

register("head", BK + "SELECT * FROM bookings ORDER BY booking_id LIMIT 10")(
    lambda s, d: Q.head(bookings(s, d), 10))

register("sample_n", BK + """SELECT * FROM bookings
 ORDER BY md5(CAST(booking_id AS VARCHAR) || '|42'), booking_id LIMIT 500""")(
    lambda s, d: Q.sample_n(bookings(s, d), 500, seed=42))

register("require_columns", BK + f"SELECT booking_id, {_cols_sql(S.REQUIRED_COLUMNS)} FROM bookings")(
    lambda s, d: Q.select_features(Q.require_columns(bookings(s, d), S.REQUIRED_COLUMNS), S.REQUIRED_COLUMNS))

register("drop_leakage", FT + "SELECT * EXCLUDE (reservation_status, reservation_status_date) FROM features")(
    lambda s, d: Q.drop_leakage(features(s, d)))

# what the numeric group must come to on the feature table, for the SQL
_NUM = ["lead_time", "arrival_date_year", "arrival_date_week_number", "arrival_date_day_of_month",
        "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies", "previous_cancellations",
        "previous_bookings_not_canceled", "booking_changes", "days_in_waiting_list", "adr",
        "required_car_parking_spaces", "total_of_special_requests", "total_nights", "estimated_booking_value",
        "arrival_month_number", "previous_total_bookings", "previous_cancellation_rate"]
_MODEL_FEATURES = _NUM + S.NOMINAL_FEATURES + list(S.ORDINAL_FEATURES) + S.BINARY_FEATURES
register("select_features", FT + f"SELECT booking_id, {_cols_sql(_MODEL_FEATURES)} FROM features")(
    lambda s, d: (lambda f: Q.select_features(f, PP.input_columns(PP.model_groups(f))))(features(s, d)))

_GROUPS = {"numeric": _NUM, "nominal": S.NOMINAL_FEATURES, "ordinal": list(S.ORDINAL_FEATURES),
           "binary": S.BINARY_FEATURES}
register("check_groups", FT + ", grouped AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{g}' AS feature_group" for g, cols in _GROUPS.items() for c in cols)
    + f"""), present AS (SELECT unnest(json_keys(to_json(f))) AS column_name
   FROM (SELECT f FROM features f LIMIT 1))
SELECT coalesce(g.column_name, p.column_name) AS column_name,
 CASE WHEN p.column_name IS NULL THEN 'missing' ELSE coalesce(g.feature_group, 'unused') END AS feature_group
FROM grouped g FULL JOIN (SELECT * FROM present WHERE column_name NOT IN
 ({", ".join(f"'{c}'" for c in [S.BOOKING_ID, S.TARGET, *S.LEAKAGE_COLUMNS, *S.MODEL_EXCLUDE])})) p
ON g.column_name = p.column_name""")(
    lambda s, d: (lambda f: Q.group_report(f.select(*[c for c in Q.candidate_features(f) if c not in S.MODEL_EXCLUDE]),
                                           PP.model_groups(f)))(features(s, d)))

register("filter_invalid_adr", ED + "SELECT * FROM eda WHERE adr < 0")(
    lambda s, d: Q.filter_invalid_adr(eda(s, d)))

register("filter_null_bucket", ED + "SELECT * FROM eda WHERE adr_bucket IS NULL")(
    lambda s, d: Q.filter_null_bucket(eda(s, d)))

register("filter_revenue_rows", ED + "SELECT * FROM eda WHERE adr > 0 AND total_nights > 0")(
    lambda s, d: Q.filter_revenue_rows(eda(s, d)))

_DUCK_TYPES = "CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' " \
              "WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' END"
_BOOKING_COLS = [f.name for f in S.RAW_BOOKING_SCHEMA.fields]
register("table_info", BK + _unpivot_sql(
    _BOOKING_COLS,
    "SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, "
    "(SELECT " + _DUCK_TYPES + " FROM bookings LIMIT 1) AS dtype, count({c}) AS non_null_count FROM bookings"))(
    lambda s, d: Q.table_info(bookings(s, d)))

register("missing_report", BK + "SELECT * FROM (" + _unpivot_sql(
    _BOOKING_COLS,
    "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    "round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_percentage FROM bookings")
    + ") WHERE missing_count > 0")(lambda s, d: Q.missing_report(bookings(s, d)))

register("quality_summary", BK + "SELECT * FROM (" + _unpivot_sql(
    _BOOKING_COLS,
    "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_values, "
    "round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_percentage, "
    "count(DISTINCT {c}) AS unique_values FROM bookings")
    + ") ORDER BY missing_percentage DESC, column_name LIMIT 15")(
    lambda s, d: Q.quality_summary(bookings(s, d), 15))

_NO_ID = [c for c in _BOOKING_COLS if c != "booking_id"]
register("duplicate_count", BK + f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
 FROM (SELECT count(*) AS c FROM bookings GROUP BY {_cols_sql(_NO_ID)})""")(
    lambda s, d: Q.duplicate_count(bookings(s, d)))

register("drop_duplicates", BK + f"""SELECT min(booking_id) AS booking_id, {_cols_sql(_NO_ID)}
 FROM bookings GROUP BY {_cols_sql(_NO_ID)}""")(lambda s, d: Q.drop_duplicates(bookings(s, d)))

register("check_total_nights", ED + """SELECT
 count(*) FILTER (WHERE coalesce(total_nights = stays_in_weekend_nights + stays_in_week_nights, false)) AS correct_rows,
 count(*) FILTER (WHERE NOT coalesce(total_nights = stays_in_weekend_nights + stays_in_week_nights, false)) AS incorrect_rows
 FROM eda""")(lambda s, d: Q.check_total_nights(eda(s, d)))

register("check_close", ED + """SELECT
 count(*) FILTER (WHERE coalesce(abs(estimated_booking_value - adr*total_nights) <= 1e-8 + 1e-5*abs(adr*total_nights), false)) AS correct_rows,
 count(*) FILTER (WHERE NOT coalesce(abs(estimated_booking_value - adr*total_nights) <= 1e-8 + 1e-5*abs(adr*total_nights), false)) AS incorrect_rows
 FROM eda""")(lambda s, d: Q.check_close(eda(s, d)))

# --------------------------------------------------------------------------- profiling
register("describe", BK + _unpivot_sql(
    HIST_COLS,
    "SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, "
    "round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    "round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    "round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM bookings"))(
    lambda s, d: PR.describe(bookings(s, d), HIST_COLS))

register("describe_all", BK + _unpivot_sql(
    HIST_COLS,
    "SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS unique, "
    "CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 6) AS mean, "
    "round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    "round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    "round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM bookings")
    + "\nUNION ALL\n" + _unpivot_sql(
    CATEGORICAL_EDA,
    "SELECT '{c}', CAST(sum(n) AS BIGINT), count(*), arg_max(v, [n, -rk]), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL "
    "FROM (SELECT {c} AS v, count(*) AS n, rank() OVER (ORDER BY {c}) AS rk FROM bookings WHERE {c} IS NOT NULL GROUP BY {c})"))(
    lambda s, d: PR.describe_all(bookings(s, d), HIST_COLS, CATEGORICAL_EDA))

register("value_counts", BK + """SELECT market_segment, count(*) AS count FROM bookings
 WHERE market_segment IS NOT NULL GROUP BY market_segment""")(
    lambda s, d: PR.value_counts(bookings(s, d), "market_segment"))

register("value_share", BK + """SELECT deposit_type, count(*) AS count,
 round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage
 FROM bookings WHERE deposit_type IS NOT NULL GROUP BY deposit_type""")(
    lambda s, d: PR.value_share(bookings(s, d), "deposit_type"))

register("target_distribution", BK + """SELECT is_canceled, count(*) AS booking_count,
 round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage FROM bookings GROUP BY is_canceled""")(
    lambda s, d: PR.target_distribution(bookings(s, d)))

_CATS_SQL = "SELECT column_name, value, count(*) AS count FROM (" + _unpivot_sql(
    CATEGORICAL_EDA, "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM bookings") + \
    ") WHERE value IS NOT NULL GROUP BY column_name, value"
register("top_categories", BK + f"""SELECT * FROM (
 SELECT column_name, value, count,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank,
  round(count / sum(count) OVER (PARTITION BY column_name) * 100, 2) AS percentage
 FROM ({_CATS_SQL})) WHERE rank <= 10""")(
    lambda s, d: PR.top_categories(bookings(s, d), CATEGORICAL_EDA, 10))

_BAL_SQL = "SELECT column_name, value, count(*) AS count FROM (" + _unpivot_sql(
    BALANCE_COLS, "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM bookings") + \
    ") WHERE value IS NOT NULL GROUP BY column_name, value"
register("feature_balance", BK + f"""SELECT column_name, value, count,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank,
  round(count / sum(count) OVER (PARTITION BY column_name) * 100, 2) AS percentage
 FROM ({_BAL_SQL})""")(lambda s, d: PR.feature_balance(bookings(s, d), BALANCE_COLS))

_HIST_PARTS = _unpivot_sql(HIST_COLS, """SELECT '{c}' AS column_name, b.bin, lo, w, b.n
  FROM (SELECT CASE WHEN hi > lo0 THEN lo0 ELSE lo0 - 0.5::DOUBLE END AS lo,
     CASE WHEN hi > lo0 THEN (hi - lo0) / 30 ELSE 1.0::DOUBLE / 30 END AS w
     FROM (SELECT min(CAST({c} AS DOUBLE)) AS lo0, max(CAST({c} AS DOUBLE)) AS hi FROM bookings)
     WHERE lo0 IS NOT NULL) e,
  LATERAL (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - e.lo) / e.w), 29) AS INTEGER) AS bin, 1 AS n
     FROM bookings WHERE {c} IS NOT NULL
     UNION ALL SELECT CAST(i AS INTEGER), 0 FROM range(30) r(i)) b""")
register("histogram", BK + f"""SELECT column_name, bin, round(lo + bin * w, 6) AS bin_start,
 round(lo + (bin + 1) * w, 6) AS bin_end, CAST(sum(n) AS BIGINT) AS count FROM ({_HIST_PARTS})
 GROUP BY column_name, bin, lo, w""")(lambda s, d: PR.histogram(bookings(s, d), HIST_COLS, 30))

_KDE = """SELECT '{c}' AS column_name, CAST(g AS INTEGER) AS grid_index, round(lo + g * step, 6) AS x,
  round(sum(c * exp(-0.5 * ((lo + g * step - v) / bw) * ((lo + g * step - v) / bw))) / (n * bw * sqrt(2 * pi())), 9) AS density
 FROM (SELECT CAST({c} AS DOUBLE) AS v, count(*) AS c FROM bookings WHERE {c} IS NOT NULL GROUP BY 1) vals,
  (SELECT n, lo, sd * pow(n, -0.2) AS bw, (hi - lo) / 99 AS step
   FROM (SELECT count({c}) AS n, stddev_samp({c}) AS sd, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM bookings)
   WHERE sd > 0) prm, range(0, 100) t(g) GROUP BY g, lo, step, n, bw"""
register("binned_kde", BK + _unpivot_sql(HIST_COLS, _KDE))(
    lambda s, d: PR.binned_kde(bookings(s, d), HIST_COLS, 100))

register("cancel_totals", BK + """SELECT count(*) FILTER (WHERE is_canceled = 0) AS completed_bookings,
 count(*) FILTER (WHERE is_canceled = 1) AS cancelled_bookings,
 round(count(*) FILTER (WHERE is_canceled = 1) / count(*) * 100, 2) AS cancel_rate FROM bookings""")(
    lambda s, d: PR.cancel_totals(bookings(s, d)))

# --------------------------------------------------------------------------- segments
for _key in ["hotel", "market_segment", "deposit_type", "customer_type"]:
    register(f"rate_by_{_key}", BK + f"""SELECT {_key}, round(avg(is_canceled) * 100, 2) AS cancellation_rate
 FROM bookings WHERE {_key} IS NOT NULL GROUP BY {_key}""")(
        lambda s, d, k=_key: SG.rate_by(bookings(s, d), k))
    register(f"segment_summary_{_key}", BK + f"""SELECT {_key}, count(is_canceled) AS total_bookings,
 CAST(sum(is_canceled) AS BIGINT) AS cancellations,
 round(sum(is_canceled) / count(is_canceled) * 100, 2) AS cancellation_rate
 FROM bookings WHERE {_key} IS NOT NULL GROUP BY {_key}""")(
        lambda s, d, k=_key: SG.segment_summary(bookings(s, d), k))

_SEG_KEYS = ["hotel", "market_segment", "deposit_type", "customer_type"]
register("segment_summaries", BK + "SELECT dimension, segment, count(is_canceled) AS total_bookings, "
         "CAST(sum(is_canceled) AS BIGINT) AS cancellations, "
         "round(sum(is_canceled) / count(is_canceled) * 100, 2) AS cancellation_rate FROM (" +
         _unpivot_sql(_SEG_KEYS, "SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS segment, is_canceled FROM bookings")
         + ") WHERE segment IS NOT NULL GROUP BY dimension, segment")(
    lambda s, d: SG.segment_summaries(bookings(s, d), _SEG_KEYS))


def _bucket_sql(col, labels):
    dim = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS bucket_order, '{lab}' AS {col}"
                             for i, lab in enumerate(labels))
    return ED + f""", dim AS ({dim}),
 agg AS (SELECT {col}, count(is_canceled) AS t, sum(is_canceled) AS c FROM eda
         WHERE {col} IS NOT NULL GROUP BY {col})
SELECT bucket_order, dim.{col}, CAST(coalesce(t, 0) AS BIGINT) AS total_bookings,
  CAST(coalesce(c, 0) AS BIGINT) AS cancellations,
  CASE WHEN t > 0 THEN round(c / t * 100, 2) END AS cancellation_rate
FROM dim LEFT JOIN agg ON dim.{col} = agg.{col}"""


register("lead_time_summary", _bucket_sql("lead_time_bucket", S.LEAD_TIME_LABELS))(
    lambda s, d: SG.lead_time_summary(bookings(s, d)))
register("adr_summary", _bucket_sql("adr_bucket", S.ADR_LABELS))(
    lambda s, d: SG.adr_summary(bookings(s, d)))

for _key, _mx in [("previous_cancellations", None), ("booking_changes", 5), ("total_of_special_requests", None)]:
    _where = f" AND {_key} <= {_mx}" if _mx is not None else ""
    register(f"rate_by_count_{_key}", BK + f"""SELECT {_key}, avg(is_canceled) AS is_canceled,
 avg(is_canceled) * 100 AS cancellation_rate FROM bookings WHERE {_key} IS NOT NULL{_where} GROUP BY {_key}""")(
        lambda s, d, k=_key, m=_mx: SG.rate_by_count(bookings(s, d), k, m))
    register(f"count_by_{_key}", BK + f"""SELECT {_key}, count(*) AS booking_count FROM bookings
 WHERE {_key} IS NOT NULL GROUP BY {_key}""")(lambda s, d, k=_key: SG.count_by(bookings(s, d), k))

_MEAN_COLS = [c for c in HIST_COLS if c not in ("booking_id", "is_canceled")] + ["total_nights", "estimated_booking_value"]
register("means_by_target", ED + _unpivot_sql(
    _MEAN_COLS, "SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE is_canceled = 0), 2) AS mean_not_cancelled, "
    "round(avg({c}) FILTER (WHERE is_canceled = 1), 2) AS mean_cancelled FROM eda"))(
    lambda s, d: (lambda e: SG.means_by_target(e, [c for c in Q.columns_of(e, "numeric")
                                                   if c not in (S.BOOKING_ID, S.TARGET)]))(eda(s, d)))


def _corr_sql(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"round(CASE WHEN stddev_samp({a}) FILTER (WHERE {both}) * stddev_samp({b}) FILTER (WHERE {both}) <> 0 "
            f"THEN covar_samp({a}, {b}) / (stddev_samp({a}) FILTER (WHERE {both}) * stddev_samp({b}) FILTER (WHERE {both})) END, 6)")


register("correlation_matrix", BK + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr_sql(a, b)} AS correlation FROM bookings"
    for a in CORR_COLS for b in CORR_COLS))(lambda s, d: SG.correlation_matrix(bookings(s, d), CORR_COLS))

register("target_correlation", BK + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {_corr_sql(c, 'is_canceled')} AS correlation FROM bookings" for c in CORR_COLS))(
    lambda s, d: SG.target_correlation(bookings(s, d), CORR_COLS))

_MONTH_NUM = ("CAST(list_position(['January','February','March','April','May','June','July','August',"
              "'September','October','November','December'], arrival_date_month) AS INTEGER)")
_MONTHLY_RATE = f"""SELECT arrival_date_month, avg(is_canceled) AS is_canceled,
 avg(is_canceled) * 100 AS cancellation_rate, {_MONTH_NUM} AS month_number
 FROM bookings WHERE arrival_date_month IS NOT NULL GROUP BY arrival_date_month"""
_MONTHLY_VOL = f"""SELECT arrival_date_month, count(*) AS booking_count, {_MONTH_NUM} AS month_number
 FROM bookings WHERE arrival_date_month IS NOT NULL GROUP BY arrival_date_month"""
register("monthly_rate", BK + _MONTHLY_RATE)(lambda s, d: SG.monthly_rate(bookings(s, d)))
register("monthly_volume", BK + _MONTHLY_VOL)(lambda s, d: SG.monthly_volume(bookings(s, d)))
register("monthly_summary", BK + f"""SELECT r.arrival_date_month, r.is_canceled, r.cancellation_rate,
 v.booking_count, v.month_number FROM ({_MONTHLY_RATE}) r LEFT JOIN ({_MONTHLY_VOL}) v
 ON r.arrival_date_month = v.arrival_date_month""")(lambda s, d: SG.monthly_summary(bookings(s, d)))
register("hotel_monthly_rate", BK + f"""SELECT arrival_date_month, hotel, avg(is_canceled) AS is_canceled,
 avg(is_canceled) * 100 AS cancellation_rate, {_MONTH_NUM} AS month_number FROM bookings
 WHERE arrival_date_month IS NOT NULL AND hotel IS NOT NULL GROUP BY arrival_date_month, hotel""")(
    lambda s, d: SG.hotel_monthly_rate(bookings(s, d)))
register("hotel_monthly_volume", BK + f"""SELECT arrival_date_month, hotel, count(*) AS booking_count,
 {_MONTH_NUM} AS month_number FROM bookings
 WHERE arrival_date_month IS NOT NULL AND hotel IS NOT NULL GROUP BY arrival_date_month, hotel""")(
    lambda s, d: SG.hotel_monthly_volume(bookings(s, d)))
register("value_by_outcome", ED + """SELECT is_canceled, count(estimated_booking_value) AS count,
 round(avg(estimated_booking_value), 2) AS mean, round(median(estimated_booking_value), 2) AS median,
 round(sum(estimated_booking_value), 2) AS sum,
 CASE WHEN is_canceled = 0 THEN 'Not Cancelled' WHEN is_canceled = 1 THEN 'Cancelled' END AS status
 FROM eda GROUP BY is_canceled""")(lambda s, d: SG.value_by_outcome(eda(s, d)))

# --------------------------------------------------------------------------- features
register("eda_enriched", ED + "SELECT * FROM eda")(eda)
register("derive_features", FT + "SELECT * FROM features")(features)

# --------------------------------------------------------------------------- preprocessing
from ..operators import decision as DC  # noqa: E402
from ..operators import evaluate as EV  # noqa: E402
from ..sources import fixtures as FX  # noqa: E402

SPB = O.SPLIT_BASE
SCB = O.SCORED_BASE


def split_frames(spark, d):
    return PP.stratified_split(features(spark, d))


def split_table(spark, d):
    """The feature table with its split column."""
    return PP.assign_split(features(spark, d))


def scored_test(spark, d, threshold: float = S.DEFAULT_THRESHOLD):
    """Test split scored with the deterministic reference score."""
    _, test = split_frames(spark, d)
    return DC.add_risk_columns(test.withColumn(S.PROBABILITY, FX.reference_score()), threshold)


register("stratified_split", SPB + """SELECT booking_id, is_canceled,
 CASE WHEN __rn <= round(0.2 * __ny) THEN 'test' ELSE 'train' END AS split FROM split""")(
    lambda s, d: PP.assign_split(features(s, d)).select(S.BOOKING_ID, S.TARGET, "split"))

register("impute_median", SPB + ", med AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5)::DOUBLE AS m_{c}" for c in _NUM) + " FROM train)\nSELECT booking_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM) + " FROM features, med")(
    lambda s, d: (lambda f: PP.impute(f, PP.fit_medians(f.where("split = 'train'"), _NUM)).select(
        S.BOOKING_ID, *_NUM))(split_table(s, d)))

register("robust_scale", SPB + ", med AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5)::DOUBLE AS m_{c}" for c in _NUM) + " FROM train),\n"
    "imp AS (SELECT booking_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM)
    + " FROM train, med),\nprm AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS c_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
        f"THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in _NUM)
    + " FROM imp)\nSELECT booking_id, " + ", ".join(
        f"round((coalesce(CAST({c} AS DOUBLE), m_{c}) - c_{c}) / s_{c}, 6) AS {c}" for c in _NUM)
    + " FROM features, med, prm")(
    lambda s, d: _robust_query(s, d))


def _robust_query(s, d):
    f = split_table(s, d)
    tr = f.where("split = 'train'")
    med = PP.fit_medians(tr, _NUM)
    prm = PP.fit_robust(PP.impute(tr, med), _NUM)
    out = PP.robust_scale(PP.impute(f, med), prm)
    return out.select(S.BOOKING_ID, *[F.round(c, 6).alias(c) for c in _NUM])


from pyspark.sql import functions as F  # noqa: E402

_NOM = S.NOMINAL_FEATURES
register("one_hot", SPB + "SELECT f.booking_id, f.feature, f.category FROM (" + _unpivot_sql(
    _NOM, "SELECT booking_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM features") +
    ") f JOIN (" + _unpivot_sql(_NOM, "SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM train") +
    ") t ON f.feature = t.feature AND f.category = t.category")(
    lambda s, d: (lambda f: PP.one_hot_long(f, PP.fit_one_hot(f.where("split = 'train'"))))(split_table(s, d)))

register("ordinal_encode", FT + """SELECT booking_id,
 CAST(coalesce(list_position(['0-30 Days','31-90 Days','91-180 Days','181-365 Days','365+ Days'], lead_time_bucket) - 1, -1) AS INTEGER) AS lead_time_bucket,
 CAST(coalesce(list_position(['0-50','51-100','101-150','151-200','201-300','300+','Invalid ADR'], adr_bucket) - 1, -1) AS INTEGER) AS adr_bucket,
 CAST(coalesce(list_position(['Zero-night stay','Short stay','Medium stay','Long stay','Extended stay'], stay_length_category) - 1, -1) AS INTEGER) AS stay_length_category
 FROM features""")(
    lambda s, d: PP.ordinal_encode(features(s, d)).select(S.BOOKING_ID, *S.ORDINAL_FEATURES))

register("class_weights", SPB + """, c AS (SELECT count(*) FILTER (WHERE is_canceled = 0) AS n0,
 count(*) FILTER (WHERE is_canceled = 1) AS n1 FROM train)
SELECT booking_id, is_canceled,
 CASE WHEN is_canceled = 1 THEN (n0 + n1) / (2.0 * n1) ELSE (n0 + n1) / (2.0 * n0) END AS weight,
 CASE WHEN is_canceled = 1 THEN n0 / n1 ELSE 1.0 END AS ratio_weight FROM train, c""")(
    lambda s, d: _weights_query(s, d))


def _weights_query(s, d):
    tr, _ = split_frames(s, d)
    out = PP.class_weights(tr, scheme="balanced")
    out = PP.class_weights(out, scheme="ratio", name="ratio_weight")
    return out.select(S.BOOKING_ID, S.TARGET, "weight", "ratio_weight")


# --------------------------------------------------------------------------- evaluation
register("score_threshold", SCB + """SELECT booking_id, is_canceled, predicted_cancellation_probability,
 predicted_is_cancelled FROM scored""")(
    lambda s, d: scored_test(s, d).select(S.BOOKING_ID, S.TARGET, S.PROBABILITY, S.PREDICTION))

_CONF = """count(*) FILTER (WHERE is_canceled = 0 AND predicted_is_cancelled = 0) AS tn,
 count(*) FILTER (WHERE is_canceled = 0 AND predicted_is_cancelled = 1) AS fp,
 count(*) FILTER (WHERE is_canceled = 1 AND predicted_is_cancelled = 0) AS fn,
 count(*) FILTER (WHERE is_canceled = 1 AND predicted_is_cancelled = 1) AS tp"""
register("confusion", SCB + f"SELECT {_CONF} FROM scored")(lambda s, d: EV.confusion(scored_test(s, d)))


def _metrics_sql(digits):
    r = lambda e: f"round({e}, {digits})"
    return (f"{r('CASE WHEN tp+tn+fp+fn > 0 THEN (tp+tn)/(tp+tn+fp+fn) ELSE 0.0 END')} AS accuracy, "
            f"{r('CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END')} AS precision, "
            f"{r('CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END')} AS recall, "
            f"{r('CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END')} AS f1_score")


register("binary_metrics", SCB + f"SELECT {_metrics_sql(6)} FROM (SELECT {_CONF} FROM scored)")(
    lambda s, d: EV.binary_metrics(scored_test(s, d)))

_SC = """, sc AS (SELECT predicted_cancellation_probability AS score,
 count(*) FILTER (WHERE is_canceled = 1) AS pos, count(*) FILTER (WHERE is_canceled = 0) AS neg
 FROM scored WHERE predicted_cancellation_probability IS NOT NULL AND is_canceled IS NOT NULL
 GROUP BY predicted_cancellation_probability)"""
_AUC = _SC + """, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0) AS cum_neg FROM sc)
SELECT CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (cum_neg + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)) END
 AS roc_auc FROM c"""
register("roc_auc", SCB + _AUC)(lambda s, d: EV.roc_auc(scored_test(s, d)))

_CURVE = _SC + """, c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
 sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
 sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""
register("roc_curve", SCB + _CURVE + """SELECT score AS threshold,
 round(CASE WHEN N > 0 THEN cn / N END, 6) AS fpr, round(CASE WHEN P > 0 THEN cp / P END, 6) AS tpr,
 CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp FROM c
 UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0""")(lambda s, d: EV.roc_curve(scored_test(s, d)))
register("pr_curve", SCB + _CURVE + """SELECT score AS threshold,
 round(cp / (cp + cn), 6) AS precision, round(CASE WHEN P > 0 THEN cp / P END, 6) AS recall,
 CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp FROM c
 UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, 0, 0""")(lambda s, d: EV.pr_curve(scored_test(s, d)))


def _report_sql():
    R = lambda e: f"round({e}, 4)"
    ratio = lambda n, d: f"CASE WHEN {d} > 0 THEN ({n}) / ({d}) ELSE 0.0 END"
    p1, r1, f1 = ratio("tp", "tp+fp"), ratio("tp", "tp+fn"), ratio("2*tp", "2*tp+fp+fn")
    p0, r0, f0 = ratio("tn", "tn+fn"), ratio("tn", "tn+fp"), ratio("2*tn", "2*tn+fp+fn")
    n = "(tn+fp+fn+tp)"
    rows = [("'0'", p0, r0, f0, "tn+fp"), ("'1'", p1, r1, f1, "tp+fn"),
            ("'accuracy'", "NULL", "NULL", ratio("tp+tn", n), n),
            ("'macro avg'", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2", n),
            ("'weighted avg'", ratio(f"({p0})*(tn+fp) + ({p1})*(tp+fn)", n),
             ratio(f"({r0})*(tn+fp) + ({r1})*(tp+fn)", n), ratio(f"({f0})*(tn+fp) + ({f1})*(tp+fn)", n), n)]
    return "\nUNION ALL\n".join(
        f"SELECT {lab} AS label, CAST({R(p)} AS DOUBLE) AS precision, CAST({R(r)} AS DOUBLE) AS recall, "
        f"{R(f)} AS f1_score, CAST({s} AS BIGINT) AS support FROM cnt" for lab, p, r, f, s in rows)


register("classification_report", SCB + f", cnt AS (SELECT {_CONF} FROM scored)\n" + _report_sql())(
    lambda s, d: EV.classification_report(scored_test(s, d)))

_THR = "[" + ", ".join(f"{t:.2f}" for t in S.THRESHOLDS) + "]::DOUBLE[]"
_SWEEP = SCB + _SC + f""", t AS (SELECT unnest({_THR}) AS threshold),
 a AS (SELECT threshold, sum(CASE WHEN score < threshold THEN neg ELSE 0 END) AS tn,
   sum(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS fp,
   sum(CASE WHEN score < threshold THEN pos ELSE 0 END) AS fn,
   sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS tp FROM sc, t GROUP BY threshold)
 SELECT threshold, {_metrics_sql(3)} FROM a"""
register("threshold_sweep", _SWEEP)(lambda s, d: EV.threshold_sweep(scored_test(s, d)))
register("best_threshold", "SELECT * FROM (" + _SWEEP + ") ORDER BY f1_score DESC, threshold LIMIT 1")(
    lambda s, d: EV.best_threshold(EV.threshold_sweep(scored_test(s, d))))

# three deterministic scorers compared on the same test split
_RULE_SCORES = {
    "reference score": None,
    "lead time rule": "round(least(1.0::DOUBLE, lead_time / 365.0::DOUBLE), 4)",
    "history rule": "round(previous_cancellation_rate, 4)",
}


def _rule_score_col(name):
    if name == "lead time rule":
        return F.round(F.least(F.lit(1.0), F.col("lead_time") / F.lit(365.0)), 4)
    if name == "history rule":
        return F.round(F.col("previous_cancellation_rate"), 4)
    return FX.reference_score()


def _compare_query(s, d):
    _, test = split_frames(s, d)
    return EV.compare_models(EV.metrics_by_model(test, {n: _rule_score_col(n) for n in _RULE_SCORES}))


def _compare_sql():
    parts = []
    for n, expr in _RULE_SCORES.items():
        e = O.SCORE_EXPR if expr is None else expr
        parts.append(f"""SELECT '{n}' AS model, {_metrics_sql(6)}, (
  SELECT round(CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (cum_neg + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)) END, 6)
  FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_neg
        FROM (SELECT s AS score, count(*) FILTER (WHERE is_canceled = 1) AS pos, count(*) FILTER (WHERE is_canceled = 0) AS neg
              FROM (SELECT {e} AS s, is_canceled FROM test) WHERE s IS NOT NULL GROUP BY s))) AS roc_auc
 FROM (SELECT count(*) FILTER (WHERE is_canceled = 0 AND NOT coalesce(s >= 0.5, false)) AS tn,
              count(*) FILTER (WHERE is_canceled = 0 AND coalesce(s >= 0.5, false)) AS fp,
              count(*) FILTER (WHERE is_canceled = 1 AND NOT coalesce(s >= 0.5, false)) AS fn,
              count(*) FILTER (WHERE is_canceled = 1 AND coalesce(s >= 0.5, false)) AS tp
       FROM (SELECT {e} AS s, is_canceled FROM test))""")
    return SPB + "\nUNION ALL\n".join(parts)


register("compare_models", _compare_sql())(_compare_query)
register("best_model", "SELECT * FROM (" + _compare_sql() + ") ORDER BY roc_auc DESC, model LIMIT 1")(
    lambda s, d: EV.best_model(_compare_query(s, d)))

# the same with gaps: scores that are missing or NaN, outcomes that are missing
GAPS = SCB.rstrip() + """,
gaps AS (SELECT * REPLACE (CASE WHEN booking_id % 11 = 0 THEN 'nan'::DOUBLE WHEN booking_id % 13 = 0 THEN NULL
   ELSE predicted_cancellation_probability END AS predicted_cancellation_probability,
  CASE WHEN booking_id % 17 = 0 THEN NULL ELSE is_canceled END AS is_canceled) FROM scored),
judged AS (SELECT is_canceled AS y, CASE WHEN NOT isnan(predicted_cancellation_probability)
   THEN predicted_cancellation_probability END AS score FROM gaps WHERE is_canceled IS NOT NULL),
gc AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM judged
  WHERE score IS NOT NULL GROUP BY score)
"""


def gapped_test(spark, d):
    """The scored test split with every 11th score NaN, every 13th missing, every
    17th outcome missing, by booking id."""
    key = F.col(S.BOOKING_ID)
    score = F.when(key % 11 == 0, float("nan")).when(key % 13 == 0, None).otherwise(F.col(S.PROBABILITY))
    return scored_test(spark, d).withColumns({
        S.PROBABILITY: score, S.TARGET: F.when(key % 17 == 0, None).otherwise(F.col(S.TARGET))})


register("roc_auc_gaps", GAPS + """SELECT sum(pos * (cum_neg + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)) AS roc_auc
 FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_neg FROM gc)""")(
    lambda s, d: EV.roc_auc(gapped_test(s, d)))
register("roc_curve_gaps", GAPS + """SELECT score AS threshold,
 round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr,
 CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM gc
 WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
 UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0""")(lambda s, d: EV.roc_curve(gapped_test(s, d)))
register("threshold_sweep_gaps", GAPS + f"""SELECT threshold, {_metrics_sql(3)} FROM (SELECT threshold,
  count(*) FILTER (WHERE y = 0 AND NOT coalesce(score >= threshold, false)) AS tn,
  count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp,
  count(*) FILTER (WHERE y = 1 AND NOT coalesce(score >= threshold, false)) AS fn,
  count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp
 FROM judged, (SELECT unnest({_THR}) AS threshold) GROUP BY threshold)""")(
    lambda s, d: EV.threshold_sweep(gapped_test(s, d)))
register("stratified_split_gaps", FT + """, g AS (SELECT booking_id, CASE WHEN booking_id % 17 = 0 THEN NULL ELSE is_canceled END
  AS is_canceled FROM features), r AS (SELECT *, row_number() OVER (PARTITION BY is_canceled
   ORDER BY md5(CAST(booking_id AS VARCHAR) || '|42'), booking_id) AS rn, count(*) OVER (PARTITION BY is_canceled) AS n FROM g)
SELECT booking_id, is_canceled, CASE WHEN is_canceled IS NULL THEN NULL WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END
 AS split FROM r""")(
    lambda s, d: PP.assign_split(features(s, d).withColumn(
        S.TARGET, F.when(F.col(S.BOOKING_ID) % 17 == 0, None).otherwise(F.col(S.TARGET)))).select(
            S.BOOKING_ID, S.TARGET, "split"))

# every 10th booking a second time under another id
REPEATED = BK.rstrip() + """,
repeated AS (SELECT * FROM bookings UNION ALL SELECT * REPLACE (booking_id + 1000000000 AS booking_id)
  FROM bookings WHERE booking_id % 10 = 0)
"""


def repeated_bookings(spark, d):
    b = bookings(spark, d)
    return b.union(b.where(F.col(S.BOOKING_ID) % 10 == 0).withColumn(S.BOOKING_ID, F.col(S.BOOKING_ID) + 1_000_000_000))


register("duplicate_count_repeated", REPEATED + f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
 FROM (SELECT count(*) AS c FROM repeated GROUP BY {_cols_sql(_NO_ID)})""")(
    lambda s, d: Q.duplicate_count(repeated_bookings(s, d)))
register("drop_duplicates_repeated", REPEATED + f"""SELECT min(booking_id) AS booking_id, {_cols_sql(_NO_ID)}
 FROM repeated GROUP BY {_cols_sql(_NO_ID)}""")(lambda s, d: Q.drop_duplicates(repeated_bookings(s, d)))

# --------------------------------------------------------------------------- decision support
register("risk_tier", SCB + "SELECT booking_id, predicted_cancellation_probability, risk_category FROM scored")(
    lambda s, d: scored_test(s, d).select(S.BOOKING_ID, S.PROBABILITY, S.RISK_CATEGORY))
register("row_revenue_at_risk", SCB + """SELECT booking_id, estimated_booking_value,
 predicted_cancellation_probability, round(estimated_revenue_at_risk, 6) AS estimated_revenue_at_risk FROM scored""")(
    lambda s, d: scored_test(s, d).select(S.BOOKING_ID, "estimated_booking_value", S.PROBABILITY,
                                          F.round(S.REVENUE_AT_RISK, 6).alias(S.REVENUE_AT_RISK)))
register("segment_revenue_exposure", SCB + """SELECT market_segment, count(market_segment) AS booking_count,
 round(avg(predicted_cancellation_probability) * 100, 2) AS avg_predicted_cancellation_probability,
 round(sum(estimated_booking_value), 2) AS total_estimated_booking_value,
 CAST(sum(predicted_is_cancelled) AS BIGINT) AS predicted_at_risk_bookings,
 round(avg(predicted_cancellation_probability) * sum(estimated_booking_value), 2) AS estimated_revenue_at_risk
 FROM scored WHERE market_segment IS NOT NULL GROUP BY market_segment""")(
    lambda s, d: DC.segment_revenue_exposure(scored_test(s, d)))
register("segment_profile", SCB + """SELECT booking_id, hotel, market_segment, customer_type, estimated_booking_value,
 is_canceled AS actual_is_cancelled, predicted_cancellation_probability, predicted_is_cancelled FROM scored""")(
    lambda s, d: DC.segment_profile(scored_test(s, d)))

_RISK_AGGS = """count(*) AS booking_count, round(avg(is_canceled) * 100, 2) AS actual_cancellation_rate,
 round(avg(predicted_cancellation_probability) * 100, 2) AS avg_predicted_cancellation_probability,
 round(avg(predicted_is_cancelled) * 100, 2) AS predicted_cancellation_rate,
 round(sum(estimated_booking_value), 2) AS total_estimated_booking_value"""
for _key in ["market_segment", "customer_type", "hotel"]:
    register(f"segment_risk_{_key}", SCB + f"SELECT {_key}, {_RISK_AGGS} FROM scored WHERE {_key} IS NOT NULL GROUP BY {_key}")(
        lambda s, d, k=_key: DC.segment_risk(DC.segment_profile(scored_test(s, d)), k))
register("segment_risk_all", SCB + f"SELECT dimension, segment, {_RISK_AGGS} FROM (" + _unpivot_sql(
    ["market_segment", "customer_type", "hotel"],
    "SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS segment, is_canceled, predicted_cancellation_probability, "
    "predicted_is_cancelled, estimated_booking_value FROM scored") + ") WHERE segment IS NOT NULL GROUP BY dimension, segment")(
    lambda s, d: DC.segment_risk_all(DC.segment_profile(scored_test(s, d))))

_DASH = """SELECT market_segment, count(market_segment) AS booking_count,
 round(avg(predicted_cancellation_probability) * 100, 2) AS avg_predicted_risk,
 CAST(sum(predicted_is_cancelled) AS BIGINT) AS predicted_at_risk_bookings,
 round(sum(estimated_revenue_at_risk), 2) AS estimated_revenue_at_risk
 FROM scored WHERE market_segment IS NOT NULL GROUP BY market_segment"""
register("dashboard_by_segment", SCB + _DASH)(lambda s, d: DC.dashboard_by_segment(scored_test(s, d)))
register("dashboard_totals", SCB + """SELECT count(*) AS total_bookings,
 round(avg(predicted_cancellation_probability), 6) AS avg_predicted_risk,
 round(sum(estimated_revenue_at_risk), 2) AS total_revenue_at_risk,
 format('{:,.1f}', avg(predicted_cancellation_probability) * 100) || '%' AS avg_predicted_risk_text,
 '€' || format('{:,.2f}', sum(estimated_revenue_at_risk)) AS total_revenue_at_risk_text FROM scored""")(
    lambda s, d: DC.dashboard_totals(scored_test(s, d)))
register("tier_counts", SCB + """SELECT count(*) FILTER (WHERE risk_category = 'High Risk') AS high_risk_bookings,
 count(*) FILTER (WHERE risk_category = 'Medium Risk') AS medium_risk_bookings,
 count(*) FILTER (WHERE risk_category = 'Low Risk') AS low_risk_bookings FROM scored""")(
    lambda s, d: DC.tier_counts(scored_test(s, d)))
register("top_segment", SCB + f"""SELECT market_segment, booking_count, estimated_revenue_at_risk,
 'The assistant identifies ' || market_segment || ' as the segment with the highest estimated revenue at risk. '
 || 'This segment contains ' || format('{{:,d}}', booking_count) || ' bookings and an estimated revenue exposure of '
 || '€' || format('{{:,.2f}}', estimated_revenue_at_risk) || '.' AS summary
 FROM ({_DASH}) ORDER BY estimated_revenue_at_risk DESC, market_segment LIMIT 1""")(
    lambda s, d: DC.top_segment(DC.dashboard_by_segment(scored_test(s, d))))
register("scored_preview", SCB + """SELECT booking_id, hotel, market_segment, customer_type, estimated_booking_value,
 predicted_cancellation_probability, risk_category, estimated_revenue_at_risk FROM scored""")(
    lambda s, d: DC.scored_preview(scored_test(s, d)))

def _driver_sql(col, op, value, text):
    shown = f"'{value}'" if isinstance(value, str) else value
    return f"CASE WHEN {col} {'=' if op == '==' else op} {shown} THEN '{text}' END"


_RULES = "list_filter([" + ", ".join(_driver_sql(*r) for r in S.RISK_DRIVER_RULES) + "], lambda x: x IS NOT NULL)"
_DRIVERS = (f"CASE WHEN len({_RULES}) = 0 THEN ['{S.NO_DRIVER_TEXT}'] "
            f"ELSE {_RULES}[1:{S.MAX_DRIVERS}] END")
_ACTIONS = "CASE " + " ".join(
    f"WHEN risk_category = '{k}' THEN [" + ", ".join("'" + a + "'" for a in v) + "]"
    for k, v in S.RECOMMENDED_ACTIONS.items() if k != "Low Risk") + " ELSE [" + ", ".join(
    "'" + a + "'" for a in S.RECOMMENDED_ACTIONS["Low Risk"]) + "] END"
_SUMMARY = """'This booking is classified as **' || risk_category || '** with an estimated cancellation probability of **'
 || format('{:,.1f}', predicted_cancellation_probability * 100) || '%' || '**.' || chr(10) || chr(10) || 'The booking belongs to **'
 || coalesce(hotel, 'this hotel') || '**, comes through the **' || coalesce(market_segment, 'unknown segment')
 || '** segment, and is associated with the **' || coalesce(customer_type, 'unknown customer type')
 || '** customer type.' || chr(10) || chr(10) || 'Based on the model output, this booking should be reviewed as part of the hotel''s cancellation-risk monitoring process.'"""
register("risk_drivers", SCB + f"SELECT booking_id, {_DRIVERS} AS risk_drivers FROM scored")(
    lambda s, d: (lambda sc: sc.select(S.BOOKING_ID, DC.risk_drivers(sc).alias("risk_drivers")))(scored_test(s, d)))
register("recommended_actions", SCB + f"SELECT booking_id, risk_category, {_ACTIONS} AS recommended_actions FROM scored")(
    lambda s, d: scored_test(s, d).select(S.BOOKING_ID, S.RISK_CATEGORY,
                                          DC.recommended_actions().alias("recommended_actions")))
register("booking_summary", SCB + f"SELECT booking_id, {_SUMMARY} AS assistant_summary FROM scored")(
    lambda s, d: (lambda sc: sc.select(S.BOOKING_ID, DC.booking_summary(sc).alias("assistant_summary")))(
        scored_test(s, d)))
register("format_currency", SCB + """SELECT booking_id,
 '€' || format('{:,.2f}', estimated_booking_value) AS booking_value_text FROM scored""")(
    lambda s, d: scored_test(s, d).select(S.BOOKING_ID,
                                          DC.format_currency("estimated_booking_value").alias("booking_value_text")))
register("review_booking", SCB + f"""SELECT booking_id, hotel, market_segment, customer_type, lead_time, adr,
 total_nights, total_of_special_requests, deposit_type, estimated_booking_value, predicted_cancellation_probability,
 CASE WHEN predicted_cancellation_probability >= 0.55 THEN 'Likely Cancelled' ELSE 'Likely Not Cancelled' END AS model_decision,
 risk_category, {_DRIVERS} AS risk_drivers, {_ACTIONS} AS recommended_actions, {_SUMMARY} AS assistant_summary
 FROM scored ORDER BY md5(CAST(booking_id AS VARCHAR) || '|42'), booking_id LIMIT 1""")(
    lambda s, d: DC.review_sample(scored_test(s, d), 500, 42, 0))

# --------------------------------------------------------------------------- models (rows-only checks)
import uuid  # noqa: E402

from ..operators import models as MD  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources.keyed import write_keyed  # noqa: E402
from .flows import scoring_flow  # noqa: E402


def _fit_and_score(kind):
    def q(s, d):
        tr, te = split_frames(s, d)
        b = MD.fit_bundle(tr, kind)
        return MD.score_bundle(te, b).select(S.BOOKING_ID, S.TARGET, S.PROBABILITY, S.PREDICTION)
    return q


register("fit_logistic")(_fit_and_score("logistic"))
register("fit_forest")(_fit_and_score("forest"))
register("fit_boosted")(_fit_and_score("boosted"))


def _fitted_comparison(s, d):
    """The four models of the comparison from one feature matrix, their test
    probabilities from one scored table."""
    tr, te = split_frames(s, d)
    scored, names = MD.score_all(te, MD.fit_bundles(tr))
    return EV.compare_models(EV.metrics_by_model(scored, {k: F.col(n) for k, n in names.items()}))


register("compare_fitted_models")(_fitted_comparison)
register("feature_importance")(
    lambda s, d: MD.feature_importance(MD.fit_bundle(split_frames(s, d)[0], "forest"), 15))
register("linear_attribution")(
    lambda s, d: (lambda tr, te: (lambda b: MD.linear_attribution(b.model.transform(te), b, 15))(
        MD.fit_bundle(tr, "logistic")))(*split_frames(s, d)))
register("assert_finite", SPB + "SELECT 0::BIGINT AS non_finite_rows, count(*) AS rows FROM test")(
    lambda s, d: (lambda tr, te: Q.assert_finite(PP.fit_preprocessor(tr).transform(te)))(*split_frames(s, d)))

_WEIGHTS = {"lead_time": 0.01, "adr": -0.002, "total_of_special_requests": -0.5, "babies": 0.0, "total_nights": 0.25}
register("attribution", FT + ", m AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _WEIGHTS) + " FROM features)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg(abs({w}::DOUBLE * ({c} - m_{c}))), 9) AS mean_abs_attribution, "
    f"CAST(CASE WHEN any_value(v_{c}) > 0 AND {w} <> 0 THEN sign({w}) END AS DOUBLE) AS direction FROM features, m"
    for c, w in _WEIGHTS.items()))(
    lambda s, d: MD.attribution(features(s, d), _WEIGHTS).withColumn(
        "mean_abs_attribution", F.round("mean_abs_attribution", 9)))

# within a group, inputs stand in the order of the feature table
_FRAME = [f.name for f in S.RAW_BOOKING_SCHEMA.fields] + FE.engineered_columns()
_BINARY_ORDER = [c for c in _FRAME if c in S.BINARY_FEATURES]
_NOMINAL_ORDER = [c for c in _FRAME if c in S.NOMINAL_FEATURES]
_ORDINAL_ORDER = ["lead_time_bucket", "adr_bucket", "stay_length_category"]

register("feature_names", SPB + "SELECT CAST(row_number() OVER (ORDER BY g, p, v) - 1 AS INTEGER) AS position, name FROM (" +
         "\nUNION ALL\n".join(
             [f"SELECT 0 AS g, {i} AS p, '' AS v, '{c}' AS name" for i, c in enumerate(_NUM)]
             + [f"SELECT DISTINCT 1, {i}, CAST({c} AS VARCHAR), '{c}_' || CAST({c} AS VARCHAR) FROM train WHERE {c} IS NOT NULL"
                for i, c in enumerate(_NOMINAL_ORDER)]
             + [f"SELECT 2, {i}, '', '{c}'" for i, c in enumerate(_ORDINAL_ORDER)]
             + [f"SELECT 3, {i}, '', '{c}'" for i, c in enumerate(_BINARY_ORDER)]) + ")")(
    lambda s, d: s.createDataFrame(list(enumerate(PP.feature_names(PP.fit_preprocessor(split_frames(s, d)[0])))),
                                   "position int, name string"))


def _model_checks(s, d):
    """What must hold of the models, on the planted label, one row a check: they
    rank (AUC above 0.75), the linear one is at the optimum of its objective,
    importances add up to 1, a saved bundle scores alike, inputs are finite.
    Ensembles are smaller than the operators' own sizes."""
    label = "planted_label"
    tr, te = PP.stratified_split(FX.with_planted_label(features(s, d)), target=label)
    bundles = MD.fit_bundles(tr, label=label, params={
        "forest": {"num_trees": 20, "max_depth": 6}, "boosted": {"max_iter": 20}, "boosted_balanced": {"max_iter": 20}})
    scored, names = MD.score_all(te, bundles)
    metrics = {r["model"]: r["roc_auc"] for r in EV.metrics_by_model(
        scored, {k: F.col(n) for k, n in names.items()}, y=label).collect()}
    checks = [(k, "ranks the planted label", metrics[k] > 0.75) for k in bundles]
    linear = bundles["logistic"]
    matrix = MD.preprocessor_of(linear).transform(PP.class_weights(tr, label))
    checks.append(("logistic", "gradient is zero",
                   MD.penalised_gradient(matrix, MD.classifier_of(linear), label, "weight") < 1e-3))
    finite = Q.assert_finite(MD.preprocessor_of(linear).transform(te)).first()
    checks.append(("logistic", "inputs are finite", finite["non_finite_rows"] == 0 and finite["rows"] > 0))
    for k in ("forest", "boosted", "boosted_balanced"):
        total = MD.feature_importance(bundles[k], None).agg(F.sum("importance")).first()[0]
        checks.append((k, "importances sum to one", abs(total - 1) < 1e-9))
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/bundles/{uuid.uuid4().hex}"
    MD.save_bundle(linear, path)
    again = MD.score_bundle(te, MD.load_bundle(s, path)).select(S.BOOKING_ID, F.col(S.PROBABILITY).alias("p"))
    apart = MD.score_bundle(te, linear).join(again, S.BOOKING_ID).agg(
        F.max(F.abs(F.col(S.PROBABILITY) - F.col("p")))).first()[0]
    checks.append(("logistic", "saved bundle scores alike", apart == 0))
    return s.createDataFrame(checks, "model string, check string, holds boolean")


register("model_checks", "SELECT *, true AS holds FROM (VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in [
    *[(k, "ranks the planted label") for k in MD.KINDS],
    ("logistic", "gradient is zero"), ("logistic", "inputs are finite"),
    *[(k, "importances sum to one") for k in ("forest", "boosted", "boosted_balanced")],
    ("logistic", "saved bundle scores alike")]) + ") t(model, \"check\")")(_model_checks)


def _score_batch(s, d):
    """The app's upload: raw bookings without outcome and key, scored in a batch by
    a saved bundle with the thresholds it keeps; here the planted probability
    stands in for the outcome so that the result can be told."""
    raw = written(bookings(s, d), "bookings")
    label = "planted_label"
    limits = FE.fit_value_thresholds(raw)
    f = FE.derive_features(raw, limits)
    bundle = MD.fit_bundle(FX.with_planted_label(f), "logistic", label=label)
    bundle.value_thresholds = limits
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/bundles/{uuid.uuid4().hex}"
    MD.save_bundle(bundle, path)
    batch = raw.select(*S.SCORING_COLUMNS)
    scored, out = scoring_flow(batch, MD.load_bundle(s, path))
    tiers = out["tiers"].first()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(S.PROBABILITY).between(0, 1)).alias("scored_rows"),
        F.round(F.sum("estimated_booking_value"), 2).alias("total_estimated_booking_value"),
        F.sum("is_high_adr").alias("high_adr_rows"), F.sum("is_high_value_booking").alias("high_value_rows")
    ).withColumn("tiered_rows", F.lit(sum(tiers)).cast("long"))


register("score_batch", FT + """SELECT count(*) AS rows, count(*) AS scored_rows,
 round(sum(estimated_booking_value), 2) AS total_estimated_booking_value,
 CAST(sum(is_high_adr) AS BIGINT) AS high_adr_rows, CAST(sum(is_high_value_booking) AS BIGINT) AS high_value_rows,
 count(*) AS tiered_rows FROM features""")(_score_batch)


def _review_by_key(s, d):
    """O-84 by key: the scored table is written for lookups, then one booking is
    read back by its key and reviewed."""
    scored = write_keyed(scored_test(s, d), f"{ensure_checkpoint_dir(s).rstrip('/')}/scored/{uuid.uuid4().hex}",
                         S.BOOKING_ID)
    return DC.review_booking(scored, scored.agg(F.max(S.BOOKING_ID)).first()[0])


register("review_booking_by_key", ORACLE["review_booking"].replace(
    "ORDER BY md5(CAST(booking_id AS VARCHAR) || '|42'), booking_id LIMIT 1", "ORDER BY booking_id DESC LIMIT 1"))(
    _review_by_key)


def _bundle_roundtrip(s, d):
    tr, te = split_frames(s, d)
    b = MD.fit_bundle(tr, "logistic")
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/bundles/{uuid.uuid4().hex}"
    MD.save_bundle(b, path)
    loaded = MD.load_bundle(s, path)
    return MD.score_bundle(te, loaded).select(S.BOOKING_ID, S.PROBABILITY, S.PREDICTION)


register("bundle_roundtrip")(_bundle_roundtrip)


# --------------------------------------------------------------------------- sources: file round trip
def _csv_roundtrip(s, d):
    """O-01 / O-02: write the bookings table as CSV with a header under the
    shared folder, read it back with the declared schema."""
    from ..sources.bookings import read_bookings, write_bookings
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/csv/{uuid.uuid4().hex}"
    write_bookings(bookings(s, d), path, fmt="csv")
    return read_bookings(s, path, fmt="csv")


register("csv_roundtrip", BK + "SELECT * FROM bookings")(_csv_roundtrip)
def _csv_mixed_headers(s, d):
    """O-01: files as data-frame tools write them (whole numbers as ``2.0``,
    ``NaN`` for a missing value), half of them with the columns reversed."""
    from ..sources.bookings import read_bookings, write_bookings
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/csv/{uuid.uuid4().hex}"
    b = written(bookings(s, d), "bookings")  # read for either half
    shown = b.select(*[F.coalesce(F.col(f.name).cast("double").cast("string"), F.lit("NaN")).alias(f.name)
                       if f.dataType.typeName() in ("integer", "double") else F.col(f.name) for f in b.schema.fields])
    odd = F.col("booking_id") % 2 == 1
    write_bookings(shown.where(odd), f"{path}/odd", fmt="csv")
    write_bookings(shown.where(~odd).select(*reversed(b.columns)), f"{path}/even", fmt="csv")
    return read_bookings(s, f"{path}/*", fmt="csv", mixed_headers=True)


register("csv_mixed_headers", BK + "SELECT * FROM bookings")(_csv_mixed_headers)
register("permutation_importance")(
    lambda s, d: (lambda tr, te: MD.permutation_importance(te, MD.fit_bundle(tr, "forest")))(*split_frames(s, d)))
