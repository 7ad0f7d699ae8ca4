"""Independent SQL (DuckDB dialect) for every SQL-expressible query.

Each entry is a complete statement over the provided tables. Common table
expressions are shared as text so every oracle derives ``bookings`` and the
feature columns the same way, independently of the Spark code.
"""

from __future__ import annotations

BOOKINGS = """
l AS (
  SELECT l_orderkey AS k, min(l_shipdate) AS ship,
    sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS wknd,
    sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS wk,
    sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS chg,
    sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS req,
    max(CASE WHEN l_discount>=0.1 THEN 1 ELSE 0 END) AS park,
    min(p_type) AS res, max(p_type) AS asg,
    count(*) AS n_lines,
    sum(CASE WHEN l_quantity>45 THEN 1 ELSE 0 END) AS kids
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY l_orderkey),
b0 AS (
  SELECT o.*, c_nationkey, c_mktsegment, c_acctbal, n_name, n_regionkey, r_name, l.*,
    CAST(coalesce(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER) AS prev_c,
    CAST(coalesce(sum(CASE WHEN o_orderstatus<>'F' THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER) AS prev_nc
  FROM orders o JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
    JOIN region ON n_regionkey=r_regionkey LEFT JOIN l ON o_orderkey=l.k
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bookings AS (
  SELECT o_orderkey AS booking_id,
    CASE WHEN n_regionkey<3 THEN 'City Hotel' ELSE 'Resort Hotel' END AS hotel,
    CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS is_canceled,
    CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(ship AS DATE))) % 737 AS INTEGER) AS lead_time,
    CAST(year(o_orderdate) AS INTEGER) AS arrival_date_year,
    monthname(o_orderdate) AS arrival_date_month,
    CAST(weekofyear(o_orderdate) AS INTEGER) AS arrival_date_week_number,
    CAST(day(o_orderdate) AS INTEGER) AS arrival_date_day_of_month,
    CAST(coalesce(wknd,0) AS INTEGER) AS stays_in_weekend_nights,
    CAST(coalesce(wk,0) AS INTEGER) AS stays_in_week_nights,
    CAST(coalesce(n_lines,0) AS INTEGER) AS adults,
    CAST(kids AS INTEGER) AS children,
    CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS babies,
    CASE WHEN starts_with(o_orderpriority,'1') THEN 'FB' WHEN starts_with(o_orderpriority,'2') THEN 'HB'
         WHEN starts_with(o_orderpriority,'3') THEN 'BB' WHEN starts_with(o_orderpriority,'4') THEN 'SC'
         ELSE 'Undefined' END AS meal,
    n_name AS country, c_mktsegment AS market_segment, r_name AS distribution_channel,
    CASE WHEN prev_c + prev_nc > 0 THEN 1 ELSE 0 END AS is_repeated_guest,
    prev_c AS previous_cancellations, prev_nc AS previous_bookings_not_canceled,
    res AS reserved_room_type, asg AS assigned_room_type,
    CAST(coalesce(chg,0) AS INTEGER) AS booking_changes,
    CASE WHEN o_orderpriority='1-URGENT' THEN 'Non Refund' WHEN o_orderpriority='5-LOW' THEN 'Refundable'
         ELSE 'No Deposit' END AS deposit_type,
    CAST(o_custkey % 400 AS INTEGER) AS agent,
    CAST(CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 END AS INTEGER) AS company,
    CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 7 ELSE 0 END AS INTEGER) AS days_in_waiting_list,
    CASE c_nationkey % 4 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Transient-Party' WHEN 2 THEN 'Contract'
         ELSE 'Group' END AS customer_type,
    CAST(round((CAST(o_totalprice AS DECIMAL(18,2)) - 5000) * 0.001, 2) AS DOUBLE) AS adr,
    CAST(coalesce(park,0) AS INTEGER) AS required_car_parking_spaces,
    CAST(coalesce(req,0) AS INTEGER) AS total_of_special_requests,
    CASE WHEN o_orderstatus='F' THEN 'Canceled' ELSE 'Check-Out' END AS reservation_status,
    CAST(coalesce(ship, o_orderdate) AS DATE) AS reservation_status_date
  FROM b0)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

EDA = """
eda AS (
  SELECT *, stays_in_weekend_nights + stays_in_week_nights AS total_nights,
    adr * (stays_in_weekend_nights + stays_in_week_nights) AS estimated_booking_value,
    CASE WHEN lead_time >= 0 AND lead_time <= 30 THEN '0-30 Days'
         WHEN lead_time > 30 AND lead_time <= 90 THEN '31-90 Days'
         WHEN lead_time > 90 AND lead_time <= 180 THEN '91-180 Days'
         WHEN lead_time > 180 AND lead_time <= 365 THEN '181-365 Days'
         WHEN lead_time > 365 AND lead_time <= 800 THEN '365+ Days' END AS lead_time_bucket,
    CASE WHEN adr >= 0 AND adr <= 50 THEN '0-50' WHEN adr > 50 AND adr <= 100 THEN '51-100'
         WHEN adr > 100 AND adr <= 150 THEN '101-150' WHEN adr > 150 AND adr <= 200 THEN '151-200'
         WHEN adr > 200 AND adr <= 300 THEN '201-300' WHEN adr > 300 THEN '300+' END AS adr_bucket
  FROM bookings)
"""

FEATURES = """
fq AS (
  SELECT quantile_cont(adr, 0.75) AS adr_q,
         quantile_cont(adr * (stays_in_weekend_nights + stays_in_week_nights), 0.75) AS value_q
  FROM bookings),
features AS (
  SELECT * EXCLUDE (adr_bucket, adr_q, value_q),
    coalesce(adr_bucket, 'Invalid ADR') AS adr_bucket,
    CASE WHEN adr < 0 THEN 1 ELSE 0 END AS has_invalid_adr,
    CASE WHEN total_nights = 0 THEN 1 ELSE 0 END AS is_zero_night_stay,
    CASE WHEN stays_in_weekend_nights > 0 THEN 1 ELSE 0 END AS is_weekend_stay,
    CASE WHEN total_nights = 0 THEN 'Zero-night stay' WHEN total_nights <= 2 THEN 'Short stay'
         WHEN total_nights <= 5 THEN 'Medium stay' WHEN total_nights <= 10 THEN 'Long stay'
         ELSE 'Extended stay' END AS stay_length_category,
    CASE WHEN lead_time <= 7 THEN 1 ELSE 0 END AS is_last_minute_booking,
    CASE WHEN lead_time >= 90 THEN 1 ELSE 0 END AS is_long_lead_booking,
    CAST(list_position(['January','February','March','April','May','June','July','August',
         'September','October','November','December'], arrival_date_month) AS INTEGER) AS arrival_month_number,
    CASE WHEN arrival_date_month IN ('December','January','February') THEN 'Winter'
         WHEN arrival_date_month IN ('March','April','May') THEN 'Spring'
         WHEN arrival_date_month IN ('June','July','August') THEN 'Summer' ELSE 'Autumn' END AS arrival_season,
    CASE WHEN arrival_date_month IN ('April','May','June','July','August') THEN 1 ELSE 0 END AS is_peak_season,
    CASE WHEN previous_cancellations > 0 THEN 1 ELSE 0 END AS has_previous_cancellation,
    CASE WHEN previous_bookings_not_canceled > 0 THEN 1 ELSE 0 END AS has_previous_successful_booking,
    CASE WHEN booking_changes > 0 THEN 1 ELSE 0 END AS has_booking_changes,
    CASE WHEN total_of_special_requests > 0 THEN 1 ELSE 0 END AS has_special_requests,
    CASE WHEN days_in_waiting_list > 0 THEN 1 ELSE 0 END AS is_waitlisted,
    previous_cancellations + previous_bookings_not_canceled AS previous_total_bookings,
    CASE WHEN previous_cancellations + previous_bookings_not_canceled > 0
         THEN previous_cancellations / (previous_cancellations + previous_bookings_not_canceled)
         ELSE 0.0 END AS previous_cancellation_rate,
    CASE WHEN is_repeated_guest = 1 AND (deposit_type IS NULL OR deposit_type <> 'No Deposit') THEN 1 ELSE 0 END
      AS repeat_guest_with_deposit,
    CASE WHEN is_repeated_guest = 1 AND deposit_type = 'Non Refund' THEN 1 ELSE 0 END AS repeat_guest_non_refund,
    CASE WHEN adr = 0 THEN 1 ELSE 0 END AS is_zero_adr,
    CASE WHEN adr >= adr_q THEN 1 ELSE 0 END AS is_high_adr,
    CASE WHEN estimated_booking_value >= value_q THEN 1 ELSE 0 END AS is_high_value_booking,
    CASE WHEN reserved_room_type = assigned_room_type THEN 0 ELSE 1 END AS room_type_changed
  FROM eda CROSS JOIN fq)
"""

# the usual prefix: bookings -> eda -> features
BASE = with_ctes(BOOKINGS, EDA, FEATURES)
EDA_BASE = with_ctes(BOOKINGS, EDA)

# exact stratified 80/20 split (per class, smallest md5(key|42) first) and the
# deterministic score used by the evaluation and decision queries
SPLIT = """
split AS (
  SELECT *, row_number() OVER (PARTITION BY is_canceled
              ORDER BY md5(CAST(booking_id AS VARCHAR) || '|42'), booking_id) AS __rn,
         count(*) OVER (PARTITION BY is_canceled) AS __ny
  FROM features),
train AS (SELECT * EXCLUDE (__rn, __ny) FROM split WHERE NOT (__rn <= round(0.2 * __ny))),
test AS (SELECT * EXCLUDE (__rn, __ny) FROM split WHERE __rn <= round(0.2 * __ny))
"""

SCORE_EXPR = """round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
   0.08::DOUBLE + 0.35::DOUBLE * (CASE WHEN coalesce(lead_time, 0) >= 365 THEN 1 ELSE 0 END)::DOUBLE
   + 0.40::DOUBLE * (CASE WHEN deposit_type = 'Non Refund' THEN 1 ELSE 0 END)::DOUBLE
   - 0.07::DOUBLE * (CASE WHEN total_of_special_requests >= 2 THEN 1 ELSE 0 END)::DOUBLE
   + 0.1::DOUBLE * (('0x' || substr(md5(CAST(booking_id AS VARCHAR) || '|3'), 1, 7))::BIGINT / 268435456.0::DOUBLE
                    - 0.5::DOUBLE))), 4)"""

SCORED = f"""
scored0 AS (SELECT *, {SCORE_EXPR} AS predicted_cancellation_probability FROM test),
scored AS (
  SELECT *, CASE WHEN predicted_cancellation_probability >= 0.55 THEN 1 ELSE 0 END AS predicted_is_cancelled,
    CASE WHEN predicted_cancellation_probability >= 0.7 THEN 'High Risk'
         WHEN predicted_cancellation_probability >= 0.55 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_category,
    predicted_cancellation_probability * estimated_booking_value AS estimated_revenue_at_risk
  FROM scored0)
"""

SCORED_BASE = with_ctes(BOOKINGS, EDA, FEATURES, SPLIT, SCORED)
SPLIT_BASE = with_ctes(BOOKINGS, EDA, FEATURES, SPLIT)
