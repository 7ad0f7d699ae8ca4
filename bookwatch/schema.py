"""Column names, feature groups and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

BOOKING_ID = "booking_id"
TARGET = "is_canceled"
PROBABILITY = "predicted_cancellation_probability"
PREDICTION = "predicted_is_cancelled"
RISK_CATEGORY = "risk_category"
REVENUE_AT_RISK = "estimated_revenue_at_risk"

# ---------------------------------------------------------------------------
# These must equal the reference's for right results.
# (Bucket labels use the ASCII hyphen everywhere, so labelling and ordinal
# encoding share one definition.)
# ---------------------------------------------------------------------------
LEAD_TIME_EDGES = [0, 30, 90, 180, 365, 800]
LEAD_TIME_LABELS = ["0-30 Days", "31-90 Days", "91-180 Days", "181-365 Days", "365+ Days"]
ADR_EDGES = [0, 50, 100, 150, 200, 300, float("inf")]
ADR_LABELS = ["0-50", "51-100", "101-150", "151-200", "201-300", "300+"]
INVALID_ADR = "Invalid ADR"
ADR_ORDER = ADR_LABELS + [INVALID_ADR]
STAY_LENGTH_ORDER = ["Zero-night stay", "Short stay", "Medium stay", "Long stay", "Extended stay"]
MONTHS = ["January", "February", "March", "April", "May", "June",
          "July", "August", "September", "October", "November", "December"]
SEASONS = {"Winter": ["December", "January", "February"],
           "Spring": ["March", "April", "May"],
           "Summer": ["June", "July", "August"]}
SEASON_DEFAULT = "Autumn"
PEAK_MONTHS = ["April", "May", "June", "July", "August"]
OUTCOME_LABELS = {0: "Not Cancelled", 1: "Cancelled"}
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
HIGH_RISK_CUTOFF = 0.70
DEFAULT_THRESHOLD = 0.55
RISK_LABELS = ["High Risk", "Medium Risk", "Low Risk"]
LEAKAGE_COLUMNS = ["reservation_status", "reservation_status_date"]
MODEL_EXCLUDE = ["arrival_date_month", "country", "reserved_room_type", "assigned_room_type",
                 "meal", "agent", "company"]
TRANSFORM_PREFIXES = ["numeric__", "nominal__", "ordinal__", "binary__"]

# Risk-driver rules in evaluation order: (column, comparison, value, message).
RISK_DRIVER_RULES = [
    ("lead_time", ">=", 90, "Long lead time may increase cancellation uncertainty."),
    ("market_segment", "==", "Online TA", "Online travel agency bookings showed higher cancellation risk."),
    ("total_of_special_requests", "==", 0, "No special requests may indicate lower guest engagement."),
    ("previous_cancellation_rate", ">", 0, "Previous cancellation behaviour increases predicted risk."),
    ("deposit_type", "==", "No Deposit", "No deposit may reduce booking commitment."),
    ("customer_type", "==", "Transient", "Transient customers showed higher cancellation concentration."),
    ("is_last_minute_booking", "==", 1, "Last-minute booking behaviour is an important model signal."),
    ("room_type_changed", "==", 1, "Room type change is a strong model signal for this booking."),
]
NO_DRIVER_TEXT = "No major individual risk driver was detected from the selected business rules."
MAX_DRIVERS = 5
RECOMMENDED_ACTIONS = {
    "High Risk": [
        "Send a personalised confirmation message immediately.",
        "Offer a small upgrade, add-on, or flexible stay incentive.",
        "Monitor the booking closer to arrival.",
        "Consider controlled overbooking only if operationally safe.",
        "Prioritise this booking in revenue-protection workflows.",
    ],
    "Medium Risk": [
        "Send a reminder or pre-arrival engagement message.",
        "Offer optional add-ons to increase guest commitment.",
        "Track the booking as part of the cancellation watchlist.",
    ],
    "Low Risk": [
        "No urgent intervention required.",
        "Continue standard pre-arrival communication.",
        "Use this booking as part of normal occupancy planning.",
    ],
}
SUMMARY_DEFAULTS = {"hotel": "this hotel", "market_segment": "unknown segment",
                    "customer_type": "unknown customer type"}
SUMMARY_TEMPLATE = (
    "This booking is classified as **{risk}** with an estimated cancellation probability of "
    "**{pct}**.\n\nThe booking belongs to **{hotel}**, comes through the **{segment}** segment, "
    "and is associated with the **{customer}** customer type.\n\nBased on the model output, this "
    "booking should be reviewed as part of the hotel's cancellation-risk monitoring process."
)
TOP_SEGMENT_TEMPLATE = (
    "The assistant identifies {segment} as the segment with the highest estimated revenue at "
    "risk. This segment contains {count} bookings and an estimated revenue exposure of {value}."
)
CURRENCY_SYMBOL = "€"

# Columns the feature notebook requires before deriving anything.
REQUIRED_COLUMNS = [
    "is_canceled", "lead_time", "adr", "stays_in_weekend_nights", "stays_in_week_nights",
    "adults", "children", "babies", "previous_cancellations", "booking_changes",
    "total_of_special_requests", "deposit_type", "customer_type", "market_segment", "hotel",
    "arrival_date_month",
]

# Model inputs that are not taken as plain numbers; every other number of a
# feature table but the excluded ones is a numeric input (operators.preprocess.model_groups).
NOMINAL_FEATURES = ["hotel", "market_segment", "distribution_channel", "deposit_type",
                    "customer_type", "arrival_season"]
ORDINAL_FEATURES = {"lead_time_bucket": LEAD_TIME_LABELS, "adr_bucket": ADR_ORDER,
                    "stay_length_category": STAY_LENGTH_ORDER}
BINARY_FEATURES = [
    "is_repeated_guest", "has_invalid_adr", "is_zero_night_stay", "is_weekend_stay",
    "is_last_minute_booking", "is_long_lead_booking", "is_peak_season",
    "has_previous_cancellation", "has_previous_successful_booking", "has_booking_changes",
    "has_special_requests", "is_waitlisted", "repeat_guest_with_deposit",
    "repeat_guest_non_refund", "is_zero_adr", "is_high_adr", "is_high_value_booking",
    "room_type_changed",
]
# --------------------------------------------------------------------------- end fixed values

# Explicit schema for reading raw booking files (never inferred).
RAW_BOOKING_SCHEMA = T.StructType([
    T.StructField("booking_id", T.LongType()),
    T.StructField("hotel", T.StringType()),
    T.StructField("is_canceled", T.IntegerType()),
    T.StructField("lead_time", T.IntegerType()),
    T.StructField("arrival_date_year", T.IntegerType()),
    T.StructField("arrival_date_month", T.StringType()),
    T.StructField("arrival_date_week_number", T.IntegerType()),
    T.StructField("arrival_date_day_of_month", T.IntegerType()),
    T.StructField("stays_in_weekend_nights", T.IntegerType()),
    T.StructField("stays_in_week_nights", T.IntegerType()),
    T.StructField("adults", T.IntegerType()),
    T.StructField("children", T.IntegerType()),
    T.StructField("babies", T.IntegerType()),
    T.StructField("meal", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("market_segment", T.StringType()),
    T.StructField("distribution_channel", T.StringType()),
    T.StructField("is_repeated_guest", T.IntegerType()),
    T.StructField("previous_cancellations", T.IntegerType()),
    T.StructField("previous_bookings_not_canceled", T.IntegerType()),
    T.StructField("reserved_room_type", T.StringType()),
    T.StructField("assigned_room_type", T.StringType()),
    T.StructField("booking_changes", T.IntegerType()),
    T.StructField("deposit_type", T.StringType()),
    T.StructField("agent", T.IntegerType()),
    T.StructField("company", T.IntegerType()),
    T.StructField("days_in_waiting_list", T.IntegerType()),
    T.StructField("customer_type", T.StringType()),
    T.StructField("adr", T.DoubleType()),
    T.StructField("required_car_parking_spaces", T.IntegerType()),
    T.StructField("total_of_special_requests", T.IntegerType()),
    T.StructField("reservation_status", T.StringType()),
    T.StructField("reservation_status_date", T.DateType()),
])

# Raw columns that a batch to be scored needs: no outcome, no key, and none that
# the model leaves out unless a feature is derived from it.
SCORING_COLUMNS = [f.name for f in RAW_BOOKING_SCHEMA.fields
                   if f.name not in (BOOKING_ID, TARGET, *LEAKAGE_COLUMNS)
                   and (f.name not in MODEL_EXCLUDE
                        or f.name in ("arrival_date_month", "reserved_room_type", "assigned_room_type"))]
