"""Feature derivation (EDA enrichment and the 22 engineered columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.quantiles import quantiles


def enrich_eda(df: DataFrame, fill_invalid_adr: bool = False) -> DataFrame:
    """Add ``total_nights``, ``estimated_booking_value`` (= adr x nights),
    ``lead_time_bucket`` and ``adr_bucket`` in one projection."""
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    return df.withColumns({
        "total_nights": nights,
        "estimated_booking_value": F.col("adr") * nights,
        "lead_time_bucket": C.lead_time_bucket("lead_time"),
        "adr_bucket": C.adr_bucket_filled("adr") if fill_invalid_adr else C.adr_bucket("adr"),
    })


def fit_value_thresholds(df: DataFrame, q: float = 0.75) -> dict:
    """75th percentiles (exact, linear interpolation, nulls skipped) of ``adr``
    and of the booking value. ``df`` is the frame the thresholds are learnt from:
    the whole table (as the notebooks did) or the training split (no leakage)."""
    value = F.col("adr") * (F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"))
    found = quantiles(df, {"adr_q": F.col("adr"), "value_q": value}, [q])
    return {name: v[0] for name, v in found.items()}


def derive_features(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """All engineered columns as one projection over ``df``.

    ``thresholds`` comes from :func:`fit_value_thresholds` (numbers, e.g.
    fitted on a training split); when omitted they are fitted on ``df``
    itself, which evaluates it once more.
    """
    if thresholds is None:
        thresholds = fit_value_thresholds(df)
    base = enrich_eda(df, fill_invalid_adr=True)
    lead, adr = F.col("lead_time"), F.col("adr")
    nights = F.col("total_nights")
    prev_c, prev_nc = F.col("previous_cancellations"), F.col("previous_bookings_not_canceled")
    repeated = F.col("is_repeated_guest") == 1
    deposit = F.col("deposit_type")
    adr_q, value_q = thresholds["adr_q"], thresholds["value_q"]

    def ge(x, q):
        return C.flag(x >= F.lit(q)) if q is not None else F.lit(0)

    out = base.withColumns({
        "has_invalid_adr": C.flag(adr < 0),
        "is_zero_night_stay": C.flag(nights == 0),
        "is_weekend_stay": C.flag(F.col("stays_in_weekend_nights") > 0),
        "stay_length_category": C.stay_length_category(nights),
        "is_last_minute_booking": C.flag(lead <= 7),
        "is_long_lead_booking": C.flag(lead >= 90),
        "arrival_month_number": C.month_number("arrival_date_month"),
        "arrival_season": C.season("arrival_date_month"),
        "is_peak_season": C.flag(F.col("arrival_date_month").isin(S.PEAK_MONTHS)),
        "has_previous_cancellation": C.flag(prev_c > 0),
        "has_previous_successful_booking": C.flag(prev_nc > 0),
        "has_booking_changes": C.flag(F.col("booking_changes") > 0),
        "has_special_requests": C.flag(F.col("total_of_special_requests") > 0),
        "is_waitlisted": C.flag(F.col("days_in_waiting_list") > 0),
        "previous_total_bookings": prev_c + prev_nc,
        "previous_cancellation_rate": C.safe_ratio(prev_c, prev_c + prev_nc),
        # a missing deposit type counts as "not No Deposit", as in the notebook
        "repeat_guest_with_deposit": C.flag(repeated & (deposit.isNull() | (deposit != "No Deposit"))),
        "repeat_guest_non_refund": C.flag(repeated & (deposit == "Non Refund")),
        "is_zero_adr": C.flag(adr == 0),
        "is_high_adr": ge(adr, adr_q),
        "is_high_value_booking": ge(F.col("estimated_booking_value"), value_q),
        "room_type_changed": F.when(F.col("reserved_room_type") == F.col("assigned_room_type"), 0)
                              .otherwise(1),
    })
    return out


def engineered_columns() -> list[str]:
    return ["has_invalid_adr", "is_zero_night_stay", "is_weekend_stay", "stay_length_category",
            "is_last_minute_booking", "is_long_lead_booking", "arrival_month_number",
            "arrival_season", "is_peak_season", "has_previous_cancellation",
            "has_previous_successful_booking", "has_booking_changes", "has_special_requests",
            "is_waitlisted", "previous_total_bookings", "previous_cancellation_rate",
            "repeat_guest_with_deposit", "repeat_guest_non_refund", "is_zero_adr", "is_high_adr",
            "is_high_value_booking", "room_type_changed"]
