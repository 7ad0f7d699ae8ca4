"""Risk tiers, revenue at risk, segment risk profiles and per-booking advice.

Row-level rules (tier, drivers, actions, summary text) are single built-in
expressions, so scoring a batch is one narrow stage; segment tables are one
aggregate each (several segment keys share one pass)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..sources.keyed import lookup


def risk_tier(p: str = S.PROBABILITY, threshold: float = S.DEFAULT_THRESHOLD) -> Column:
    """O-58: High (>= 0.70) / Medium (>= threshold) / Low."""
    return C.risk_tier(p, threshold)


def row_revenue_at_risk(df: DataFrame, p: str = S.PROBABILITY,
                        value: str = "estimated_booking_value") -> DataFrame:
    """O-59: p x booking value per row; null when the value column is absent."""
    expr = F.col(p) * F.col(value) if value in df.columns else F.lit(None).cast("double")
    return df.withColumn(S.REVENUE_AT_RISK, expr)


def add_risk_columns(df: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                     p: str = S.PROBABILITY) -> DataFrame:
    """Batch scoring tail: class, tier and row revenue at risk (O-57..O-59)."""
    out = df.withColumns({S.PREDICTION: F.when(C.reaches(p, threshold), 1).otherwise(0),
                          S.RISK_CATEGORY: risk_tier(p, threshold)})
    return row_revenue_at_risk(out, p)


def segment_revenue_exposure(df: DataFrame, key: str = "market_segment", p: str = S.PROBABILITY,
                             value: str = "estimated_booking_value") -> DataFrame:
    """O-60: avg(p) x sum(value) per segment, rounded after multiplying."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.col(key)).alias("booking_count"), F.avg(p).alias("__p"),
        F.sum(value).alias("__v"), F.sum(S.PREDICTION).cast("long").alias("predicted_at_risk_bookings"))
    return out.select(
        key, "booking_count", F.round(F.col("__p") * 100, 2).alias("avg_predicted_cancellation_probability"),
        F.round("__v", 2).alias("total_estimated_booking_value"), "predicted_at_risk_bookings",
        F.round(F.col("__p") * F.col("__v"), 2).alias("estimated_revenue_at_risk"),
    ).orderBy(F.desc("estimated_revenue_at_risk"), key)


def segment_profile(scored: DataFrame, cols: Sequence[str] = ("hotel", "market_segment", "customer_type",
                                                                 "estimated_booking_value"),
                    y: str = S.TARGET) -> DataFrame:
    """O-73: segment columns with actual and predicted outcome, aligned by the
    booking key carried through scoring (no positional index)."""
    return scored.select(S.BOOKING_ID, *cols, F.col(y).alias("actual_is_cancelled"),
                         S.PROBABILITY, S.PREDICTION)


def _risk_aggs():
    return [F.count(F.lit(1)).alias("booking_count"),
            F.round(F.avg("actual_is_cancelled") * 100, 2).alias("actual_cancellation_rate"),
            F.round(F.avg(S.PROBABILITY) * 100, 2).alias("avg_predicted_cancellation_probability"),
            F.round(F.avg(S.PREDICTION) * 100, 2).alias("predicted_cancellation_rate"),
            F.round(F.sum("estimated_booking_value"), 2).alias("total_estimated_booking_value")]


def segment_risk(profile: DataFrame, key: str) -> DataFrame:
    """O-74: count, actual %, mean p %, predicted %, total value per segment;
    highest mean probability first."""
    return (profile.where(F.col(key).isNotNull()).groupBy(key).agg(*_risk_aggs())
            .orderBy(F.desc("avg_predicted_cancellation_probability"), key))


def segment_risk_all(profile: DataFrame, keys: Sequence[str] = ("market_segment", "customer_type", "hotel")
                     ) -> DataFrame:
    """O-74 for several keys in one aggregation over (dimension, segment)."""
    long = profile.select("actual_is_cancelled", S.PROBABILITY, S.PREDICTION, "estimated_booking_value",
                          F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"),
                                                      F.col(k).cast("string").alias("segment")) for k in keys])))
    return (long.where(F.col("segment").isNotNull()).groupBy("dimension", "segment").agg(*_risk_aggs())
            .orderBy("dimension", F.desc("avg_predicted_cancellation_probability"), "segment"))


def dashboard_by_segment(scored: DataFrame, key: str = "market_segment") -> DataFrame:
    """O-75: bookings, mean risk %, predicted cancellations and the sum of row
    revenue at risk per segment, largest exposure first."""
    return (scored.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.col(key)).alias("booking_count"),
        F.round(F.avg(S.PROBABILITY) * 100, 2).alias("avg_predicted_risk"),
        F.sum(S.PREDICTION).cast("long").alias("predicted_at_risk_bookings"),
        F.round(F.sum(S.REVENUE_AT_RISK), 2).alias(S.REVENUE_AT_RISK))
        .orderBy(F.desc(S.REVENUE_AT_RISK), key))


def dashboard_totals(scored: DataFrame) -> DataFrame:
    """O-76: bookings scored, mean predicted risk, total revenue at risk,
    with the display strings."""
    out = scored.agg(F.count(F.lit(1)).alias("total_bookings"),
                     F.avg(S.PROBABILITY).alias("__p"), F.sum(S.REVENUE_AT_RISK).alias("__r"))
    return out.select("total_bookings", F.round("__p", 6).alias("avg_predicted_risk"),
                      F.round("__r", 2).alias("total_revenue_at_risk"),
                      C.format_percent(F.col("__p"), 1).alias("avg_predicted_risk_text"),
                      C.format_currency(F.col("__r")).alias("total_revenue_at_risk_text"))


def tier_counts(scored: DataFrame, tier: str = S.RISK_CATEGORY) -> DataFrame:
    """O-77: bookings per risk tier in one pass."""
    t = F.col(tier)
    return scored.agg(*[F.count_if(t == lab).alias(lab.lower().replace(" ", "_") + "_bookings")
                        for lab in S.RISK_LABELS])


def top_segment(summary: DataFrame, key: str = "market_segment") -> DataFrame:
    """O-78: the segment with the largest revenue at risk and the sentence
    describing it."""
    top = summary.orderBy(F.desc(S.REVENUE_AT_RISK), key).limit(1)
    text = F.format_string(S.TOP_SEGMENT_TEMPLATE.replace("{segment}", "%s").replace("{count}", "%s")
                           .replace("{value}", "%s"),
                           F.col(key), F.format_number(F.col("booking_count"), 0),
                           C.format_currency(F.col(S.REVENUE_AT_RISK)))
    return top.select(key, "booking_count", S.REVENUE_AT_RISK, text.alias("summary"))


PREVIEW_COLUMNS = ["hotel", "market_segment", "customer_type", "estimated_booking_value",
                   S.PROBABILITY, S.RISK_CATEGORY, S.REVENUE_AT_RISK]


def scored_preview(scored: DataFrame, cols: Sequence[str] = tuple(PREVIEW_COLUMNS),
                   limit: int | None = None) -> DataFrame:
    """O-79: the preview columns that exist, highest probability first (the key,
    where there is one, breaks ties); ``limit`` keeps the first rows for display."""
    key = [S.BOOKING_ID] if S.BOOKING_ID in scored.columns else []
    out = scored.select(*key, *[c for c in cols if c in scored.columns]).orderBy(F.desc(S.PROBABILITY), *key)
    return out.limit(limit) if limit else out


def _rule(col_name: str, op: str, value) -> Column:
    c = F.col(col_name)
    return {">=": c >= F.lit(value), ">": c > F.lit(value), "==": c == F.lit(value)}[op]


def risk_drivers(df: DataFrame) -> Column:
    """O-80: messages of the rules that hold, in rule order, at most five; a
    default message when none holds. A rule whose column is absent is
    skipped (decided from the schema, once)."""
    msgs = [F.when(_rule(c, op, v), F.lit(msg)) for c, op, v, msg in S.RISK_DRIVER_RULES if c in df.columns]
    if not msgs:
        return F.array(F.lit(S.NO_DRIVER_TEXT))
    hits = F.slice(F.array_compact(F.array(*msgs)), 1, S.MAX_DRIVERS)
    return F.when(F.size(hits) == 0, F.array(F.lit(S.NO_DRIVER_TEXT))).otherwise(hits)


def recommended_actions(tier: str = S.RISK_CATEGORY) -> Column:
    """O-81: the action list of the tier (a CASE over three fixed lists)."""
    t = F.col(tier)
    acts = S.RECOMMENDED_ACTIONS
    arr = lambda k: F.array(*[F.lit(a) for a in acts[k]])
    return F.when(t == "High Risk", arr("High Risk")).when(t == "Medium Risk", arr("Medium Risk")) \
            .otherwise(arr("Low Risk"))


def booking_summary(df: DataFrame, p: str = S.PROBABILITY, tier: str = S.RISK_CATEGORY) -> Column:
    """O-82: the assistant sentence, with defaults for absent or null
    hotel / segment / customer type."""
    def field(name):
        default = F.lit(S.SUMMARY_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in df.columns else default
    fmt = (S.SUMMARY_TEMPLATE.replace("{risk}", "%s").replace("{pct}", "%s").replace("{hotel}", "%s")
           .replace("{segment}", "%s").replace("{customer}", "%s"))
    return F.format_string(fmt, F.col(tier), C.format_percent(F.col(p), 1), field("hotel"),
                           field("market_segment"), field("customer_type"))


def format_currency(x) -> Column:
    """O-83: ``€1,234.56``."""
    return C.format_currency(x)


DETAIL_COLUMNS = ["hotel", "market_segment", "customer_type", "lead_time", "adr", "total_nights",
                  "total_of_special_requests", "deposit_type", "estimated_booking_value"]


def review(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """O-84 for any number of rows: detail columns, probability, decision,
    tier, drivers, actions and summary as one projection."""
    with_tier = scored.withColumn(S.RISK_CATEGORY, risk_tier(S.PROBABILITY, threshold))
    details = [c for c in [S.BOOKING_ID, *DETAIL_COLUMNS] if c in scored.columns]
    return with_tier.select(
        *details, S.PROBABILITY,
        F.when(C.reaches(S.PROBABILITY, threshold), "Likely Cancelled")
         .otherwise("Likely Not Cancelled").alias("model_decision"),
        S.RISK_CATEGORY, risk_drivers(with_tier).alias("risk_drivers"),
        recommended_actions().alias("recommended_actions"),
        booking_summary(with_tier).alias("assistant_summary"))


def review_booking(scored: DataFrame, booking_id, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """O-84: look one booking up in a scored table written by
    ``sources.keyed.write_keyed`` and review it. The key selects the folder and is
    pushed down to the scan; no other row is read or scored."""
    return review(lookup(scored, S.BOOKING_ID, booking_id), threshold)


def review_sample(scored: DataFrame, n: int = 500, seed: int = 42, position: int = 0,
                  threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """O-84 as the app does it: the booking at ``position`` of a seeded
    sample of ``n`` rows (O-05 order)."""
    h = F.md5(F.concat(F.col(S.BOOKING_ID).cast("string"), F.lit(f"|{seed}")))
    pick = scored.withColumn("__h", h).orderBy("__h", S.BOOKING_ID).limit(min(n, position + 1)) \
                 .orderBy(F.desc("__h"), F.desc(S.BOOKING_ID)).limit(1).drop("__h")
    return review(pick, threshold)

