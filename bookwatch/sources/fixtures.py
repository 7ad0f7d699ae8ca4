"""Deterministic scores and labels derived from the bookings table.

The provided order status carries no cancellation signal, so evaluation and
model tests use a planted outcome: a known probability ``p`` from three
booking attributes and a hash-uniform draw per key. Both are pure functions
of the row, so they do not depend on partitioning and equal the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

HASH_SCALE = 268435456.0  # 16 ** 7


def hash_unit(key: str = S.BOOKING_ID, salt: str = "7") -> Column:
    """Uniform [0, 1) value from the first 7 hex digits of md5(key|salt)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{salt}")))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") / F.lit(HASH_SCALE)


def _ind(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def planted_probability() -> Column:
    lead = F.coalesce(F.col("lead_time"), F.lit(0))
    return (F.lit(0.08) + F.lit(0.35) * _ind(lead >= 365)
            + F.lit(0.40) * _ind(F.col("deposit_type") == "Non Refund")
            - F.lit(0.07) * _ind(F.col("total_of_special_requests") >= 2))


def planted_label() -> Column:
    return F.when(hash_unit(salt="7") < planted_probability(), 1).otherwise(0)


def reference_score() -> Column:
    """A deterministic cancellation score in [0, 1] (4 decimals): the planted
    probability plus a small hash jitter, so it has both ties and spread."""
    raw = planted_probability() + F.lit(0.1) * (hash_unit(salt="3") - F.lit(0.5))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def with_planted_label(df: DataFrame, name: str = "planted_label") -> DataFrame:
    return df.withColumn(name, planted_label())
