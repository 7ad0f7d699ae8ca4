"""Cancellation outcome by segment, bucket, count-valued key and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.quantiles import ValueCounts


def rate_by(df: DataFrame, key: str, target: str = S.TARGET) -> DataFrame:
    """O-31: cancellation rate in percent by one key, highest first; a null
    key is not a group (as in pandas)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.round(F.avg(target) * 100, 2).alias("cancellation_rate"))
            .orderBy(F.desc("cancellation_rate"), key))


def _summary_cols(target: str):
    return [F.count(F.col(target)).alias("total_bookings"),
            F.sum(F.col(target)).cast("long").alias("cancellations")]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("cancellation_rate",
                         F.round(F.col("cancellations") / F.col("total_bookings") * 100, 2))


def segment_summary(df: DataFrame, key: str, target: str = S.TARGET) -> DataFrame:
    """O-32: bookings, cancellations and rate by key, highest rate first."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*_summary_cols(target))
    return _with_rate(out).orderBy(F.desc("cancellation_rate"), key)


def segment_summaries(df: DataFrame, keys: Sequence[str], target: str = S.TARGET) -> DataFrame:
    """O-32 for several keys in one pass (the grouping-sets form): rows are
    tagged with (dimension, segment) and aggregated once, instead of one scan
    per key."""
    long = df.select(F.col(target), F.inline(F.array(*[
        F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("segment")) for k in keys])))
    out = long.where(F.col("segment").isNotNull()).groupBy("dimension", "segment").agg(*_summary_cols(target))
    return _with_rate(out).orderBy("dimension", F.desc("cancellation_rate"), "segment")


def _bucket_summary(df: DataFrame, bucket_col: str, bucket_expr, labels: list[str],
                    target: str) -> DataFrame:
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)],
                                f"bucket_order int, {bucket_col} string")
    agg = (df.select(bucket_expr.alias(bucket_col), F.col(target))
           .where(F.col(bucket_col).isNotNull()).groupBy(bucket_col).agg(*_summary_cols(target)))
    # the dimension has a fixed number of rows (the bucket labels)
    out = F.broadcast(dim).join(agg, bucket_col, "left").select(
        "bucket_order", bucket_col,
        F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings"),
        F.coalesce("cancellations", F.lit(0)).cast("long").alias("cancellations"))
    rate = F.when(F.col("total_bookings") > 0,
                  F.round(F.col("cancellations") / F.col("total_bookings") * 100, 2))
    return out.withColumn("cancellation_rate", rate).orderBy("bucket_order")


def lead_time_summary(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-33: by lead-time bucket in bucket order; empty buckets are kept
    with zero counts and a null rate."""
    return _bucket_summary(df, "lead_time_bucket", C.lead_time_bucket("lead_time"),
                           S.LEAD_TIME_LABELS, target)


def adr_summary(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-34: by ADR bucket in bucket order (negative rates have no bucket)."""
    return _bucket_summary(df, "adr_bucket", C.adr_bucket("adr"), S.ADR_LABELS, target)


def rate_by_count(df: DataFrame, key: str, max_value: int | None = None,
                  target: str = S.TARGET) -> DataFrame:
    """O-35: mean outcome and rate (unrounded) per value of a count column in
    key order; ``max_value`` keeps keys <= it (the plotted range)."""
    src = df.where(F.col(key).isNotNull())
    if max_value is not None:
        src = src.where(F.col(key) <= max_value)
    return (src.groupBy(key).agg(F.avg(target).alias(target))
            .withColumn("cancellation_rate", F.col(target) * 100).orderBy(key))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Booking count per value in key order (companion of O-35)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("booking_count")).orderBy(key))


def means_by_target(df: DataFrame, cols: Sequence[str], target: str = S.TARGET,
                    digits: int = 2) -> DataFrame:
    """O-36: mean of every numeric column for each outcome, one row per
    column (the transposed group-by), from a single aggregate."""
    y = F.col(target)
    structs = [F.struct(
        F.lit(c).alias("feature"),
        F.round(F.avg(F.when(y == 0, F.col(c))), digits).alias("mean_not_cancelled"),
        F.round(F.avg(F.when(y == 1, F.col(c))), digits).alias("mean_cancelled")).alias(f"s{i}")
        for i, c in enumerate(cols)]
    return df.agg(*structs).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cols))])))


def _pair_corr(a: str, b: str):
    """Pearson correlation over rows where both are present; null when either
    side is constant (no division by zero under ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    xa = F.when(both, F.col(a).cast("double"))
    xb = F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(xa, xb), F.stddev_samp(xa) * F.stddev_samp(xb))


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """O-37: all pairs (including the diagonal) in long form. One aggregate
    computes each unordered pair once; the rest are its mirror images."""
    cols = list(cols)
    at = {(a, b): f"p{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j}
    one = df.agg(*[F.round(_pair_corr(a, b), digits).alias(n) for (a, b), n in at.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                 F.col(at.get((a, b)) or at[b, a]).alias("correlation")) for a in cols for b in cols])))


def target_correlation(df: DataFrame, cols: Sequence[str], target: str = S.TARGET,
                       digits: int = 6) -> DataFrame:
    """O-38: correlation of each column with the target, highest first."""
    structs = [F.struct(F.lit(c).alias("feature"),
                        F.round(_pair_corr(c, target), digits).alias("correlation")).alias(f"p{i}")
               for i, c in enumerate(cols)]
    return (df.agg(*structs).select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(cols))])))
            .orderBy(F.desc_nulls_last("correlation"), "feature"))


def monthly_rate(df: DataFrame, target: str = S.TARGET, month: str = "arrival_date_month") -> DataFrame:
    """O-39: mean outcome and rate per arrival month in calendar order."""
    return (df.where(F.col(month).isNotNull()).groupBy(month)
            .agg(F.avg(target).alias(target))
            .withColumn("cancellation_rate", F.col(target) * 100)
            .withColumn("month_number", C.month_number(month))
            .orderBy("month_number"))


def monthly_volume(df: DataFrame, month: str = "arrival_date_month") -> DataFrame:
    """O-40: bookings per arrival month in calendar order."""
    return (df.where(F.col(month).isNotNull()).groupBy(month)
            .agg(F.count(F.lit(1)).alias("booking_count"))
            .withColumn("month_number", C.month_number(month))
            .orderBy("month_number"))


def monthly_summary(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-41: left equi-join of the monthly rate and volume tables on the
    month; how it is joined is left to the planner, as a free text column may
    hold any number of months."""
    rate = monthly_rate(df, target).drop("month_number")
    return rate.join(monthly_volume(df), "arrival_date_month", "left").orderBy("month_number")


def hotel_monthly_rate(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-42: rate by (month, hotel)."""
    return (df.where(F.col("arrival_date_month").isNotNull() & F.col("hotel").isNotNull())
            .groupBy("arrival_date_month", "hotel").agg(F.avg(target).alias(target))
            .withColumn("cancellation_rate", F.col(target) * 100)
            .withColumn("month_number", C.month_number("arrival_date_month"))
            .orderBy("month_number", "hotel"))


def hotel_monthly_volume(df: DataFrame) -> DataFrame:
    """O-43: bookings by (month, hotel)."""
    return (df.where(F.col("arrival_date_month").isNotNull() & F.col("hotel").isNotNull())
            .groupBy("arrival_date_month", "hotel").agg(F.count(F.lit(1)).alias("booking_count"))
            .withColumn("month_number", C.month_number("arrival_date_month"))
            .orderBy("month_number", "hotel"))


def value_by_outcome(df: DataFrame, target: str = S.TARGET, value: str = "estimated_booking_value",
                     digits: int = 2) -> DataFrame:
    """O-44: count, mean, median, sum of the booking value per outcome, with
    the outcome label, from the counts of the values by outcome. Rows without an
    outcome are left out; an outcome without a value has the count 0."""
    counts = ValueCounts(df, {"value": F.col(value), "row": F.lit(1.0)}, by=F.col(target))
    moments, medians = counts.moments(), counts.quantiles([0.5])
    rows = []
    for y in sorted(y for y, c in moments if c == "row"):
        m = moments.get((y, "value"))
        rows.append((y, m["count"], m["mean"], medians[y, "value"][0], m["sum"]) if m else (y, 0, None, None, None))
    kind = df.schema[target].dataType.simpleString()
    out = df.sparkSession.createDataFrame(rows, f"`{target}` {kind}, count long, mean double, median double, sum double")
    out = out.withColumns({c: F.round(c, digits) for c in ("mean", "median", "sum")})
    label = F.when(F.col(target) == 0, S.OUTCOME_LABELS[0]).when(F.col(target) == 1, S.OUTCOME_LABELS[1])
    return out.withColumn("status", label).orderBy(target)
