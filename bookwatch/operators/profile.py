"""Profiling: summaries, value counts, top categories, histograms, density.

Values are counted by (column, value) in one scan of the data; quantiles,
moments, ranks and densities are taken from these counts, so no operator sorts
raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.prefix import running_sums
from ..functions.quantiles import ValueCounts

DESCRIBE_DIGITS = 6


def _rnd(c, digits=DESCRIBE_DIGITS):
    return F.round(c, digits)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-21: count, mean, std (sample), min, 25/50/75 % (linear
    interpolation), max per numeric column; one row per column, all from the
    counts of its values (:class:`ValueCounts`). Unlike ``DataFrame.summary`` the
    quantiles are exact; NaN is missing, and so is everything but the count of a
    column without values."""
    counts = ValueCounts(df, cols)
    moments, quartiles = counts.moments(), counts.quantiles([0.25, 0.5, 0.75])
    rows = []
    for c in cols:
        m = moments.get((0, c))
        rows.append((c, m["count"], m["mean"], None if m["var"] is None else m["var"] ** 0.5, m["min"],
                     *quartiles[0, c], m["max"]) if m else (c, 0, *[None] * 7))
    out = df.sparkSession.createDataFrame(rows, "column_name string, count long, mean double, std double, "
                                                "min double, p25 double, p50 double, p75 double, max double")
    return out.withColumns({c: _rnd(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


def describe_all(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """O-22: numeric summary plus count / unique / top / freq for the
    categorical columns (ties for the top value broken by value)."""
    num = describe(df, numeric).select(
        "column_name", "count", F.lit(None).cast("long").alias("unique"),
        F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
        "mean", "std", "min", "p25", "p50", "p75", "max")
    cat = category_counts(df, categorical).groupBy("column_name").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("count"), "value")).alias("top"), F.max("count").alias("freq"))
    nulls = [F.lit(None).cast("double").alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]]
    return num.unionByName(cat.select("column_name", "count", "unique", "top", "freq", *nulls))


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null (column_name, value, count) for several categorical columns in
    one aggregation: rows are unpivoted and counted with map-side combining,
    so the shuffle carries at most one row per value per map task."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])))
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """O-23: count per value, most frequent first (ties by value)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.col(col).asc_nulls_last()))


def _with_share(counts: DataFrame, count: str, digits: int = 2) -> DataFrame:
    """``counts`` with each row's percentage of all; the total is a subquery of
    one row, so no task sees all values."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("percentage", F.round(F.col(count) / total * 100, digits))


def value_share(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """O-24: share in percent of the non-null rows, per value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(counts, "count", digits).orderBy(F.desc("count"), col)


def target_distribution(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-25: count per target value and percent of the rows that have one."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("booking_count"))
    return _with_share(counts, "booking_count").orderBy(F.desc("booking_count"))


#: Parts of a column's values that are ranked apart before their best are merged.
RANK_PARTS = 64


def top_categories(df: DataFrame, cols: Sequence[str], k: int | None = 10) -> DataFrame:
    """O-26 / O-27: per column, values ranked by count with their share of the
    column's non-null rows; ``k`` keeps the top k (None keeps all).

    Ranking merges: the best k of each of 64 hash parts of a column, then the
    best k of those, so no task ranks all values of a column. All ranks come from
    running sums over range blocks of (column, count) instead."""
    counts = category_counts(df, cols)
    order = [F.desc("count"), F.col("value")]
    if k is None:
        ranked = running_sums(counts.withColumn("__one", F.lit(1)), [F.col("column_name"), *order],
                              ["__one", "count"], ["column_name"])
        return ranked.select("column_name", "value", "count", F.col("cum___one").cast("int").alias("rank"),
                             F.round(F.col("count") / F.col("total_count") * 100, 2).alias("percentage"))
    part = F.pmod(F.xxhash64("value"), F.lit(RANK_PARTS))
    best = (counts.withColumn("__part", part)
            .withColumn("rank", F.row_number().over(Window.partitionBy("column_name", "__part").orderBy(*order)))
            .where(F.col("rank") <= k).drop("__part")
            .withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(*order)))
            .where(F.col("rank") <= k))
    # one row for each of the listed columns
    totals = F.broadcast(counts.groupBy("column_name").agg(F.sum("count").alias("__total")))
    return best.join(totals, "column_name").select(
        "column_name", "value", "count", "rank",
        F.round(F.col("count") / F.col("__total") * 100, 2).alias("percentage"))


def feature_balance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-27: share of every value of every listed column."""
    return top_categories(df, cols, k=None)


def _bounds(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """O-28: equal-width histogram per column between its min and max; the
    last bin is closed, empty bins count 0, and a constant column is widened by
    a half to each side. A column without values has no bins. Two passes: min/max
    (one aggregate), then one grouped count over the unpivoted values."""
    bounds = _bounds(df, cols)
    parts, empty = [], []
    for c in cols:
        lo, hi = bounds[c]
        if lo is None:
            continue
        lo, width = (lo, (hi - lo) / bins) if hi > lo else (lo - 0.5, 1.0 / bins)
        x = F.col(c).cast("double")
        # least() skips nulls in Spark, so guard the missing values explicitly
        b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)),
                                          F.lit(bins - 1))).cast("int")
        head = F.lit(c).alias("column_name")
        tail = [F.lit(lo).alias("lo"), F.lit(width).alias("width")]
        parts.append(F.struct(head, b.alias("bin"), *tail, F.lit(1).cast("long").alias("n")))
        empty.append(F.struct(head, F.col("id").cast("int").alias("bin"), *tail, F.lit(0).cast("long").alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bin int, bin_start double, bin_end double, count long")
    long = df.select(F.inline(F.array(*parts))).where(F.col("bin").isNotNull())
    zero = df.sparkSession.range(bins).select(F.inline(F.array(*empty)))
    return (long.union(zero).groupBy("column_name", "bin", "lo", "width").agg(F.sum("n").alias("count"))
            .select("column_name", "bin",
                    F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("bin_start"),
                    F.round(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 6).alias("bin_end"),
                    "count"))


#: Bandwidths beyond which a Gaussian kernel adds nothing: exp(-72) is below 1e-31.
REACH = 12.0


def binned_kde(df: DataFrame, cols: Sequence[str], grid_points: int = 100) -> DataFrame:
    """O-29: Gaussian kernel density (Scott's bandwidth, std * n^(-1/5)) of each
    column on an even grid from its min to its max.

    Rows are first reduced to counts of distinct values, all columns at once. A
    value is then sent to the grid points within ``REACH`` bandwidths only, a
    range found by arithmetic, and its contributions are summed by (column, grid
    point) with map-side combining: never rows x grid. A column that is constant
    or has fewer than two values has no density."""
    counts = ValueCounts(df, cols)
    params = []
    for (_, c), m in counts.moments().items():
        if m["var"]:
            width = m["var"] ** 0.5 * m["count"] ** -0.2
            params.append((counts.names.index(c), c, m["min"], (m["max"] - m["min"]) / (grid_points - 1), width,
                           1.0 / (m["count"] * width * (2 * pi) ** 0.5)))
    schema = "__col int, column_name string, __lo double, __step double, __bw double, __norm double"
    # one row a column
    of_column = F.broadcast(df.sparkSession.createDataFrame(params, schema))
    lo, step, bw, x = (F.col(c) for c in ("__lo", "__step", "__bw", "__x"))
    first = F.greatest(F.lit(0), F.ceil((x - REACH * bw - lo) / step).cast("int"))
    last = F.least(F.lit(grid_points - 1), F.floor((x + REACH * bw - lo) / step).cast("int"))
    near = counts.blocks.placed.join(of_column, "__col").where(first <= last).withColumn(
        "grid_index", F.explode(F.sequence(first, last)))
    z = (lo + F.col("grid_index") * step - x) / bw
    sums = near.groupBy("__col", "grid_index").agg(F.sum(F.col("__n") * F.exp(F.lit(-0.5) * z * z)).alias("__s"))
    # a grid point that no kernel reaches has the density 0
    grid = of_column.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    return grid.join(sums, ["__col", "grid_index"], "left").select(
        "column_name", "grid_index", F.round(lo + F.col("grid_index") * step, 6).alias("x"),
        F.round(F.coalesce("__s", F.lit(0.0)) * F.col("__norm"), 9).alias("density"))


def cancel_totals(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """O-30: completed, cancelled and the cancellation rate (% of all rows)."""
    y = F.col(target)
    return df.agg(F.count_if(y == 0).alias("completed_bookings"),
                  F.count_if(y == 1).alias("cancelled_bookings"),
                  F.round(F.count_if(y == 1) / F.count(F.lit(1)) * 100, 2).alias("cancel_rate"))
