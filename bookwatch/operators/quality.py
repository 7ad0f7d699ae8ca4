"""Schema and data-quality checks (shape, missing values, duplicates, derived
column validation). Every per-column statistic is computed in one aggregate
and then unpivoted, so a 30-column report is one scan, not 30."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def table_shape(df: DataFrame) -> DataFrame:
    """O-03: one row with the row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def head(df: DataFrame, n: int = 10, order: Sequence[str] = (S.BOOKING_ID,)) -> DataFrame:
    """O-04: first ``n`` rows by an explicit order (Spark has no row order)."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: str = S.BOOKING_ID, seed: int = 42) -> DataFrame:
    """O-05: seeded sample of ``n`` rows that does not depend on partitioning:
    the ``n`` rows with the smallest md5(key|seed). Planned as a top-n
    (``TakeOrderedAndProject``), so no full sort or shuffle of the input."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """O-07: raise listing every missing column; otherwise return ``df``."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def check_groups(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """O-08: grouped feature names absent from ``df`` and columns of ``df``
    not used by any group."""
    used = [c for cols in groups.values() for c in cols]
    return {"missing": [c for c in used if c not in df.columns],
            "unused": [c for c in df.columns if c not in used]}


def group_report(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """O-08 as rows: each column's group, ``missing`` for a grouped name that
    ``df`` lacks, ``unused`` for a column of no group."""
    found = check_groups(df, groups)
    rows = [(c, g) for g, cols in groups.items() for c in cols if c not in found["missing"]]
    rows += [(c, kind) for kind in ("missing", "unused") for c in found[kind]]
    return df.sparkSession.createDataFrame(rows, "column_name string, feature_group string")


def drop_leakage(df: DataFrame, cols: Sequence[str] = tuple(S.LEAKAGE_COLUMNS),
                 target: str = S.TARGET) -> DataFrame:
    """O-09: drop leakage columns and check none survives; the target stays."""
    out = df.drop(*cols)
    left = [c for c in cols if c in out.columns]
    assert not left, f"leakage columns still present: {left}"
    return out


def candidate_features(df: DataFrame, exclude: Sequence[str] = (S.TARGET, *S.LEAKAGE_COLUMNS),
                       key: str = S.BOOKING_ID) -> list[str]:
    """O-09: every column except the target, the key and leakage columns."""
    return [c for c in df.columns if c not in exclude and c != key]


_NUMERIC = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType,
            T.DecimalType)


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """O-10: column names by type family: ``numeric`` or ``string``."""
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if kind == "string":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    raise ValueError(kind)


def select_features(df: DataFrame, cols: Sequence[str], key: str | None = S.BOOKING_ID) -> DataFrame:
    """O-11: projection to a feature list (the key is carried when present)."""
    keep = ([key] if key and key in df.columns and key not in cols else []) + list(cols)
    return df.select(*keep)


def filter_invalid_adr(df: DataFrame) -> DataFrame:
    """O-12: bookings whose rate is negative (the null ADR bucket)."""
    return df.where(F.col("adr") < 0)


def filter_null_bucket(df: DataFrame, bucket: str = "adr_bucket") -> DataFrame:
    """O-12: rows that fell into no bucket: their value is missing or outside
    all edges."""
    return df.where(F.col(bucket).isNull())


def filter_revenue_rows(df: DataFrame) -> DataFrame:
    """O-12: bookings with a positive rate and at least one night."""
    return df.where((F.col("adr") > 0) & (F.col("total_nights") > 0))


def _unpivot_one_row(agg_row_df: DataFrame, structs: list) -> DataFrame:
    return agg_row_df.select(F.inline(F.array(*structs)))


def table_info(df: DataFrame) -> DataFrame:
    """O-13: column name, position, type and non-null count, one scan."""
    cols = df.columns
    agg = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    dtypes = dict(df.dtypes)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                        F.lit(dtypes[c]).alias("dtype"), F.col(f"c{i}").alias("non_null_count"))
               for i, c in enumerate(cols)]
    return _unpivot_one_row(agg, structs)


def missing_report(df: DataFrame) -> DataFrame:
    """O-14: missing count and percent of all rows per column, only columns
    with missing values, most missing first."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"),
                        F.round(F.col(f"m{i}") / F.col("__n") * 100, 2).alias("missing_percentage"))
               for i, c in enumerate(cols)]
    out = _unpivot_one_row(agg, structs)
    return out.where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column_name")


def quality_summary(df: DataFrame, top: int | None = 15) -> DataFrame:
    """O-15: missing, missing %, distinct non-null values per column, most
    missing first (ties by name), first ``top`` rows.

    Rows are unpivoted to (column, value as text) and counted by both with
    map-side combining: one shuffle of each task's distinct values, whatever the
    number of columns; missing, total and distinct counts are then sums over
    that narrow table. NaN counts as one value, and so do 0.0 and -0.0."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.col(c)
        return (x + F.lit(0.0).cast(types[c]) if types[c] in ("double", "float") else x).cast("string")

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), text(c).alias("value")) for i, c in enumerate(df.columns)])))
    counts = long.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    missing, total = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)), F.sum("n")
    out = counts.groupBy("at").agg(
        missing.alias("missing_values"), F.round(missing / total * 100, 2).alias("missing_percentage"),
        F.count("value").alias("unique_values"))
    names = F.array(*map(F.lit, df.columns))
    out = out.select(F.get(names, F.col("at")).alias("column_name"), "missing_values", "missing_percentage",
                     "unique_values").orderBy(F.desc("missing_percentage"), "column_name")
    return out.limit(top) if top else out


def duplicate_count(df: DataFrame, exclude: Sequence[str] = (S.BOOKING_ID,)) -> DataFrame:
    """O-16: rows that repeat an earlier row over all columns except
    ``exclude`` (nulls compare equal). Counting per group is map-side
    combined, so a hot group is one row per map task in the shuffle."""
    cols = [c for c in df.columns if c not in exclude]
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def drop_duplicates(df: DataFrame, key: str | None = S.BOOKING_ID) -> DataFrame:
    """O-17: keep one row per distinct row. When a key column is given it is
    left out of the comparison and the smallest key of each group is kept,
    so later steps can still join back on it."""
    if key is None or key not in df.columns:
        return df.dropDuplicates()
    cols = [c for c in df.columns if c != key]
    return df.groupBy(*cols).agg(F.min(key).alias(key)).select(*df.columns)


def check_total_nights(df: DataFrame) -> DataFrame:
    """O-18: exact check total = weekend + week nights; null is incorrect."""
    ok = F.col("total_nights") == F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    return df.agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("correct_rows"),
                  F.count_if(~F.coalesce(ok, F.lit(False))).alias("incorrect_rows"))


def check_close(df: DataFrame, a: str = "estimated_booking_value", b=None,
                rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """O-19: |a - b| <= atol + rtol*|b| (numpy ``isclose``); null is incorrect.
    ``b`` defaults to adr x total_nights."""
    bcol = F.col("adr") * F.col("total_nights") if b is None else F.col(b)
    ok = F.coalesce(F.abs(F.col(a) - bcol) <= F.lit(atol) + F.lit(rtol) * F.abs(bcol), F.lit(False))
    return df.agg(F.count_if(ok).alias("correct_rows"), F.count_if(~ok).alias("incorrect_rows"))


def assert_finite(df: DataFrame, vec: str = "features") -> DataFrame:
    """O-20: rows whose assembled feature vector holds NaN or infinity."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(vec))
    bad = F.exists(arr, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.agg(F.count_if(bad).alias("non_finite_rows"), F.count(F.lit(1)).alias("rows"))
