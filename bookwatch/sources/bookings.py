"""The ``bookings`` table: one row per reservation, derived from the provided
order tables (one order = one reservation), plus file readers and writers."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import exclusive_running_sums
from ..schema import RAW_BOOKING_SCHEMA
from ..session import compile_long_rows

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flag(cond) -> "F.Column":
    return F.when(cond, 1).otherwise(0)


def stay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order facts from the order lines: first ship date, night counts,
    changes, requests, parking, room types. Partial aggregation runs map-side,
    so an order with very many lines still ships one row per map task."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_linestatus", "l_returnflag",
        "l_discount", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lp = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return lp.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("ship"),
        F.sum(_flag(F.col("l_linestatus") == "F")).alias("wknd"),
        F.sum(_flag(F.col("l_linestatus") == "O")).alias("wk"),
        F.sum(_flag(F.col("l_returnflag") == "R")).alias("chg"),
        F.sum(_flag(F.col("l_returnflag") == "A")).alias("req"),
        F.max(_flag(F.col("l_discount") >= 0.1)).alias("park"),
        F.min("p_type").alias("res"),
        F.max("p_type").alias("asg"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(_flag(F.col("l_quantity") > 45)).alias("kids"),
    )


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservation table in the raw layout the notebooks start from.

    Mapping (deterministic, documented in FIXTURES.md): hotel from the region,
    cancellation from the order status, segment from the customer segment,
    deposit from the order priority, guest history from the customer's earlier
    orders (ordered by date, then key).
    """
    compile_long_rows(spark)
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    lines = stay_lines(spark, sf_dir)

    base = (orders
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))

    # the sums read their input twice: the lines, one row an order, come after them
    hist = exclusive_running_sums(
        base, keys=["o_custkey"], block=["o_orderdate"], within=["o_orderkey"],
        values={"prev_f": _flag(F.col("o_orderstatus") == "F"),
                "prev_nf": _flag(F.col("o_orderstatus") != "F")})
    hist = hist.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    days = F.datediff(F.to_date("ship"), F.to_date("o_orderdate"))
    prev_c = F.col("prev_f").cast("int")
    prev_nc = F.col("prev_nf").cast("int")
    is_canceled = _flag(F.col("o_orderstatus") == "F")
    return hist.select(
        F.col("o_orderkey").alias("booking_id"),
        F.when(F.col("n_regionkey") < 3, "City Hotel").otherwise("Resort Hotel").alias("hotel"),
        is_canceled.alias("is_canceled"),
        (F.abs(days) % 737).cast("int").alias("lead_time"),
        F.year("o_orderdate").alias("arrival_date_year"),
        F.date_format("o_orderdate", "MMMM").alias("arrival_date_month"),
        F.weekofyear("o_orderdate").alias("arrival_date_week_number"),
        F.dayofmonth("o_orderdate").alias("arrival_date_day_of_month"),
        F.coalesce("wknd", F.lit(0)).cast("int").alias("stays_in_weekend_nights"),
        F.coalesce("wk", F.lit(0)).cast("int").alias("stays_in_week_nights"),
        F.coalesce("n_lines", F.lit(0)).cast("int").alias("adults"),
        F.col("kids").cast("int").alias("children"),
        _flag(F.col("o_orderkey") % 97 == 0).alias("babies"),
        F.when(F.col("o_orderpriority").startswith("1"), "FB")
         .when(F.col("o_orderpriority").startswith("2"), "HB")
         .when(F.col("o_orderpriority").startswith("3"), "BB")
         .when(F.col("o_orderpriority").startswith("4"), "SC")
         .otherwise("Undefined").alias("meal"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("market_segment"),
        F.col("r_name").alias("distribution_channel"),
        _flag(prev_c + prev_nc > 0).alias("is_repeated_guest"),
        prev_c.alias("previous_cancellations"),
        prev_nc.alias("previous_bookings_not_canceled"),
        F.col("res").alias("reserved_room_type"),
        F.col("asg").alias("assigned_room_type"),
        F.coalesce("chg", F.lit(0)).cast("int").alias("booking_changes"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Non Refund")
         .when(F.col("o_orderpriority") == "5-LOW", "Refundable")
         .otherwise("No Deposit").alias("deposit_type"),
        (F.col("o_custkey") % 400).cast("int").alias("agent"),
        F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 100).cast("int").alias("company"),
        F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") % 7).otherwise(0)
         .cast("int").alias("days_in_waiting_list"),
        F.when(F.col("c_nationkey") % 4 == 0, "Transient")
         .when(F.col("c_nationkey") % 4 == 1, "Transient-Party")
         .when(F.col("c_nationkey") % 4 == 2, "Contract")
         .otherwise("Group").alias("customer_type"),
        # exact decimal arithmetic, so rounding ties agree in every engine
        F.round((F.col("o_totalprice").cast("decimal(18,2)") - F.lit(5000))
                * F.lit(Decimal("0.001")), 2).cast("double").alias("adr"),
        F.coalesce("park", F.lit(0)).cast("int").alias("required_car_parking_spaces"),
        F.coalesce("req", F.lit(0)).cast("int").alias("total_of_special_requests"),
        F.when(is_canceled == 1, "Canceled").otherwise("Check-Out").alias("reservation_status"),
        F.to_date(F.coalesce("ship", "o_orderdate")).alias("reservation_status_date"),
    )


#: Spellings of a missing value in text files.
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None")
WHOLE = ("byte", "short", "integer", "long")


def typed(col: str, to: T.DataType, malformed: str = "fail") -> Column:
    """A text value as the declared type. Missing spellings become null; a whole
    number may be written with a fraction of zeros (``2.0``), as tools do whose
    integer columns cannot hold missing values. Any other value that does not
    fit the type fails the job and is named, or becomes null with
    ``malformed="null"`` (count those with ``malformed_report``)."""
    text = F.trim(F.col(col))
    missing = F.col(col).isNull() | text.isin(*MISSING)
    if to.typeName() == "string":
        return F.when(~missing, F.col(col))
    value = text.try_cast(to)
    if to.typeName() in WHOLE:
        # digits with a fraction of zeros first: a cast that fails costs many times one that does not;
        # the others through a decimal, so that long keys keep every digit
        value = F.regexp_replace(text, r"^([+-]?[0-9]+)\.0*$", "$1").try_cast(to)
        exact = text.try_cast("decimal(38,10)")
        value = F.coalesce(value, F.when(exact == F.floor(exact), exact).cast("string").try_cast("decimal(38,0)")
                           .cast("string").try_cast(to))
    if to.typeName() in ("double", "float"):
        value = F.nanvl(value, F.lit(None).cast(to))
    if malformed == "null":
        return F.when(~missing, value)
    says = F.concat(F.lit(f"column {col} cannot hold the value '"), F.col(col), F.lit("'"))
    return F.when(~missing, F.coalesce(value, F.raise_error(says).cast(to)))


def normalised(df: DataFrame, schema: T.StructType = RAW_BOOKING_SCHEMA, malformed: str = "fail") -> DataFrame:
    """The declared type for every declared column, by name; NaN becomes null.
    Batch and stream readers share it. Other columns stay as they are."""
    compile_long_rows(df.sparkSession)
    declared = {f.name: f.dataType for f in schema.fields}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        to = declared.get(f.name, f.dataType)
        if f.dataType.typeName() == "string" and f.name in declared:
            c = typed(f.name, to, malformed)
        else:
            if f.dataType.typeName() in ("double", "float"):
                c = F.nanvl(c, F.lit(None).cast(f.dataType))
            if to != f.dataType:
                c = c.cast(to)
        out.append(c.alias(f.name))
    return df.select(*out)


def _text_columns(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv_text(spark: SparkSession, files: str | list[str], names: list[str]) -> DataFrame:
    """CSV columns as text; a file whose header differs is rejected."""
    return (spark.read.schema(_text_columns(names)).option("header", True).option("enforceSchema", False)
            .csv(files))


def _header_groups(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(columns, files) for each distinct header under ``path``. The driver gets
    one row for each file, as it does in listing them."""
    first = (spark.read.text(path).where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
             .groupBy("file").agg(F.min_by("value", "at").alias("header")))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(spark.read.option("header", True).csv(g["files"][0]).columns, g["files"]) for g in groups]


def read_bookings(spark: SparkSession, path: str, fmt: str = "csv", schema=RAW_BOOKING_SCHEMA,
                  mixed_headers: bool = False, malformed: str = "fail") -> DataFrame:
    """Read bookings files; columns are matched to the declared schema by header
    name (any order, any subset), never inferred, and brought to the declared
    types by ``normalised``.

    All CSV files of a folder must have one header: a file that differs is
    rejected, never read by position. With ``mixed_headers`` one extra pass over
    the text finds each file's header, and files are read by header and united
    by name (a column that a file lacks is null there). An empty folder of CSV
    files gives an empty table of the declared columns."""
    if fmt != "csv":
        return normalised(spark.read.format(fmt).load(path), schema, malformed)
    if mixed_headers:
        parts = [_csv_text(spark, files, names) for names, files in _header_groups(spark, path)]
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    else:
        names = spark.read.option("header", True).csv(path).columns
        raw = _csv_text(spark, path, names) if names else None
    if raw is None:
        return spark.createDataFrame([], schema)
    return normalised(raw, schema, malformed)


def malformed_report(spark: SparkSession, path: str, schema=RAW_BOOKING_SCHEMA) -> DataFrame:
    """``column_name, n_malformed``: values of a CSV file that do not fit the
    declared type and are no spelling of a missing value."""
    raw = _csv_text(spark, path, spark.read.option("header", True).csv(path).columns)
    declared = [f for f in schema.fields if f.name in raw.columns and f.dataType.typeName() != "string"]
    pairs = [F.struct(F.lit(f.name).alias("column_name"),
                      (typed(f.name, f.dataType, "null").isNull() & F.col(f.name).isNotNull()
                       & ~F.trim(f.name).isin(*MISSING)).cast("long").alias("bad")) for f in declared]
    return (raw.select(F.inline(F.array(*pairs))).groupBy("column_name")
            .agg(F.sum("bad").alias("n_malformed")))


def write_bookings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """Write without an index column (Spark has none). CSV gets a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
