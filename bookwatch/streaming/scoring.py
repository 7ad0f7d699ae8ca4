"""Score booking files as they arrive (the batch-upload review as a stream).

Scoring is row-wise once the model and the feature thresholds are fitted, so
the same expressions run unchanged on a streaming DataFrame: a file source
with a declared schema, the feature projection with fixed thresholds, the
fitted pipeline, the risk columns, and a parquet sink with a checkpoint for
exactly-once output across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import decision as DC
from ..operators import features as FE
from ..operators import models as MD
from ..sources.bookings import _text_columns, normalised

OUTPUT_COLUMNS = [S.BOOKING_ID, "hotel", "market_segment", "customer_type", "estimated_booking_value",
                  S.PROBABILITY, S.PREDICTION, S.RISK_CATEGORY, S.REVENUE_AT_RISK]


def read_booking_stream(spark: SparkSession, path: str, fmt: str = "csv",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming file source needs its schema up front: arriving CSV files
    have the columns of ``RAW_BOOKING_SCHEMA`` in its order (as written by
    ``write_bookings``), and a file with another header fails the query rather
    than being read by position. Values go through the batch reader's
    ``normalised``, so a stream holds what the batch reader gives. Parquet files
    are matched by name."""
    csv = fmt == "csv"
    reader = spark.readStream.schema(_text_columns(S.RAW_BOOKING_SCHEMA.names) if csv else S.RAW_BOOKING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if csv:
        reader = reader.option("header", True).option("enforceSchema", False)
    return normalised(reader.format(fmt).load(path))


def score_stream(stream: DataFrame, bundle: MD.Bundle, thresholds: dict) -> DataFrame:
    """Streaming DataFrame of scored bookings with tier and revenue at risk."""
    feats = FE.derive_features(stream, thresholds)
    scored = DC.add_risk_columns(MD.score_bundle(feats, bundle), bundle.threshold)
    return scored.select(*OUTPUT_COLUMNS, DC.risk_drivers(scored).alias("risk_drivers"))


def start_scoring(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, bundle: MD.Bundle,
                  thresholds: dict, available_now: bool = False, fmt: str = "csv") -> StreamingQuery:
    scored = score_stream(read_booking_stream(spark, in_path, fmt), bundle, thresholds)
    w = scored.writeStream.format("parquet").option("path", out_path) \
                          .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
