"""End-to-end flows and streaming scoring on the smallest tables."""
import os
import tempfile

from pyspark.sql import functions as F

from bookwatch import schema as S
from bookwatch.operators import features as FE
from bookwatch.plans import flows
from bookwatch.sources.bookings import write_bookings
from bookwatch.streaming import scoring as ST

from .conftest import SF_SMALL


def test_flows_and_stream(spark):
    base = tempfile.mkdtemp(prefix="bw-flow-")
    clean, rep = flows.audit_flow(spark, SF_SMALL, out=os.path.join(base, "clean"))
    n = clean.count()
    assert rep["shape"].first()["n_rows"] == n + rep["duplicates"].first()["duplicate_rows"]
    eda, rep2 = flows.eda_flow(clean, out=os.path.join(base, "eda"))
    assert sum(r["total_bookings"] for r in rep2["lead_time"].collect()) <= n
    res = flows.training_flow(clean, kinds=("logistic", "forest"),
                              bundle_path=os.path.join(base, "bundle"),
                              forest={"num_trees": 10, "max_depth": 4})
    assert res.comparison.count() == 2
    assert res.bundle.threshold in S.THRESHOLDS
    assert res.test_scored.count() == round(0.2 * clean.where("is_canceled = 1").count()) + \
        round(0.2 * clean.where("is_canceled = 0").count())

    thresholds = FE.fit_value_thresholds(clean)
    batch, dash = flows.scoring_flow(clean, res.bundle, thresholds)
    assert sum(dash["tiers"].first()) == n

    # stream the same rows as CSV files and compare with the batch scores
    src = os.path.join(base, "incoming")
    write_bookings(clean.repartition(3), src, fmt="csv")
    out, ck = os.path.join(base, "scored"), os.path.join(base, "ck")
    q = ST.start_scoring(spark, src, out, ck, res.bundle, thresholds, available_now=True)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    assert streamed.count() == n
    joined = streamed.alias("s").join(batch.alias("b"), S.BOOKING_ID)
    diff = joined.where(F.abs(F.col(f"s.{S.PROBABILITY}") - F.col(f"b.{S.PROBABILITY}")) > 1e-12).count()
    assert diff == 0
