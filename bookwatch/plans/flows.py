"""End-to-end flows: audit -> EDA -> features -> training -> scoring.

Each stage hands over through a table written under a shared folder (by
default ``<spark.checkpoint.dir>/bookwatch``), which also cuts lineage: a lost
executor re-reads the written table instead of recomputing every upstream
join. Reports are returned as lazy DataFrames.

Decisions on the notebooks' known defects: the 75th-percentile flags and the
preprocessing are fitted on the training split only; the decision threshold
is chosen on a validation split carved from training data, not on the test
set; the best model and threshold are the computed ones, not constants.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import decision as DC
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import models as MD
from ..operators import preprocess as PP
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import segments as SG
from ..session import ensure_checkpoint_dir
from ..sources.bookings import bookings, write_bookings


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for each run, so that tables of an earlier run stay readable."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bookwatch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and return the re-read table (lineage cut)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def audit_flow(spark: SparkSession, sf_dir: str, out: str | None = None) -> tuple[DataFrame, dict]:
    """Entry 1, first notebook: profile the raw table, drop duplicate rows,
    write the clean table."""
    raw = bookings(spark, sf_dir)
    reports = {
        "shape": Q.table_shape(raw), "info": Q.table_info(raw), "missing": Q.missing_report(raw),
        "duplicates": Q.duplicate_count(raw),
        "describe": PR.describe(raw, Q.columns_of(raw, "numeric")),
        "target": PR.target_distribution(raw),
        "top_categories": PR.top_categories(raw, Q.columns_of(raw, "string"), 10),
    }
    clean = materialize(Q.drop_duplicates(raw), out or work_dir(spark, "clean"))
    return clean, reports


def eda_flow(clean: DataFrame, out: str | None = None) -> tuple[DataFrame, dict]:
    """Second notebook: outcome by segment, bucket, count key and month; the
    enriched table is written."""
    eda = materialize(FE.enrich_eda(clean), out or work_dir(clean.sparkSession, "eda"))
    reports = {
        "totals": PR.cancel_totals(eda),
        "segments": SG.segment_summaries(eda, ["hotel", "market_segment", "deposit_type", "customer_type"]),
        "lead_time": SG.lead_time_summary(eda), "adr": SG.adr_summary(eda),
        "monthly": SG.monthly_summary(eda), "hotel_monthly": SG.hotel_monthly_rate(eda),
        "value": SG.value_by_outcome(eda),
    }
    return eda, reports


@dataclass
class TrainingResult:
    bundle: MD.Bundle
    comparison: DataFrame
    sweep: DataFrame
    test_scored: DataFrame
    reports: dict = field(default_factory=dict)


def training_flow(clean: DataFrame, kinds=tuple(MD.KINDS), label: str = S.TARGET,
                  bundle_path: str | None = None, **model_params) -> TrainingResult:
    """Entry 2: split, fit on train only, choose the model and its threshold on
    validation, report on test, profile segment risk, save the bundle. Rows
    without a label are in no part."""
    spark = clean.sparkSession
    cond = PP.split_condition(clean, target=label)
    train_raw, test_raw = clean.where(~cond), clean.where(cond)
    thresholds = FE.fit_value_thresholds(train_raw)  # no leakage from the test split
    feats = materialize(FE.derive_features(clean, thresholds).withColumn("__test", cond),
                        work_dir(spark, "features"))
    train, test = feats.where(~F.col("__test")).drop("__test"), feats.where(F.col("__test")).drop("__test")
    vcond = PP.split_condition(train, target=label, seed=7)
    fit_part, valid = train.where(~vcond), train.where(vcond)

    bundles = MD.fit_bundles(fit_part, kinds, label, params=model_params)

    def compared(part: DataFrame) -> DataFrame:
        scored, names = MD.score_all(part, bundles)
        return EV.compare_models(EV.metrics_by_model(scored, {k: F.col(n) for k, n in names.items()}, y=label))

    comparison = compared(valid)
    best_name = EV.best_model(comparison).first()["model"]
    best = bundles[best_name]
    sweep = EV.threshold_sweep(MD.score_bundle(valid, best), y=label)
    best.threshold = float(EV.best_threshold(sweep).first()["threshold"])
    best.value_thresholds = thresholds
    scored = DC.add_risk_columns(MD.score_bundle(test, best), best.threshold)
    profile = DC.segment_profile(scored, y=label)
    reports = {"test_comparison": compared(test), "segment_risk": DC.segment_risk_all(profile),
               "exposure": DC.segment_revenue_exposure(scored),
               "report": EV.classification_report(scored, y=label)}
    if bundle_path:
        MD.save_bundle(best, bundle_path)
    return TrainingResult(best, comparison, sweep, scored, reports)


def scoring_flow(df: DataFrame, bundle: MD.Bundle, thresholds: dict | None = None,
                 out: str | None = None) -> tuple[DataFrame, dict]:
    """Entry 3: score a batch (one narrow stage until the dashboard aggregates),
    with tiers, revenue at risk and advice. The batch holds raw bookings or
    already derived features; it needs neither the outcome nor a key. Features
    are derived with ``thresholds``, by default those kept in the bundle; ``out``
    is a folder for the scored rows as CSV."""
    if Q.missing_columns(df, bundle.features):
        Q.require_columns(df, S.SCORING_COLUMNS)
        limits = thresholds if thresholds is not None else bundle.value_thresholds
        if limits is None:
            raise ValueError("the bundle keeps no value thresholds: pass those of the training data")
        feats = FE.derive_features(df, limits)
    else:
        feats = df
    scored = DC.add_risk_columns(MD.score_bundle(feats, bundle), bundle.threshold)
    if out:
        write_bookings(scored, out, fmt="csv")
    advice = DC.review(scored, bundle.threshold)
    dash = DC.dashboard_by_segment(scored)
    return scored, {"tiers": DC.tier_counts(scored), "totals": DC.dashboard_totals(scored),
                    "by_segment": dash, "top_segment": DC.top_segment(dash), "advice": advice,
                    "preview": DC.scored_preview(scored)}
