"""Scoring and evaluation on a probability column.

All metrics are SQL aggregates over the scored frame. Curves and the AUC
first reduce rows to one row per distinct score (map-side combined), and the
running sums over the score order use range blocks of the written counts
(:func:`running_sums`), so the scored frame is evaluated once and no step sorts
all rows in one task.

A null or NaN score is no score: it never predicts 1, is no threshold, and has
no part in the AUC. Rows without an outcome are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import reaches
from ..functions.prefix import running_sums

METRIC_DIGITS = 6


def probability_of_class1(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def score(df: DataFrame, model, threshold: float = S.DEFAULT_THRESHOLD,
          keep_model_columns: bool = False) -> DataFrame:
    """O-57: model probability of class 1 and the thresholded class."""
    out = model.transform(df)
    out = out.withColumn(S.PROBABILITY, probability_of_class1())
    out = apply_threshold(out, S.PROBABILITY, threshold)
    if not keep_model_columns:
        out = out.select(*df.columns, S.PROBABILITY, S.PREDICTION)
    return out


def apply_threshold(df: DataFrame, p: str = S.PROBABILITY, threshold: float = S.DEFAULT_THRESHOLD,
                    name: str = S.PREDICTION) -> DataFrame:
    return df.withColumn(name, F.when(reaches(p, threshold), 1).otherwise(0))


def _counts(y: Column, yhat: Column):
    return [F.count_if((y == 0) & (yhat == 0)).alias("tn"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
            F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 1) & (yhat == 1)).alias("tp")]


def confusion(df: DataFrame, y: str = S.TARGET, yhat: str = S.PREDICTION) -> DataFrame:
    """O-61: tn, fp, fn, tp in one pass."""
    return df.agg(*_counts(F.col(y), F.col(yhat)))


def _ratio(n, d) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def _metric_cols(tn, fp, fn, tp, digits=METRIC_DIGITS):
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    acc = _ratio(tp + tn, tp + tn + fp + fn)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [r(acc).alias("accuracy"), r(prec).alias("precision"), r(rec).alias("recall"),
            r(f1).alias("f1_score")]


def binary_metrics(df: DataFrame, y: str = S.TARGET, yhat: str = S.PREDICTION,
                   digits: int | None = METRIC_DIGITS) -> DataFrame:
    """O-62: accuracy, precision, recall, F1 of class 1 (zero denominators
    give 0)."""
    c = confusion(df, y, yhat)
    return c.select(*_metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), digits))


def score_counts(df: DataFrame, y: str = S.TARGET, p: str = S.PROBABILITY) -> DataFrame:
    """One row per distinct score with its positive and negative counts."""
    x = F.col(p).cast("double")
    return (df.where(x.isNotNull() & ~F.isnan(x) & F.col(y).isNotNull())
            .groupBy(x.alias("score"))
            .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))


def roc_auc(df: DataFrame, y: str = S.TARGET, p: str = S.PROBABILITY) -> DataFrame:
    """O-63: exact ROC-AUC with ties (Mann-Whitney): for each distinct score,
    positives x (negatives strictly below + half the tied negatives), over
    P x N."""
    cum = running_sums(score_counts(df, y, p), [F.col("score")], ["neg"], inclusive=False)
    num = F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") * F.lit(0.5)))
    den = F.sum("pos") * F.sum("neg")
    return cum.agg(F.when(den > 0, num / den).alias("roc_auc"))


def _curve(df, y, p):
    cum = running_sums(score_counts(df, y, p), [F.col("score").desc()], ["pos", "neg"])
    return cum.withColumnsRenamed({"total_pos": "P", "total_neg": "N"})


def _with_end(curve: DataFrame, x: float, y: float) -> DataFrame:
    """The curve from its point without a threshold (nothing predicted) on."""
    end = curve.sparkSession.range(1).select(
        F.lit(None).cast("double"), F.lit(x), F.lit(y), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return curve.union(end).orderBy(F.desc_nulls_first("threshold"))


def roc_curve(df: DataFrame, y: str = S.TARGET, p: str = S.PROBABILITY,
              digits: int = METRIC_DIGITS) -> DataFrame:
    """O-65: (threshold, fpr, tpr) at every distinct score, predicting 1 for
    scores >= threshold, after the start point (0, 0) without a threshold."""
    c = _curve(df, y, p)
    out = c.select(F.col("score").alias("threshold"),
                   F.round(F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")), digits).alias("fpr"),
                   F.round(F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")), digits).alias("tpr"),
                   F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    return _with_end(out, 0.0, 0.0)


def pr_curve(df: DataFrame, y: str = S.TARGET, p: str = S.PROBABILITY,
             digits: int = METRIC_DIGITS) -> DataFrame:
    """O-66: (threshold, precision, recall) at every distinct score, and the end
    point of precision 1 and recall 0 without a threshold."""
    c = _curve(df, y, p)
    out = c.select(F.col("score").alias("threshold"),
                   F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), digits).alias("precision"),
                   F.round(F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")), digits).alias("recall"),
                   F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    return _with_end(out, 1.0, 0.0)


def classification_report(df: DataFrame, y: str = S.TARGET, yhat: str = S.PREDICTION,
                          digits: int = 4) -> DataFrame:
    """O-64: precision / recall / F1 / support per class, accuracy, macro and
    support-weighted averages, from the four confusion counts."""
    c = confusion(df, y, yhat)
    tn, fp, fn, tp = (F.col(x) for x in ["tn", "fp", "fn", "tp"])
    n = tn + fp + fn + tp
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn)
    s0, s1 = tn + fp, tp + fn
    rnd = lambda e: F.round(e, digits)

    def row(label, pr, rc, f, sup):
        return F.struct(F.lit(label).alias("label"), rnd(pr).alias("precision"), rnd(rc).alias("recall"),
                        rnd(f).alias("f1_score"), sup.cast("long").alias("support"))
    rows = [row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
            row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _ratio(tp + tn, n), n),
            row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            row("weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n),
                _ratio(f0 * s0 + f1 * s1, n), n)]
    return c.select(F.inline(F.array(*rows)))


def threshold_sweep(df: DataFrame, y: str = S.TARGET, p: str = S.PROBABILITY,
                    thresholds: Sequence[float] = tuple(S.THRESHOLDS), digits: int = 3) -> DataFrame:
    """O-67: accuracy / precision / recall / F1 at each threshold (rounded to
    3 as reported). Rows are counted by outcome and by the number of thresholds
    their score reaches, then those few counts are expanded over the list: one
    shuffle of as many rows as there are thresholds for each map task."""
    levels = sorted(set(map(float, thresholds)))
    reached = sum((F.when(reaches(p, t), 1).otherwise(0) for t in levels), F.lit(0))
    counts = (df.where(F.col(y).isNotNull()).groupBy(reached.alias("reached"))
              .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    t = F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("at", "threshold")
    hit = F.col("reached") > F.col("at")
    agg = counts.select("*", t).groupBy("threshold").agg(
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"))
    return agg.select("threshold", *_metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), digits)) \
              .orderBy("threshold")


def best_threshold(sweep: DataFrame, metric: str = "f1_score") -> DataFrame:
    """O-68: the threshold with the best (rounded) metric; ties -> lowest."""
    return sweep.orderBy(F.desc(metric), F.asc("threshold")).limit(1)


def metrics_by_model(df: DataFrame, scores: dict[str, Column], y: str = S.TARGET, threshold: float = 0.5,
                     digits: int | None = METRIC_DIGITS) -> DataFrame:
    """Accuracy, precision, recall, F1 at ``threshold`` and ROC-AUC of each named
    score: one evaluation of ``df``, one count by (model, score), and one running
    sum over the counts, keyed by the model, for all of them."""
    long = df.where(F.col(y).isNotNull()).select(F.col(y).alias("__y"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("score"))
        for n, c in scores.items()])))
    counts = long.groupBy("model", "score").agg(F.count_if(F.col("__y") == 1).alias("pos"),
                                                F.count_if(F.col("__y") == 0).alias("neg"))
    # rows without a score come first and are taken out of the sums below
    cum = running_sums(counts, [F.col("model"), F.col("score")], ["neg"], ["model"], inclusive=False)
    hit = reaches("score", threshold)
    agg = cum.groupBy("model").agg(
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        _auc_expr(F.col("score").isNotNull()).alias("roc_auc"))
    auc = F.round("roc_auc", digits) if digits is not None else F.col("roc_auc")
    return agg.select("model", *_metric_cols(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), digits),
                      auc.alias("roc_auc"))


def model_metrics(df: DataFrame, name: str, y: str = S.TARGET, p: str = S.PROBABILITY,
                  threshold: float = 0.5, digits: int | None = METRIC_DIGITS) -> DataFrame:
    """The metrics row of one model (the notebook's metrics dictionary)."""
    return metrics_by_model(df, {name: F.col(p)}, y, threshold, digits)


def _auc_expr(valid) -> Column:
    """Mann-Whitney AUC over rows of (score, pos, neg, cum_neg) where
    ``valid`` holds; ``cum_neg`` counts negatives strictly below the score.
    Invalid rows sort below every valid score, so their negatives are taken
    out of every ``cum_neg`` as one constant."""
    pos = F.when(valid, F.col("pos")).otherwise(0)
    neg = F.when(valid, F.col("neg")).otherwise(0)
    neg_invalid = F.sum(F.when(valid, 0).otherwise(F.col("neg")))
    num = F.sum(pos * (F.col("cum_neg") + neg * F.lit(0.5))) - neg_invalid * F.sum(pos)
    den = F.sum(pos) * F.sum(neg)
    return F.when(den > 0, num / den)


def compare_models(*metrics: DataFrame) -> DataFrame:
    """O-69: metric rows of models together, best ROC-AUC first."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out.orderBy(F.desc("roc_auc"), "model")


def best_model(comparison: DataFrame, by: str = "roc_auc") -> DataFrame:
    """O-69: the best row by ``by`` (ties by name)."""
    return comparison.orderBy(F.desc(by), "model").limit(1)
