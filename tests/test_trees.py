"""Trees grown on blocks of binned rows, and permuted rows scored by their features."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from bookwatch.operators import evaluate as EV
from bookwatch.operators import models as MD
from bookwatch.operators import preprocess as PP
from bookwatch.operators import trees as TR
from bookwatch.plans.registry import features
from bookwatch.sources import fixtures as FX

from .conftest import SF_SMALL

WEIGHTS = {0: 0.75, 1: 1.5}


@pytest.fixture(scope="module")
def matrix(spark):
    x = [F.hash(F.col("id"), F.lit(k)) % 100 / 100.0 for k in range(4)] + [
        F.hash(F.col("id"), F.lit(k)) % 2 * 1.0 for k in range(9, 13)] + [F.lit(1.0)]
    noise = F.hash(F.col("id"), F.lit(99)) % 30 / 100.0
    df = spark.range(3000).select(array_to_vector(F.array(*x)).alias("features"),
                                  (x[0] * x[1] + x[2] * 0.3 + x[5] * 0.2 + noise > 0.2).cast("int").alias("y"))
    df = df.withColumn("weight", F.when(F.col("y") == 1, WEIGHTS[1]).otherwise(WEIGHTS[0])).coalesce(3).persist()
    edges = TR.find_borders(df, 3000, "y", WEIGHTS, 32, 1)
    yield df, edges, TR.binned(df, "y", edges)
    df.unpersist()


def _probabilities(model, df):
    return np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])


def test_without_drawing_trees_are_those_of_spark(matrix):
    df, edges, blocks = matrix
    forest = MD.forest("y", num_trees=1, max_depth=6).setBootstrap(False).setFeatureSubsetStrategy("all")
    one, other = forest.fit(df), TR.fit_forest(df.sparkSession, blocks, forest, edges, WEIGHTS)
    assert one.toDebugString.split("\n", 1)[1] == other.toDebugString.split("\n", 1)[1]
    assert np.abs(_probabilities(one, df) - _probabilities(other, df)).max() == 0
    boosted = MD.boosted("y", max_iter=5, subsample=1.0).setFeatureSubsetStrategy("all")
    one, other = boosted.fit(df), TR.fit_boosted(df.sparkSession, blocks, [boosted], edges, [WEIGHTS])[0]
    assert np.abs(_probabilities(one, df) - _probabilities(other, df)).max() < 1e-12
    assert np.abs(one.featureImportances.toArray() - other.featureImportances.toArray()).max() < 1e-12
    assert other.treeWeights == one.treeWeights and other.totalNumNodes == one.totalNumNodes


def test_boosted_models_of_other_weights_share_their_passes(matrix, monkeypatch):
    df, edges, blocks = matrix
    ests, other = [MD.boosted("y", max_iter=3) for _ in range(2)], {0: 1.0, 1: 4.0}
    passes, real = [], TR._added
    monkeypatch.setattr(TR, "_added", lambda rdd: passes.append(1) or real(rdd))
    both = TR.fit_boosted(df.sparkSession, blocks, ests, edges, [WEIGHTS, other])
    assert len(passes) == 3 * 4 + 1  # a pass a level, and the last leaves
    for model, weights in zip(both, (WEIGHTS, other)):
        one = TR.fit_boosted(df.sparkSession, blocks, [ests[0]], edges, [weights])[0]
        assert np.abs(_probabilities(one, df) - _probabilities(model, df)).max() < 1e-12
    assert np.abs(_probabilities(both[0], df) - _probabilities(both[1], df)).max() > 0.01


def test_drawn_trees_rank_as_well_and_are_drawn_alike_again(matrix):
    df, edges, blocks = matrix
    alone = lambda s, b, est, e, w: TR.fit_boosted(s, b, [est], e, [w])[0]
    for est, fit in ((MD.forest("y", num_trees=30, max_depth=6), TR.fit_forest), (MD.boosted("y", max_iter=10), alone)):
        auc = [EV.roc_auc(m.transform(df).withColumn("p", vector_to_array("probability")[1]), "y", "p").first()[0]
               for m in (est.fit(df), *[fit(df.sparkSession, blocks, est, edges, WEIGHTS) for _ in range(2)])]
        assert auc[1] == auc[2] and auc[1] > auc[0] - 0.02


def test_bootstrap_counts_are_poisson():
    counts = TR.draws(42, 3, 5, 200_000, 1.0)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.005
    assert (counts == TR.draws(42, 3, 5, 200_000, 1.0)).all() and (counts != TR.draws(42, 4, 5, 200_000, 1.0)).any()


def test_large_tables_are_not_fitted_by_learners_that_keep_tables_of_counts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(MD, "TASK_ROWS", 20)

    def fit(self, *_):
        raise AssertionError("Spark's learner keeps numbers for each row and tree")
    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    monkeypatch.setattr(GBTClassifier, "fit", fit)
    tr, te = PP.stratified_split(FX.with_planted_label(features(spark, SF_SMALL)), target="planted_label")
    bundles = MD.fit_bundles(tr, label="planted_label", params={
        "forest": {"num_trees": 20, "max_depth": 5}, "boosted": {"max_iter": 8}, "boosted_balanced": {"max_iter": 8}})
    scored, names = MD.score_all(te, bundles)
    for r in EV.metrics_by_model(scored, {k: F.col(n) for k, n in names.items()}, y="planted_label").collect():
        assert r["roc_auc"] > 0.6, r
    for kind in ("forest", "boosted"):
        MD.save_bundle(bundles[kind], f"{tmp_path}/{kind}")
        again = MD.load_bundle(spark, f"{tmp_path}/{kind}")
        assert MD.feature_importance(again, None).collect() == MD.feature_importance(bundles[kind], None).collect()
        assert MD.classifier_of(again).getMaxDepth() == MD.classifier_of(bundles[kind]).getMaxDepth()


def test_permuted_features_score_as_permuted_rows(spark, monkeypatch):
    tr, te = PP.stratified_split(FX.with_planted_label(features(spark, SF_SMALL)), target="planted_label")
    te = te.withColumn("children", F.when(F.col("booking_id") % 3 > 0, F.col("children")))
    bundle = MD.fit_bundle(tr, "forest", label="planted_label", num_trees=10, max_depth=6)
    cols = ["deposit_type", "lead_time", "hotel", "adr", "children", "adr_bucket", "is_peak_season"]
    got = {r["feature"]: r for r in MD.permutation_importance(te, bundle, cols, label="planted_label").collect()}
    monkeypatch.setattr(MD, "RandomForestClassificationModel", ())  # scored by the model itself
    want = {r["feature"]: r for r in MD.permutation_importance(te, bundle, cols, label="planted_label").collect()}
    assert set(got) == set(want) == set(cols)
    for c in cols:
        for k in ("importance", "permuted_auc", "direction"):
            assert (got[c][k] is None) == (want[c][k] is None) and abs((got[c][k] or 0) - (want[c][k] or 0)) < 1e-9, (c, k)


def test_scores_of_more_columns_than_a_word_has_bits():
    rng = np.random.default_rng(1)
    own, other = rng.random((50, 70)), rng.random((50, 70))
    inf = np.inf
    trees = [(np.array([f, g, 0, 0, 0]), np.array([0.5, 0.3, inf, inf, inf]), np.array([1, 2, 3, 4, 2, 2, 3, 3, 4, 4]),
              np.array([0, 0, 0.1, 0.4, 0.9]), np.array([0, 0, 0.9, 0.6, 0.1]), 2) for f, g in ((0, 69), (68, 3), (69, 69))]

    def plain(x):
        total = 0.0
        for feature, threshold, kids, _, share, _ in trees:
            at = 0
            while threshold[at] < inf:
                at = kids[2 * at + (x[feature[at]] > threshold[at])]
            total += share[at]
        return total / len(trees)
    got = TR._permuted(own, other, trees, np.arange(70), 70)
    for i in range(50):
        assert abs(got[0, i] - plain(own[i])) < 1e-12
        for c in (0, 3, 5, 68, 69):
            x = own[i].copy()
            x[c] = other[i, c]
            assert abs(got[c + 1, i] - plain(x)) < 1e-12
