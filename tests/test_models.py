"""Models on the planted label: they learn, the bundle round-trips, and the
preprocessed matrix is finite (SURVEY §5 c, phase 8)."""
import os
import tempfile

from bookwatch import schema as S
from bookwatch.operators import evaluate as EV
from bookwatch.operators import models as MD
from bookwatch.operators import preprocess as PP
from bookwatch.operators import quality as Q
from bookwatch.plans.registry import features
from bookwatch.sources import fixtures as FX

SF = "/root/testdata/sf0.01"


def _split(spark):
    f = FX.with_planted_label(features(spark, SF))
    cond = PP.split_condition(f, target="planted_label")
    return f.where(~cond), f.where(cond)


def test_logistic_learns_and_roundtrips(spark):
    tr, te = _split(spark)
    b = MD.fit_bundle(tr, "logistic", label="planted_label")
    sc = MD.score_bundle(te, b)
    auc = EV.roc_auc(sc, y="planted_label").first()[0]
    assert auc > 0.75
    path = os.path.join(tempfile.mkdtemp(prefix="bw-bundle-"), "b")
    MD.save_bundle(b, path)
    loaded = MD.load_bundle(spark, path)
    assert loaded.name == "logistic" and loaded.threshold == S.DEFAULT_THRESHOLD
    a = {r[0]: r[1] for r in sc.select(S.BOOKING_ID, S.PROBABILITY).collect()}
    c = {r[0]: r[1] for r in MD.score_bundle(te, loaded).select(S.BOOKING_ID, S.PROBABILITY).collect()}
    assert a == c
    assert Q.assert_finite(b.model.transform(te)).first()["non_finite_rows"] == 0
    names = PP.feature_names(MD.preprocessor_of(b))
    assert len(names) == len(b.model.stages[-1].coefficients) and names[0] == "lead_time"
    attr = MD.linear_attribution(b.model.transform(te), b, 5).collect()
    assert len(attr) == 5 and attr[0]["mean_abs_attribution"] >= attr[-1]["mean_abs_attribution"]


def test_forest_small_learns(spark):
    tr, te = _split(spark)
    b = MD.fit_bundle(tr, "forest", label="planted_label", num_trees=20, max_depth=5)
    auc = EV.roc_auc(MD.score_bundle(te, b), y="planted_label").first()[0]
    assert auc > 0.75
    imp = MD.feature_importance(b, 5).collect()
    assert len(imp) == 5


def test_permutation_importance_finds_planted_columns(spark):
    tr, te = _split(spark)
    b = MD.fit_bundle(tr, "forest", label="planted_label", num_trees=20, max_depth=5)
    cols = ["deposit_type", "lead_time", "hotel", "adr"]
    imp = {r["feature"]: r for r in MD.permutation_importance(te, b, cols, label="planted_label").collect()}
    assert imp["deposit_type"]["importance"] > 0.02
    assert imp["deposit_type"]["importance"] > imp["hotel"]["importance"]
    assert imp["lead_time"]["direction"] > 0  # long lead raises the planted probability
