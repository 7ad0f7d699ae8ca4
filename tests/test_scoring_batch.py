"""A batch as a user has it: no outcome, no key, raw or derived, bundle loaded."""
import tempfile

import pytest

from bookwatch import schema as S
from bookwatch.operators import features as FE
from bookwatch.operators import models as MD
from bookwatch.plans.flows import scoring_flow
from bookwatch.sources.bookings import bookings

from .conftest import SF_SMALL


def test_batch_without_outcome_and_key(spark):
    raw = bookings(spark, SF_SMALL).limit(400).cache()
    limits = FE.fit_value_thresholds(raw)
    feats = FE.derive_features(raw, limits)
    bundle = MD.fit_bundle(feats, "logistic")
    with pytest.raises(ValueError, match="thresholds"):
        scoring_flow(raw, bundle)
    bundle.value_thresholds = limits
    path = tempfile.mkdtemp(prefix="bw-bundle-")
    MD.save_bundle(bundle, path + "/b")
    loaded = MD.load_bundle(spark, path + "/b")
    assert loaded.value_thresholds == limits

    want = [r[0] for r in MD.score_bundle(feats, bundle).select(S.PROBABILITY).collect()]
    batch = raw.select(*S.SCORING_COLUMNS)
    scored, dash = scoring_flow(batch, loaded, out=path + "/scored")
    assert sorted(r[0] for r in scored.select(S.PROBABILITY).collect()) == pytest.approx(sorted(want), abs=1e-12)
    assert spark.read.option("header", True).csv(path + "/scored").count() == raw.count()
    assert dash["preview"].count() == dash["advice"].count() == sum(dash["tiers"].first()) == raw.count()
    derived, _ = scoring_flow(feats.drop(S.TARGET, S.BOOKING_ID), loaded)
    assert sorted(r[0] for r in derived.select(S.PROBABILITY).collect()) == pytest.approx(sorted(want), abs=1e-12)
    with pytest.raises(ValueError, match="adr"):
        scoring_flow(batch.drop("adr"), loaded)
