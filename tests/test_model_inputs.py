"""Inputs from the schema, the keyed table, and models on the planted label."""
import tempfile

import pytest

from bookwatch import schema as S
from bookwatch.operators import decision as DC
from bookwatch.operators import evaluate as EV
from bookwatch.operators import models as MD
from bookwatch.operators import preprocess as PP
from bookwatch.operators import quality as Q
from bookwatch.plans.registry import _model_checks, features, scored_test
from bookwatch.sources.keyed import lookup, write_keyed

from .conftest import SF_SMALL


def test_groups_follow_the_schema(spark):
    f = features(spark, SF_SMALL)
    groups = PP.model_groups(f)
    assert {k: len(v) for k, v in groups.items()} == {"numeric": 21, "nominal": 6, "ordinal": 3, "binary": 18}
    assert {"children", "adults", "babies", "days_in_waiting_list"} <= set(groups["numeric"])
    assert not set(S.MODEL_EXCLUDE) & set(PP.input_columns(groups))
    more = f.selectExpr("*", "adr * 2 AS twice")
    assert "twice" in PP.model_groups(more)["numeric"]
    with pytest.raises(ValueError, match="odd"):
        PP.model_groups(f.selectExpr("*", "'x' AS odd"))
    assert Q.group_report(f.select("adr", "hotel"), {"numeric": ["adr", "gone"]}).collect() == [
        ("adr", "numeric"), ("gone", "missing"), ("hotel", "unused")]


def test_lookup_by_key(spark):
    scored = scored_test(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="bw-keyed-") + "/t"
    table = write_keyed(scored, path, S.BOOKING_ID, folder_rows=50)
    row = scored.orderBy(S.BOOKING_ID).first()
    found = DC.review_booking(table, row[S.BOOKING_ID])
    assert found.collect() == DC.review(scored.where(f"booking_id = {row[S.BOOKING_ID]}")).collect()
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(key_folder_of_" in plan and "PushedFilters: [" in plan and "booking_id" in plan
    assert lookup(table, S.BOOKING_ID, -5).count() == 0
    assert lookup(spark.read.parquet(path), S.BOOKING_ID, row[S.BOOKING_ID]).count() == 1  # in another session
    with pytest.raises(ValueError):
        lookup(scored, S.BOOKING_ID, 1)


def test_lookup_of_strings_and_missing_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    table = write_keyed(df, tempfile.mkdtemp(prefix="bw-keyed-") + "/t", "k", folder_rows=1)
    assert sorted(r["v"] for r in lookup(table, "k", "a").collect()) == [1, 2]
    assert [r["v"] for r in lookup(table, "k", None).collect()] == [3]


def test_models_hold_what_they_must(spark):
    rows = _model_checks(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 10 and all(r["holds"] for r in rows), rows


def test_boosted_weights_and_shared_scoring(spark):
    f = features(spark, SF_SMALL)
    bundles = MD.fit_bundles(f, ["boosted", "boosted_balanced"], params={k: {"max_iter": 3} for k in MD.KINDS})
    scored, names = MD.score_all(f, bundles)
    apart = scored.where(f"abs({names['boosted']} - {names['boosted_balanced']}) > 1e-9").count()
    assert apart > 0  # the weights differ, so do the models
    alone = MD.score_bundle(f, bundles["boosted"]).select(S.BOOKING_ID, S.PROBABILITY)
    assert scored.join(alone, S.BOOKING_ID).where(f"{names['boosted']} <> {S.PROBABILITY}").count() == 0
    assert EV.metrics_by_model(scored, {k: scored[n] for k, n in names.items()}).count() == 2
    with pytest.raises(ValueError, match="share"):
        MD.score_all(f, {"a": bundles["boosted"], "b": MD.fit_bundle(f, "logistic")})


def test_attribution_of_given_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, flat double")
    assert [tuple(r) for r in MD.attribution(df, {"x": -2.0, "flat": 1.0}).collect()] == [("x", 2.0, -1.0), ("flat", 0.0, None)]
