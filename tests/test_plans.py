"""Physical-plan checks: pruning, no Python on the data path, no whole-table windows."""

import re

from touchline.operators import history as H
from touchline.plans import pipeline as P
from touchline.sources.testdata import matches


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lineitem_scan_is_pruned(spark, sf):
    plan = _plan(matches(spark, sf))
    scans = [l for l in plan.splitlines() if "lineitem" in l and "ReadSchema" in l] or \
        [l for l in _explain(matches(spark, sf)).splitlines() if "ReadSchema" in l and "l_orderkey" in l]
    assert scans
    for line in scans:
        schema = line[line.index("ReadSchema"):]
        assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def _explain(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_history_plan_has_no_python_and_no_unpartitioned_window(spark, sf):
    h = H.history_features_v3(P.features_v3(spark, sf), chunk_rows=1000)
    plan = _plan(h)
    assert "EvalPython" not in plan and "PythonUDF" not in plan
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert windows and all(spec.strip() for spec in windows)
    # team frames run per (team, chunk), never per team alone
    assert any("__chunk" in spec for spec in windows)


def _side_features(df) -> set[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {f for f in H.SIDE_FEATURES[1:] if re.search(rf"\bAS {f}#", plan)}


def test_history_computes_what_is_asked(spark, sf):
    v1 = P.features_v1(spark, sf)
    four = {"cf_avg_5", "ca_avg_5"}  # of both sides
    assert _side_features(H.history_features_v1(v1)) == four
    assert _side_features(H.history_features_v1(v1, wanted=["expected_corners_total"])) == {"cf_avg_5"}
    v3 = P.features_v3(spark, sf)
    only = H.history_features_v3(v3, wanted=["h2h_corner_history"])
    assert _side_features(only) == set() and only.columns == ["match_id", "h2h_corner_history"]
    assert "__chunk" not in _plan(only)
    total = H.history_features_v3(v3, wanted=["expected_total_corners"])
    assert _side_features(total) == {"cf_avg_6", "ca_avg_6", "var_5"}
    assert "p_lo" not in _plan(total)  # no pair window
    full = {tuple(r) for r in H.history_features_v3(v3).select("match_id", "expected_total_corners").collect()}
    assert {tuple(r) for r in total.collect()} == full


def test_unshared_queries_write_no_history(spark, sf):
    spark.conf.set("touchline.stage.reuse", "false")
    try:
        asked = P.history_tv(spark, sf, wanted=["h2h_avg_corners"])
        assert asked.columns == ["match_id", "h2h_avg_corners"] and "__chunk" not in _plan(asked)
    finally:
        spark.conf.set("touchline.stage.reuse", "true")


def test_queries_that_name_columns_write_no_history(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "_STAGES", {})
    asked = P.history_tv(spark, sf, wanted=["home_defensive_solidity"])
    assert asked.columns == ["match_id", "home_defensive_solidity"] and _side_features(asked) == {"solidity_tv"}
    rows = P.history_rows(spark, sf, P.history_tv, ["home_rest_days"], 50)
    assert rows.columns == ["match_id", "date_gmt", "home_rest_days"] and rows.count() == P.history_tv(spark, sf).count() - 50
    # the full-width table is read once it is there
    assert "__chunk" not in _plan(P.history_tv(spark, sf, wanted=["home_rest_days"]))


def test_queries_without_features_take_no_quantiles(spark, sf, monkeypatch):
    from touchline.functions import quantiles
    from touchline.plans.catalog import REGISTRY

    P.features_v3(spark, sf), P.features_tv(spark, sf)
    monkeypatch.setattr(P, "_STAGES", dict(P._STAGES))
    for key in [k for k in P._STAGES if k[1].startswith(("matrix", "history", "expected"))]:
        P._STAGES.pop(key)

    def fail(*args):
        raise AssertionError("quantiles of columns that the result does not depend on")

    monkeypatch.setattr(quantiles, "_brackets", fail)
    for key in ("one_hot", "cv_scores", "regression_metrics"):
        assert REGISTRY[key].fn(spark, sf).count() > 0


def test_narrow_history_has_the_rows_of_the_full_one(spark, sf):
    f = P.features_tv(spark, sf).limit(40)
    twice = f.unionByName(f.orderBy("match_id").limit(3))
    full = H.history_features_tv(twice)
    for wanted in (["season_period"], ["home_form_3"], ["h2h_avg_corners", "away_form_6"]):
        narrow = H.history_features_tv(twice, wanted=wanted)
        assert sorted(narrow.collect(), key=str) == sorted(full.select(narrow.columns).collect(), key=str)
