"""Operators rewritten for scale: same answers as the plain definition."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import quantiles as Q
from touchline.functions.quantiles import exact_quantiles
from touchline.operators import clean as C
from touchline.operators import history as H
from touchline.operators import model as M
from touchline.operators import report as R
from touchline.operators import select as SE


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    n = 20_000
    data = {"normal": rng.normal(size=n), "heavy": np.exp(rng.normal(size=n) * 5), "few": rng.integers(0, 4, n) * 1.0,
            "constant": np.ones(n), "mostly_zero": (rng.random(n) < 0.01) * rng.normal(size=n)}
    rows = [tuple(float(data[c][i]) if (i + k) % 7 else None for k, c in enumerate(data)) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in data) + ", empty DOUBLE")
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for accuracy in (100, 10_000):  # a coarse sketch gives the same exact answer
        got = exact_quantiles(df, df.columns, ps, accuracy)
        assert got["empty"] == [None] * len(ps)
        for k, c in enumerate(data):
            values = np.array([r[k] for r in rows if r[k] is not None])
            assert np.allclose(got[c], np.quantile(values, ps), rtol=1e-12, atol=1e-12), c
    assert exact_quantiles(df.limit(0), ["normal"], [0.5]) == {"normal": [None]}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1002, 1003])
def test_quantiles_of_few_rows(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    ps = [0.01, 0.1, 0.25, 0.3, 0.5, 0.7, 0.75, 0.9, 0.99]
    assert np.allclose(exact_quantiles(df, ["x"], ps)["x"], np.quantile(x, ps), rtol=1e-12)


def test_no_ungrouped_percentile_in_winsorising(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else 1.0) for i in range(100)], "a DOUBLE, b DOUBLE")
    for out in (C.iqr_winsorise(df, ["a", "b"]), C.pct_winsorise(df, ["a", "b"]), C.fill_medians(df, ["a", "b"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_positions_keep_rows_without_a_date(spark):
    days = [None, dt.datetime(2020, 1, 2, 15), dt.datetime(2020, 1, 2, 20), dt.datetime(2020, 1, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "match_id BIGINT, date_gmt TIMESTAMP_NTZ")
    for bucket in (2, 1_000_000):
        got = {r["match_id"]: r["position"] for r in M.global_position(df, bucket_rows=bucket).collect()}
        assert got == {3: 0, 1: 1, 2: 2, 0: 3, 4: 4}
    roles = [r["role"] for r in M.chrono_holdout(df, 0.8).orderBy("position").collect()]
    assert roles == ["train"] * 4 + ["test"]


@pytest.mark.parametrize("second, want", [((2020, 1, 3, 15), 1.0), ((2020, 1, 3, 20), 2.0), ((2020, 3, 1, 0), 30.0)])
def test_rest_days_are_whole_24_hours(spark, second, want):
    rows = [(0, dt.datetime(2020, 1, 1, 20), "A", "B", 1.0, 1.0, 1.0, 1.0),
            (1, dt.datetime(*second), "A", "C", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "match_id BIGINT, date_gmt TIMESTAMP_NTZ, home_team_name STRING, "
                               "away_team_name STRING, home_team_corner_count DOUBLE, away_team_corner_count DOUBLE, "
                               "home_team_goal_count DOUBLE, away_team_goal_count DOUBLE")
    got = H.team_history(df).where((F.col("team") == "A") & (F.col("match_id") == 1)).first()
    assert got["rest_days"] == want


def test_encoding_of_an_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "match_id BIGINT, team STRING")
    test = spark.createDataFrame([(4, "b"), (5, "new"), (6, "a"), (7, None)], "match_id BIGINT, team STRING")
    got = SE.apply_one_hot(test, SE.fit_one_hot(train, ["team"]), ["team"]).collect()
    assert [(r["match_id"], r["feature"]) for r in got] == [(4, "team_b")]


def test_scale_uses_the_training_rows(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "match_id BIGINT, x DOUBLE, k DOUBLE")
    test = spark.createDataFrame([(3, 5.0, 7.0)], "match_id BIGINT, x DOUBLE, k DOUBLE")
    r = SE.apply_scale(test, SE.fit_scale(train, ["x", "k"]), ["x", "k"], ["match_id"]).first()
    assert (r["x"], r["k"]) == (3.0, 2.0)


def test_correlation_survives_large_offsets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    y = x + rng.normal(size=2000)
    df = spark.createDataFrame([(float(a) + 1e9, float(b) + 1e9, 3.0) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE, c DOUBLE")
    got = {r["feature"]: r["r"] for r in SE.f_regression_scores(df, ["x", "c"], "y").collect()}
    assert abs(got["x"] - np.corrcoef(x, y)[0, 1]) < 1e-6 and got["c"] is None


def test_class_counts(spark):
    df = spark.createDataFrame([(1, 1, None), (0, 1, None), (1, None, None)], "a INT, b INT, c INT")
    got = {r["target"]: (r["n_classes"], r["trainable"]) for r in R.class_balance(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), "c": (0, 0)}


def test_dedup_and_pivot_plan_hash_aggregates(spark, sf):
    from touchline.plans.catalog import REGISTRY
    from touchline.plans import pipeline as P

    for df in (C.dedup_matches(C.parse_dates(P.raw(spark, sf))), H.sides_wide(H.team_history(P.features_v3(spark, sf)))):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert REGISTRY["load_matches"].fn(spark, sf).count() == P.raw(spark, sf).count()


def test_presets_are_the_default_and_can_be_made_smaller():
    assert M.preset("total_corners")["trees"] == 2000 and M.preset("over_10_5_corners")["trees"] == 1700
    assert M.preset("over_7_5_corners") == {"trees": 700, "max_depth": 8, "step": 0.07, "subsample": 0.8, "min_rows": 3}
    assert M.preset("over_7_5_corners", trees=5)["trees"] == 5
    draws = [M.draw_params("classification", t) for t in range(200)]
    assert all(4 <= d["maxDepth"] <= 12 and 100 <= d["maxIter"] <= 1500 and 0.01 <= d["stepSize"] <= 0.3 for d in draws)
    assert 0.3 < np.mean([d["stepSize"] < 0.0548 for d in draws]) < 0.7  # uniform in the logarithm


def test_wide_brackets_are_refined(spark):
    rng = np.random.default_rng(3)
    n = 30_000
    data = {"normal": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n) * 100), "few": rng.integers(0, 3, n) * 1.0}
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in data) + (float("nan"),) for i in range(n)],
                               ", ".join(f"{c} DOUBLE" for c in data) + ", missing DOUBLE")
    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    calls = []
    refine = Q._refine
    Q._refine = lambda *a: (calls.append(1), refine(*a))
    try:
        got = exact_quantiles(df, df.columns, ps, accuracy=50, room=40)
        assert calls  # a coarse sketch leaves too much inside
        for c in data:
            assert np.allclose(got[c], np.quantile(data[c], ps), rtol=1e-12, atol=1e-12), c
        assert got["missing"] == [None] * len(ps)
        calls.clear()
        assert exact_quantiles(df, ["normal"], ps)["normal"] == pytest.approx(np.quantile(data["normal"], ps), rel=1e-12)
        assert not calls  # two scans
    finally:
        Q._refine = refine


def test_contingency_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x) if x > -1.5 else None, float(k), int(y), float(z)) for x, k, y, z in zip(
        rng.normal(size=3000), rng.integers(0, 4, 3000), rng.random(3000) < 0.3, rng.integers(0, 6, 3000))]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, flag INT, total DOUBLE").repartition(5)
    got = {(r["target"], r["feature"], r["bin"], r["y"]): r["n"] for r in SE.contingency(df, ["a", "b"], ["flag", "total"]).collect()}
    want = {}
    for j, f in enumerate(("a", "b")):
        cuts = np.quantile([r[j] for r in rows if r[j] is not None], SE.DECILES)
        for r in rows:
            k = 0 if r[j] is None else int(sum(c < r[j] - 1e-12 for c in cuts))
            for t, y in (("flag", float(r[2])), ("total", r[3])):
                want[t, f, k, y] = want.get((t, f, k, y), 0) + 1
    assert got == want
    assert SE.contingency(df.limit(0), ["a", "b"], ["flag"]).count() == 0


def test_features_and_splits_share_one_cleaned_table(spark, sf, monkeypatch):
    from touchline.plans import pipeline as P

    written, write = [], P._write_stage

    def counted(df):
        written.append(df)
        return write(df)

    monkeypatch.setattr(P, "_write_stage", counted)
    monkeypatch.setattr(P, "_STAGES", {})
    for features, keys in ((P.features_v3, P.split_keys_v3), (P.features_v1, P.split_keys_v1)):
        features(spark, sf)
        before = len(written)
        assert keys(spark, sf).count() > 0
        assert len(written) == before  # no second cleaning
    assert len(written) == 5  # raw; cleaned and features of each


def test_wide_plans_are_generated_in_methods_that_get_compiled(spark):
    from touchline.session import prepare
    key = "spark.sql.codegen.hugeMethodLimit"
    try:
        spark.conf.unset(key)
        assert prepare(spark).conf.get(key) == "8000"
        spark.conf.set(key, "5000")  # a cluster's own setting stays
        assert prepare(spark).conf.get(key) == "5000"
    finally:
        spark.conf.unset(key)
        prepare(spark)


def test_stages_are_written_without_long_generated_loops(spark):
    from touchline.plans import pipeline as P
    from touchline.session import prepare
    key, seen = "spark.sql.codegen.hugeMethodLimit", []

    class Stage:
        """A frame whose write notes the limit it runs under."""
        sparkSession = spark

        class write:
            @staticmethod
            def mode(_):
                return Stage.write

            @staticmethod
            def parquet(_):
                seen.append(spark.conf.get(key))

    try:
        for own in (None, "5000"):
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)
            before = prepare(spark).conf.get(key)
            P._write_stage(Stage)
            assert spark.conf.get(key) == before
        assert seen == ["2000", "5000"]
        wide = spark.range(0, 3_000, 1, 3).selectExpr("id", *[f"nullif(id % {k + 2}, 1) AS c{k}" for k in range(80)])
        got = P.stage(wide.repartition(4, "id"))
        assert got.exceptAll(wide).count() == 0 and got.count() == 3_000
    finally:
        spark.conf.unset(key)
        prepare(spark)


def test_sketches_are_merged_by_blocks_and_cores(spark, monkeypatch):
    from touchline.functions import quantiles as Q

    monkeypatch.setattr(Q, "BLOCK", 2)
    cores, names = spark.sparkContext.defaultParallelism, [f"c{k}" for k in range(5)]
    df = spark.range(0, 4_000, 1, 6 * cores).selectExpr(*[f"CAST((id * {k + 7}) % 1009 AS DOUBLE) AS c{k}" for k in range(5)])
    spark.sparkContext.setJobGroup("sketches", "sketches")
    try:
        size, _ = Q._brackets(df, names, [0.5], 10_000)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    tasks = [track.getStageInfo(i).numTasks for j in track.getJobIdsForGroup("sketches") for i in track.getJobInfo(j).stageIds
             if track.getStageInfo(i)]
    assert size == {c: 4_000 for c in names} and max(tasks) <= 2 * cores and len(tasks) >= 3
    got = Q.exact_quantiles(df, names, [0.25, 0.5])
    for k, c in enumerate(names):
        assert np.allclose(got[c], np.quantile([(i * (k + 7)) % 1009 for i in range(4_000)], [0.25, 0.5]))
