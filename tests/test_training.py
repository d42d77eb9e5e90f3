"""Model sets: folds, out-of-fold predictions, weights, saved models and the decisions from them, against DuckDB over the written tables."""

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from touchline.operators import model as M
from touchline.operators import score as S
from touchline.operators import training as T
from touchline.plans import pipeline as P
from touchline.plans import queries_training as QT
from touchline.plans.queries_model import TARGETS_V3, feats_v3

HARD, EASY = "over_10_5_corners", "over_7_5_corners"
SPLITS = 3


@pytest.fixture(scope="module")
def trained(spark, sf):
    feats = feats_v3()
    recent = [f for f in feats if "_3" in f or "_6" in f or "recent" in f or "trend" in f or "momentum" in f]
    selected = {"total_corners": feats[:8], EASY: feats[:6], HARD: [*feats[:6], *recent]}
    specs = QT.specs(selected, ["total_corners", EASY, HARD], trees=3, depth=3)
    table = P.stage(T.vector_table(P.feature_matrix_v3(spark, sf), M.chrono_holdout(P.split_keys_v3(spark, sf)), feats, TARGETS_V3, SPLITS))
    root = T.model_root(spark, "test")
    oof = T.out_of_fold(table, specs, feats, f"{root}/oof", SPLITS)
    weights = {(r["target"], r["model"]): r["weight"] for r in T.ensemble_weights(oof.where(F.col("target") == HARD)).collect()}
    manifest = T.save_models(table, specs, feats, weights, root)
    return table, specs, oof, manifest, root


def test_specs_follow_the_presets():
    feats = feats_v3()
    full = {s.model: s.sizes for s in QT.specs({HARD: feats}, [HARD], None, None)}
    assert [full[m]["trees"] for m in T.MEMBER_ORDER] == [1700, 1000, 1700]
    assert [full[m]["max_depth"] for m in T.MEMBER_ORDER] == [12, 12, 10]
    assert [full[m]["step"] for m in T.MEMBER_ORDER] == [0.04, 0.04, 0.06]
    assert [s.model for s in QT.specs({HARD: feats[:20]}, [HARD])] == ["xgb_optimized", "xgb_conservative"]  # too few recent


def test_folds_of_the_vector_table(trained):
    table, *_ = trained
    n = table.where("role = 'train'").count()
    size = n // (SPLITS + 1)
    by = {r["test_fold"]: r["count"] for r in table.groupBy("test_fold").count().collect()}
    assert by == {None: table.count() - n, -1: n - SPLITS * size, **{k: size for k in range(SPLITS)}}


def test_scores_and_weights_against_sql(trained):
    _, specs, oof, _, root = trained
    db = duckdb.connect()
    db.execute(f"CREATE VIEW o AS SELECT * FROM read_parquet('{root}/oof/**/*.parquet', hive_partitioning = true)".replace("file:", ""))
    assert db.sql("SELECT count(DISTINCT (target, model, fold)) FROM o").fetchall()[0][0] == len(specs) * SPLITS
    want = db.sql("""WITH f AS (SELECT target, model, fold, avg(CASE WHEN CAST(p > 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END) AS acc
        FROM o WHERE target LIKE 'over_%' GROUP BY ALL),
      m AS (SELECT target, model, avg(acc) AS acc FROM f GROUP BY ALL)
      SELECT target, model, acc, acc / sum(acc) OVER (PARTITION BY target) FROM m""").fetchall()
    got = [tuple(r) for r in T.ensemble_weights(oof).collect()]
    assert sorted((t, m, round(a, 9), round(w, 9)) for t, m, a, w in got) == sorted((t, m, round(a, 9), round(w, 9)) for t, m, a, w in want)
    assert len([1 for t, *_ in got if t == HARD]) == 3
    (cv,) = T.cv_summary(oof).where("target = 'total_corners'").collect()
    mae, two, r2 = db.sql("""WITH f AS (SELECT fold, avg(abs(y - p)) AS mae, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM o
      WHERE target = 'total_corners' GROUP BY fold) SELECT avg(mae), 2 * stddev_pop(mae), avg(r2) FROM f""").fetchall()[0]
    assert (cv["mae_mean"], cv["mae_two_std"], cv["r2_mean"]) == pytest.approx((mae, two, r2), abs=1e-9)
    assert cv["accuracy_mean"] is None and cv["n_folds"] == SPLITS


def test_fold_fits_see_no_later_rows(trained, spark):
    """A fold's predictions do not change when the rows after its training part get other labels."""
    table, specs, oof, *_ = trained
    spec = next(s for s in specs if s.target == EASY)
    train = table.where((F.col("role") == "train") & (F.col("test_fold") < 1))
    model = T.fit(spec, train, feats_v3())
    again = model.transform(T.sliced(table.where("test_fold = 1"), feats_v3(), spec.features)).select(
        "match_id", T._predicted(model, spec).alias("q"))
    both = oof.where((F.col("target") == EASY) & (F.col("fold") == 1)).join(again, "match_id")
    assert both.count() == table.where("test_fold = 1").count()
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_decisions_from_saved_models_against_sql(trained, spark):
    table, specs, _, manifest, root = trained
    rows = table.where("role = 'test'")
    loaded = T.load_manifest(spark, root)
    assert loaded.count() == len(specs)
    scored, added = T.score(loaded, rows, ["match_id"])
    scored = P.stage(scored)
    lines = {EASY: 7.5, HARD: 10.5}
    scores = T.member_scores(scored, added, lines)
    path = f"{root}/scores"
    scores.write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW s AS SELECT * FROM read_parquet('{path}/*.parquet')".replace("file:", ""))
    assert db.sql("SELECT count(*), count(p1), count(p3), min(w1) FROM s WHERE line = 7.5").fetchall()[0] == (rows.count(), rows.count(), 0, 1.0)
    assert abs(db.sql("SELECT max(abs(w1 + w2 + w3 - 1)) FROM s WHERE line = 10.5").fetchall()[0][0]) < 1e-9
    want = db.sql("""WITH d AS (SELECT match_id, line, line = 10.5 AS hard,
        CASE WHEN line = 10.5 THEN p1 * w1 + p2 * w2 + p3 * w3 ELSE p1 END AS p,
        CASE WHEN line = 10.5 THEN CAST(p1 > .5 AS INT) + CAST(p2 > .5 AS INT) + CAST(p3 > .5 AS INT) END AS k FROM s),
      e AS (SELECT *, greatest(p, 1 - p) AS conf, abs(p - .5) * 2 AS edge, hard AND k IN (0, 3) AS cons,
        CASE WHEN p > CASE WHEN hard THEN .62 ELSE .6 END THEN 'Over' WHEN 1 - p > CASE WHEN hard THEN .62 ELSE .6 END THEN 'Under' ELSE 'Skip' END AS rec FROM d)
      SELECT match_id, line, rec, round(conf, 9), CASE WHEN rec = 'Skip' THEN NULL
        WHEN cons THEN CASE WHEN conf >= .68 AND edge >= .25 THEN 'ensemble' WHEN conf >= .62 AND edge >= .15 THEN 'good' ELSE 'avoid' END
        WHEN hard THEN CASE WHEN conf >= .72 AND edge >= .35 THEN 'strong' WHEN conf >= .65 AND edge >= .22 THEN 'good' ELSE 'avoid' END
        ELSE CASE WHEN conf >= .75 AND edge >= .3 THEN 'strong' WHEN conf >= .65 AND edge >= .2 THEN 'good' ELSE 'avoid' END END,
        CASE WHEN NOT hard THEN 'Standard' WHEN cons THEN 'CONSENSUS' ELSE 'Split(' || k || '/3)' END FROM e""").fetchall()
    tiers = S.bet_tiers(S.fitted_lines(spark.read.parquet(path)))
    got = [(r["match_id"], r["line"], r["recommended"], round(r["confidence"], 9), r["tier"], r["special_info"]) for r in tiers.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    summary = S.bet_summary(S.fitted_lines(scores)).collect()
    assert {(r["lines_analysed"], r["hard_lines"]) for r in summary} == {(2, 1)}


def test_a_model_reads_back_as_it_was_fitted(trained):
    table, specs, _, manifest, _ = trained
    rows = table.where("role = 'test'")
    scored, added = T.score(manifest, rows, ["match_id"])
    spec = next(s for s in specs if s.regression)
    model = T.fit(spec, table.where("role = 'train'"), feats_v3())
    direct = model.transform(T.sliced(rows, feats_v3(), spec.features)).select("match_id", "prediction")
    column = next(c for t, *_, c in added if t == "total_corners")
    assert scored.join(direct, "match_id").agg(F.max(F.abs(F.col(column) - F.col("prediction")))).first()[0] < 1e-9
    imps = T.importances(manifest)
    assert imps.groupBy("target", "model").agg(F.round(F.sum("importance"), 6).alias("s")).where("s <> 1").count() == 0


def test_missing_member_and_consensus(spark):
    rows = [(1, 8.5, .9, .8, None, .6, .4, None), (2, 8.5, .9, .3, None, .6, .4, None), (3, 8.5, .1, .2, .3, .5, .3, .2)]
    scores = spark.createDataFrame(rows, "match_id INT, line DOUBLE, p1 DOUBLE, p2 DOUBLE, p3 DOUBLE, w1 DOUBLE, w2 DOUBLE, w3 DOUBLE")
    got = {r["match_id"]: r for r in S.weighted_decision(scores).collect()}
    assert got[1]["over_probability"] == pytest.approx(.86) and got[1]["special_info"] == "CONSENSUS"
    assert got[2]["special_info"] == "Split(1/3)" and got[2]["consensus"] == 0
    assert got[3]["consensus"] == 1 and got[3]["recommended"] == "Under"


def test_search_draws_stay_apart(spark, sf, trained):
    table, *_ = trained
    feats = feats_v3()
    for mode, target in (("classification", EASY), ("regression", "total_corners")):
        out = T.param_search(table, feats, feats[:4], target, mode, n_trials=3, n_splits=2, tree_share=0.01, max_depth=3).collect()
        assert len({r["drawn_trees"] for r in out}) == len({r["trees"] for r in out}) == 3 and sum(r["best"] for r in out) == 1
        assert max(out, key=lambda r: (r["mean_score"], -r["trial"]))["best"] == 1
        assert all(r["trees"] == max(1, round(r["drawn_trees"] * 0.01)) for r in out)


def test_parts_hold_counts_and_shares_of_one_scan(spark):
    def table(rows):
        return spark.createDataFrame(rows, "match_id LONG, role STRING, test_fold INT, over_7_5_corners INT")

    rows = [(i, "train", i % 4 - 1, None if i == 5 else int(i % 3 == 0)) for i in range(40)] + [(99, "test", None, 1)]
    folds, train = T.parts(table(rows), [EASY, EASY], SPLITS)
    for k, (before, tested) in enumerate(folds):
        for part, own in ((before, [r for r in rows if r[1] == "train" and r[2] < k]), (tested, [r for r in rows if r[2] == k])):
            known = [r[3] for r in own if r[3] is not None]
            assert part.n == len(own) == part.rows.count() and part.share[EASY] == sum(known) / len(known)
    assert train.n == 40 and train.share[EASY] == 14 / 39
    # the same weights as those of a scan of the rows
    want = M.class_weighted(train.rows, EASY).select("match_id", "__w").collect()
    assert sorted(M.weighted(train.rows, EASY, train.share[EASY]).select("match_id", "__w").collect()) == sorted(want)
    for none in ([], [(1, "train", 0, None)], [(1, "train", 0, 0)]):
        _, part = T.parts(table(none), [EASY], SPLITS)
        assert part.n == len(none) and [r["__w"] for r in M.weighted(part.rows, EASY, part.share[EASY]).collect()] == [1.0] * len(none)


def test_fits_start_no_job_for_weights(spark, tmp_path):
    """A fit's rows carry their weights without a scan or a join, and keep their partitions; predictions of few rows take few tasks."""
    rows = spark.range(400).selectExpr("id AS match_id", "'train' AS role", "CAST(id % 4 AS INT) - 1 AS test_fold",
                                       "CAST(id % 3 = 0 AS INT) AS over_7_5_corners", "array(CAST(id % 7 AS DOUBLE), CAST(id % 5 AS DOUBLE)) AS x")
    table = P.stage(rows.repartition(8).select("*", array_to_vector("x").alias("features")).drop("x"))
    folds, train = T.parts(table, [EASY], SPLITS)
    assert train.few_tasks.rdd.getNumPartitions() == 1 and train.rows.rdd.getNumPartitions() == table.rdd.getNumPartitions()
    plan = M.weighted(folds[0][0].rows, EASY, folds[0][0].share[EASY])._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_queries_fit_the_models_of_their_targets_alone(spark, tmp_path, monkeypatch):
    """train_total needs no other target's model and no folds, importances no weights; what one query has fitted the next one reads."""
    targets, d, feats = ["total_corners", EASY, HARD], str(tmp_path), feats_v3()
    rows = spark.range(240).selectExpr(
        "id AS match_id", "CASE WHEN id < 200 THEN 'train' ELSE 'test' END AS role", "CAST(id % 6 AS INT) - 1 AS test_fold",
        "CAST(id % 13 AS DOUBLE) AS total_corners", f"CAST(id % 3 = 0 AS INT) AS {EASY}", f"CAST(id % 5 < 2 AS INT) AS {HARD}",
        f"transform(sequence(1, {len(feats)}), k -> CAST(id * k % 17 AS DOUBLE)) AS x")
    table = P.stage(rows.select("*", array_to_vector("x").alias("features")).drop("x"))
    scores = spark.createDataFrame([(t, f, 1.0 / (k + 1)) for t in targets for k, f in enumerate(feats[:4])], "target STRING, feature STRING, mi DOUBLE")
    small, fit, fitted = QT.specs, T.fit, []
    for name, value in (("vectors", lambda s, _: table), ("mutual_information_v3", lambda s, _: scores), ("TARGETS_V3", targets),
                        ("HARD", [HARD]), ("LINE_OF", {EASY: 7.5, HARD: 10.5}), ("specs", lambda own, ts: small(own, ts, 2, 2))):
        monkeypatch.setattr(QT, name, value)
    monkeypatch.setattr(T, "fit", lambda spec, *a: fitted.append((spec.target, spec.model)) or fit(spec, *a))

    def took(query):
        fitted.clear()
        return query(), sorted(fitted)

    members = [(HARD, "xgb_conservative"), (HARD, "xgb_optimized")]
    got, by = took(lambda: QT.train_total_query(spark, d))
    assert by == [("total_corners", "xgb")] and got.count() == 40
    direct = fit(small({"total_corners": feats[:4]}, ["total_corners"], 2, 2)[0], table.where("role = 'train'"), feats)
    want = direct.transform(T.sliced(table.where("role = 'test'"), feats, feats[:4])).select("match_id", F.col("prediction").alias("q"))
    assert got.join(want, "match_id").where(F.abs(F.col("prediction") - F.col("q")) < 1e-9).count() == 40
    got, by = took(lambda: QT.fitted_models(spark, d, [HARD]))
    assert by == members and T.importances(got).count() == 8
    got, by = took(lambda: QT.line_scores(spark, d))
    assert by == sorted([(EASY, "xgb"), *members * QT.N_SPLITS])
    assert got.where("line = 10.5 AND abs(w1 + w2 - 1) < 1e-9").count() == got.where("line = 7.5 AND w1 = 1").count() == 40
    got, by = took(lambda: QT.out_of_fold(spark, d))  # all targets: those of the hard line are there
    assert by == sorted([(EASY, "xgb"), ("total_corners", "xgb")] * QT.N_SPLITS)
    assert got.groupBy("target", "model").count().count() == 4 and got.count() == 4 * table.where("role = 'train' AND test_fold >= 0").count() \
        + 4 * table.where("role = 'test' AND test_fold >= 0").count()
    assert QT.out_of_fold(spark, d, []).count() == 0


def _small_set(spark, monkeypatch, feats, n_rows=240):
    """A vector table of a few rows, and scores that select the first four features, in place of those of the queries."""
    targets = ["total_corners", EASY, HARD]
    rows = spark.range(n_rows).selectExpr(
        "id AS match_id", "CASE WHEN id % 6 < 5 THEN 'train' ELSE 'test' END AS role", "CAST(id % 7 AS INT) - 1 AS test_fold",
        "CAST(id % 13 AS DOUBLE) AS total_corners", f"CAST(id % 3 = 0 AS INT) AS {EASY}", f"CAST(id % 5 < 2 AS INT) AS {HARD}",
        f"transform(sequence(1, {len(feats)}), k -> CAST(id * k % 17 AS DOUBLE)) AS x")
    table = P.stage(rows.select("*", array_to_vector("x").alias("features")).drop("x"))
    scores = spark.createDataFrame([(t, f, 1.0 / (k + 1)) for t in targets for k, f in enumerate(feats[:4])], "target STRING, feature STRING, mi DOUBLE")
    for name, value in (("vectors", lambda s, _: table), ("mutual_information_v3", lambda s, _: scores), ("TARGETS_V3", targets),
                        ("HARD", [HARD]), ("STANDARD", [EASY]), ("LINE_OF", {EASY: 7.5, HARD: 10.5}), ("N_SPLITS", 2)):
        monkeypatch.setattr(QT, name, value)
    return table


def test_queries_fit_at_the_presets_sizes(spark, tmp_path, monkeypatch):
    """Every fit that a registered query asks for has the trees and the depth of its preset, and the results say so."""
    _small_set(spark, monkeypatch, feats_v3())
    fit, asked = T.fit, {}

    def small(spec, *a):
        asked[spec.target, spec.model] = (spec.sizes["trees"], spec.sizes["max_depth"])
        held = {**spec.sizes, "trees": 2, "max_depth": 2}
        return fit(T.Spec(spec.target, spec.model, spec.features, tuple(sorted(held.items())), spec.regression), *a)

    monkeypatch.setattr(T, "fit", small)
    d, want = str(tmp_path), {("total_corners", "xgb"): (2000, 12), (EASY, "xgb"): (700, 8), (HARD, "xgb_optimized"): (1700, 12),
                              (HARD, "xgb_conservative"): (1000, 12)}
    QT.out_of_fold(spark, d)
    assert asked == want
    asked.clear()
    sizes = [{(r["trees"], r["max_depth"]) for r in q(spark, d).collect()} for q in (
        QT.train_total_query, QT.train_lines_query, QT.train_ensemble_query)]
    assert asked == want and sizes == [{(2000, 12)}, {(700, 8)}, {(1700, 12)}]


def test_searches_run_every_trial_at_its_drawn_size(spark, tmp_path, monkeypatch):
    """The registered searches fit the reference's number of trials, each with the drawn trees and depth on every fold."""
    _small_set(spark, monkeypatch, feats_v3(), 60)
    asked = []

    class Zero:
        transform = staticmethod(lambda rows: rows.withColumn("prediction", F.lit(0.0)))
        close = staticmethod(lambda: None)

    monkeypatch.setattr(T, "fit", lambda spec, *a: asked.append((spec.model, spec.sizes["trees"], spec.sizes["max_depth"])) or Zero)
    for mode, target, trials in (("classification", HARD, 30), ("regression", "total_corners", 50)):
        asked.clear()
        out = QT.search(mode, target)(spark, str(tmp_path)).collect()
        drawn = [(f"trial_{t}", p["maxIter"], p["maxDepth"]) for t, p in enumerate(M.draw_params(mode, t) for t in range(trials))]
        assert sorted(asked) == sorted(drawn * 2)  # two folds
        assert [(r["trees"], r["max_depth"]) for r in sorted(out, key=lambda r: r["trial"])] == [(n, k) for _, n, k in drawn]
        assert all((r["drawn_trees"], r["drawn_depth"]) == (r["trees"], r["max_depth"]) for r in out) and sum(r["best"] for r in out) == 1
