"""Registered queries of model training and of scoring with trained models (K3, M11-M16, M20, P2-P8 on fitted models).

One vector table of the chatbot's matrix is written per input. Out-of-fold predictions and saved models are written per target: a
query fits those of the targets that its rows depend on, and reads what earlier queries have fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import model as M
from touchline.operators import score as S
from touchline.operators import select as SE
from touchline.operators import training as T
from touchline.operators.features import CORNER_LINES, line_name
from touchline.plans import pipeline as P
from touchline.plans import sqlbase as SB
from touchline.plans.queries_model import (HARD, K_BY_TARGET, LINES, STANDARD, TARGETS_V3, V1_TARGETS, feats_v1, feats_v3,
                                           matrix_v1, matrix_v1_ctes, matrix_v3_ctes, mutual_information_v3, q, sql)
from touchline.plans.registry import NOT_ROUNDED, register

N_SPLITS = 5

# Changes of the hard lines' members to the preset, for the parameters that MLlib has.
MEMBERS = {"xgb_optimized": {}, "xgb_conservative": {"step": 0.04, "trees": 1000},
           "recent_focus": {"step": 0.06, "max_depth": 10}}
LINE_OF = {line_name(L): float(L) for L in CORNER_LINES}


def _size(target: str, change: dict, trees: int | None = None, depth: int | None = None) -> tuple[tuple[str, float], ...]:
    """The preset with a member's changes, held to `trees` and `depth` where given (no registered query does so)."""
    p = {**M.preset(target), **change}
    p["trees"] = min(p["trees"], trees or p["trees"])
    p["max_depth"] = min(p["max_depth"], depth or p["max_depth"])
    return tuple(sorted(p.items()))


def specs(selected: dict[str, list[str]], targets: list[str], trees: int | None = None, depth: int | None = None) -> list[T.Spec]:
    """The chatbot's model set: the total, a single classifier for each standard line, and for each hard line the tuned
    and the conservative member, and one on the recent features if over ten of the selected are recent."""
    out = []
    for t in targets:
        feats = selected[t]
        if t not in HARD:
            out.append(T.Spec(t, "xgb", tuple(feats), _size(t, {}, trees, depth), t == "total_corners"))
            continue
        recent = [f for f in feats if any(k in f.lower() for k in SE.RECENT_KEYS)]
        for name, change in MEMBERS.items():
            if name != "recent_focus" or len(recent) > 10:
                out.append(T.Spec(t, name, tuple(recent if name == "recent_focus" else feats), _size(t, change, trees, depth)))
    return out


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return P.shared_stage(spark, ("vectors_v3", sf), lambda: T.vector_table(
        P.feature_matrix_v3(spark, sf), M.chrono_holdout(P.split_keys_v3(spark, sf)), feats_v3(), TARGETS_V3, N_SPLITS))


def model_specs(spark: SparkSession, sf: str, targets: list[str] | None = None) -> list[T.Spec]:
    """The models of `targets` (all by default). The selected names (at most 40 a target) come to the driver; targets of one class are
    skipped (A8)."""
    top = SE.top_k_features(mutual_information_v3(spark, sf), K_BY_TARGET).orderBy("target", "rank").collect()
    selected: dict[str, list[str]] = {}
    for r in top:
        selected.setdefault(r["target"], []).append(r["feature"])
    both = vectors(spark, sf).where("role = 'train'").agg(*[(F.min(t) < F.max(t)).alias(t) for t in TARGETS_V3]).first()
    wanted = TARGETS_V3 if targets is None else targets
    return specs(selected, [t for t in TARGETS_V3 if t in wanted and t in selected and both[t]])


def _by_target(spark: SparkSession, sf: str, name: str, targets: list[str] | None, build) -> tuple[list[str], list[str]]:
    """(folders, targets) of what `build(folder, specs)` writes for the models of `targets`: a query's models are fitted alone, in one pool,
    but for those that an earlier query of the application has left."""
    own = model_specs(spark, sf, targets)
    present = list(dict.fromkeys(s.target for s in own))
    return P.shared_roots(spark, (name, sf), present, lambda path, missing: build(
        path, [s for s in own if s.target in missing])), present


def out_of_fold(spark: SparkSession, sf: str, targets: list[str] | None = None) -> DataFrame:
    roots, present = _by_target(spark, sf, "oof_v3", targets, lambda path, own: T.out_of_fold(
        vectors(spark, sf), own, feats_v3(), path, N_SPLITS))
    return T.load_out_of_fold(spark, roots).where(F.col("target").isin(present))


def fitted_models(spark: SparkSession, sf: str, targets: list[str] | None = None) -> DataFrame:
    """The manifest of the models of `targets` fitted on the training rows, each of weight 1."""
    roots, present = _by_target(spark, sf, "models_v3", targets, lambda path, own: T.save_models(
        vectors(spark, sf), own, feats_v3(), {}, path))
    return T.load_manifest(spark, *roots).where(F.col("target").isin(present))


def saved_models(spark: SparkSession, sf: str, targets: list[str] | None = None) -> DataFrame:
    """`fitted_models` with the ensembles' weights from the five folds, for the hard lines among `targets`; written."""
    hard = [t for t in HARD if targets is None or t in targets]
    return P.shared_stage(spark, ("manifest_v3", sf, *(targets or [])), lambda: T.weighted_manifest(
        fitted_models(spark, sf, targets), T.ensemble_weights(out_of_fold(spark, sf, hard))))


def holdout_scores(spark: SparkSession, sf: str, targets: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str, float, str]]]:
    rows = vectors(spark, sf).where("role = 'test'")
    scored, added = T.score(saved_models(spark, sf, targets), rows, ["match_id", *TARGETS_V3])
    return P.shared_stage(spark, ("scored_v3", sf, *(targets or [])), lambda: scored), added


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(match_id, line, p1..p3, w1..w3) of the holdout rows, by the saved models."""
    scored, added = holdout_scores(spark, sf, list(LINE_OF))
    return T.member_scores(scored, added, LINE_OF)


def _total(spark, sf, keep=("match_id", "total_corners")) -> DataFrame:
    scored, added = holdout_scores(spark, sf, ["total_corners"])
    (column,) = [c for t, *_, c in added if t == "total_corners"]
    return scored.select(*keep, F.col(column).alias("prediction"))


def train_total_query(spark, sf):
    p = dict(_size("total_corners", {}))
    mean = vectors(spark, sf).where("role = 'train'").agg(F.avg("total_corners").alias("train_mean"))
    return _total(spark, sf).crossJoin(F.broadcast(mean)).select(
        "match_id", "total_corners", "prediction", "train_mean", F.lit(p["trees"]).alias("trees"), F.lit(p["max_depth"]).alias("max_depth"))


def _line_rows(spark, sf, targets):
    """(match_id, target, p, y, trees, max_depth) of the holdout rows: a single model's probability, or the members' weighted one;
    the size is that of the target's preset, which the members change (`MEMBERS`)."""
    scored, added = holdout_scores(spark, sf, targets)
    rows = []
    for t in targets:
        own = [(w, c) for target, _, w, c in added if target == t]
        if own:
            p = sum((F.col(c) * w for w, c in own), F.lit(0.0)) if len(own) > 1 else F.col(own[0][1])
            size = dict(_size(t, {}))
            rows.append(F.struct(F.lit(t).alias("target"), p.alias("p"), F.col(t).alias("y"),
                                 F.lit(size["trees"]).alias("trees"), F.lit(size["max_depth"]).alias("max_depth")))
    return scored.select("match_id", F.inline(F.array(*rows)))


def train_lines_query(spark, sf):
    return _line_rows(spark, sf, STANDARD)


def train_ensemble_query(spark, sf):
    return _line_rows(spark, sf, HARD)


def _importance_fixture(spark, sf):
    """Member importances that a query can compute: squared correlations of v1's features with its three flags."""
    m, out = matrix_v1(spark, sf), None
    for t in V1_TARGETS:
        part = SE.f_regression_scores(m, feats_v1(), t).select(
            F.lit(t).alias("model"), "feature", F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)).alias("importance"))
        out = part if out is None else out.unionByName(part)
    return out


def search(mode: str, target: str):
    """The reference's number of trials, seeded draws from the whole ranges, each fitted at its drawn size; both the drawn
    and the fitted sizes are in the result."""
    def run(spark, sf):
        def build():
            top = SE.top_k_features(mutual_information_v3(spark, sf), K_BY_TARGET).where(F.col("target") == target)
            feats = [r["feature"] for r in top.orderBy("rank").collect()]
            return T.param_search(vectors(spark, sf), feats_v3(), feats, target, mode, n_splits=N_SPLITS)

        return P.shared_stage(spark, ("param_search", mode, sf), build)

    return run


def _register_training():
    register("train_total", q(train_total_query), None)
    register("train_lines", q(train_lines_query), None)
    register("train_ensemble", q(train_ensemble_query), None)
    register("oof_predictions", q(out_of_fold), None)
    register("oof_cv_scores", q(lambda s, d: T.cv_summary(out_of_fold(s, d))), None)
    register("ensemble_weights", q(lambda s, d: T.ensemble_weights(out_of_fold(s, d, HARD))), None)
    register("model_total_interval", q(lambda s, d: S.total_interval(_total(s, d))), None)
    register("model_line_decisions", q(lambda s, d: S.bet_tiers(S.fitted_lines(line_scores(s, d)))), None)
    register("model_bet_summary", q(lambda s, d: S.bet_summary(S.fitted_lines(line_scores(s, d)))), None)

    test_rows = f"""{matrix_v3_ctes()},
pp AS (SELECT match_id, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position, count(*) OVER () AS n FROM m3),
te AS (SELECT m3.* FROM m3 JOIN pp USING (match_id) WHERE NOT position < floor(CAST(n AS DOUBLE) * 0.85::DOUBLE))"""

    def total_summary(s, d):
        err, base = F.col("prediction") - F.col("total_corners"), F.col("train_mean") - F.col("total_corners")
        return train_total_query(s, d).agg(
            F.count(F.lit(1)).alias("n_test"), F.sum("total_corners").alias("sum_label"),
            F.min((~F.isnan("prediction") & F.col("prediction").isNotNull()).cast("int")).alias("all_finite"),
            # a small fit on noise may lose a little to the mean
            (F.avg(err * err) <= 1.15 * F.avg(base * base)).cast("int").alias("near_mean_error"))

    register("train_total_summary", total_summary, sql(test_rows, """
SELECT count(*) AS n_test, sum(total_corners) AS sum_label, CAST(1 AS INTEGER) AS all_finite,
  CAST(1 AS INTEGER) AS near_mean_error FROM te"""))

    def probability_summary(query):
        return lambda s, d: query(s, d).groupBy("target").agg(
            F.count(F.lit(1)).alias("n_test"), F.sum(F.col("y").cast("long")).alias("n_over"),
            F.min(F.col("p").between(0, 1).cast("int")).alias("all_valid"))

    for key, query, targets in (("train_lines_summary", train_lines_query, STANDARD),
                                ("train_ensemble_summary", train_ensemble_query, HARD)):
        register(key, probability_summary(query), sql(test_rows, " UNION ALL ".join(
            f"SELECT '{t}' AS target, count(*) AS n_test, CAST(sum({t}) AS BIGINT) AS n_over, "
            f"CAST(1 AS INTEGER) AS all_valid FROM te" for t in targets)))

    # the rows and labels that each fold's predictions cover
    trained = f"""{matrix_v3_ctes()},
pp AS (SELECT match_id, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position, count(*) OVER () AS n FROM m3),
tr AS (SELECT match_id, position, count(*) OVER () AS n FROM pp WHERE position < floor(CAST(n AS DOUBLE) * 0.85::DOUBLE)),
fo AS (SELECT tr.match_id, CAST(f.fold AS INTEGER) AS fold FROM tr, range(5) AS f(fold)
  WHERE position >= n - (5 - f.fold) * (n // 6) AND position < n - (5 - f.fold) * (n // 6) + n // 6)"""

    def covered(s, d):
        one = out_of_fold(s, d).where(F.col("model").isin("xgb", "xgb_optimized"))
        return one.groupBy("target", "fold").agg(
            F.count(F.lit(1)).alias("n_test"), F.sum("y").cast("long").alias("n_over"),
            F.countDistinct("match_id").alias("n_matches"),
            F.min((F.col("p").between(0, 1) | (F.col("target") == "total_corners")).cast("int")).alias("all_valid"))

    register("oof_summary", covered, sql(trained, " UNION ALL ".join(
        f"SELECT '{t}' AS target, fold, count(*) AS n_test, CAST(sum({t}) AS BIGINT) AS n_over, "
        f"count(DISTINCT match_id) AS n_matches, CAST(1 AS INTEGER) AS all_valid "
        f"FROM fo JOIN m3 USING (match_id) GROUP BY fold" for t in TARGETS_V3)))
    # each match has all nine lines, six of them hard, whatever the models say
    register("model_bet_lines", lambda s, d: S.bet_summary(S.fitted_lines(line_scores(s, d))).drop("high_confidence_bets"),
             sql(test_rows, "SELECT match_id, CAST(9 AS BIGINT) AS lines_analysed, CAST(6 AS BIGINT) AS hard_lines FROM te"))
    NOT_ROUNDED.update({"n_test", "n_over", "all_valid", "all_finite", "near_mean_error", "n_matches", "model", "fold"})

    def ens_importance(s, d):
        imps, out = T.importances(fitted_models(s, d, HARD)), None
        for t in HARD:
            part = M.ensemble_importance(imps.where(F.col("target") == t)).select(F.lit(t).alias("target"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    register("ensemble_importance", q(ens_importance), None)
    for n in (15, 20, 40):
        register("top_n_importance" + ("" if n == 15 else f"_{n}"), q(lambda s, d, n=n: M.top_n_importance(
            T.importances(fitted_models(s, d)).select(F.concat_ws(":", "target", "model").alias("model"), "feature", "importance"), n)), None)

    fixture = matrix_v1_ctes() + ",\nimps AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS model, '{f}' AS feature, CASE WHEN var_pop({f}) > 0 AND var_pop({t}) > 0 "
        f"THEN corr({f}, {t}) * corr({f}, {t}) ELSE 0.0 END AS importance FROM mx1"
        for t in V1_TARGETS for f in feats_v1()) + ")"
    for n in (15, 20, 40):
        register(f"importance_top_{n}", q(lambda s, d, n=n: M.top_n_importance(_importance_fixture(s, d), n)
                                          .select("model", "rank", "importance")), sql(fixture, f"""
SELECT model, rank, {SB.round6('importance')} AS importance FROM (SELECT *, row_number() OVER (
  PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM imps) WHERE rank <= {n}"""))
    register("importance_ensemble", q(lambda s, d: M.ensemble_importance(_importance_fixture(s, d))), sql(fixture, f"""
SELECT feature, {SB.round6('sum(importance) / (SELECT sum(importance) FROM imps)')} AS importance
FROM imps GROUP BY feature"""))

    classes, regress = search("classification", line_name(10.5)), search("regression", "total_corners")
    register("param_search", q(classes), None)
    register("param_search_regression", q(regress), None)
    register("param_search_summary", lambda s, d: classes(s, d).agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("best").alias("n_best"),
        F.min(F.col("mean_score").between(0, 1).cast("int")).alias("all_valid")),
             sql(test_rows, "SELECT CAST(30 AS BIGINT) AS n_trials, CAST(1 AS BIGINT) AS n_best, "
                            "CAST(1 AS INTEGER) AS all_valid FROM te HAVING count(*) > 0"))
    NOT_ROUNDED.update({"n_trials", "n_best", "trees", "best", "drawn_trees", "drawn_depth"})


_register_training()
