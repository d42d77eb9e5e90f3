"""Registered queries for reports (A), sorts (K), text (T) and scoring (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import clean as C
from touchline.operators import report as R
from touchline.operators import score as S
from touchline.operators import text as T
from touchline.operators.features import CORNER_LINES, line_name
from touchline.plans import pipeline as P
from touchline.plans import sqlbase as SB
from touchline.plans import sqlhistory as SH
from touchline.plans import sqlmore as SM
from touchline.plans.registry import NOT_ROUNDED, register, sql_select
from touchline.sources.rules import adjustment_rules
from touchline.sources.testdata import messages, round_doubles

NOT_ROUNDED.update({
    "n_matches", "first_date", "last_date", "n_teams", "range_label", "low", "high", "n", "target",
    "n_classes", "trainable", "home_team_group", "away_team_group", "n_features", "n_rows", "home_more",
    "away_more", "equal", "conv_id", "turn", "predict_turn", "until_turn", "n_predicts", "command", "rule_id", "type", "description",
    "text", "n_active", "n_up", "n_down", "descriptions", "impact_label", "adjusted_prediction_label",
    "recommended", "prediction", "special_info", "consensus", "is_hard_line", "tier", "rank",
    "lines_analysed", "hard_lines", "high_confidence_bets", "change_label", "recommendation",
    "adjusted_prediction_side", "date_raw", "stage", "step", "removed", "initial", "column_name",
    "inf_count", "has_inf", "fold", "role", "position", "feature", "k",
})

F3 = SB.features_v3_ctes()
FTV = SB.features_tv_ctes()
H3 = f"{F3},\n{SH.v3_history_ctes('f3')}"


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def q(fn):
    """Wrap a plan so its doubles are rounded like the oracle's."""
    return lambda spark, sf: round_doubles(fn(spark, sf))


# -- A: report --------------------------------------------------------------

def _register_reports():
    register("dataset_info", q(lambda s, d: R.dataset_info(P.features_v3(s, d))), sql(F3, """
SELECT count(*) AS n_matches, strftime(min(date_gmt), '%Y-%m-%d') AS first_date,
  strftime(max(date_gmt), '%Y-%m-%d') AS last_date,
  (SELECT count(DISTINCT t) FROM (SELECT home_team_name AS t FROM f3 UNION ALL SELECT away_team_name FROM f3))
    AS n_teams
FROM f3"""))
    register("corner_stats", q(lambda s, d: R.corner_stats(P.features_v3(s, d))), sql(F3, f"""
SELECT {sql_select(['mean', 'median', 'mode', 'std', 'min', 'max'], {
        'mean': 'avg(total_corners)', 'median': 'median(total_corners)',
        'mode': '(SELECT total_corners FROM f3 GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1)',
        'std': 'stddev_samp(total_corners)', 'min': 'min(total_corners)', 'max': 'max(total_corners)'})}
FROM f3"""))
    rng = " UNION ALL ".join(f"SELECT '{lab}' AS range_label, {lo} AS low, {hi} AS high"
                             for lo, hi, lab in R.CORNER_RANGES)
    register("corner_ranges", q(lambda s, d: R.corner_ranges(P.features_v3(s, d))), sql(F3 + f",\nrg AS ({rng})", f"""
SELECT range_label, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high,
  CAST((SELECT count(*) FROM f3 WHERE total_corners >= low AND total_corners <= high) AS BIGINT) AS n,
  {SB.round6('(SELECT count(*) FROM f3 WHERE total_corners >= low AND total_corners <= high) * 100.0 / (SELECT count(*) FROM f3)')} AS pct
FROM rg"""))
    register("corner_histogram", q(lambda s, d: R.corner_histogram(P.features_tv(s, d))), sql(FTV, f"""
SELECT {SB.round6('total_corners')} AS value, count(*) AS n,
  {SB.round6('count(*) * 100.0 / (SELECT count(*) FROM ftv2)')} AS pct FROM ftv2 GROUP BY total_corners"""))
    register("over_under_rates",
             q(lambda s, d: R.over_under_rates(P.features_v3(s, d), CORNER_LINES)),
             sql(F3 + f",\nlv AS (SELECT * FROM {SM.lines_values()})", f"""
SELECT lv.line, {SB.round6('avg(CASE WHEN f3.total_corners > lv.line THEN 1.0 ELSE 0.0 END) * 100')} AS over_pct,
  {SB.round6('100 - avg(CASE WHEN f3.total_corners > lv.line THEN 1.0 ELSE 0.0 END) * 100')} AS under_pct
FROM f3, lv GROUP BY lv.line"""))
    f1 = SB.features_v1_ctes()
    register("over_under_rates_v1",
             q(lambda s, d: R.over_under_rates(P.features_v1(s, d), R.V1_REPORT_LINES)),
             sql(f1 + f",\nlv AS (SELECT * FROM {SM.lines_values(R.V1_REPORT_LINES)})", f"""
SELECT lv.line, {SB.round6('avg(CASE WHEN fv1.total_corners > lv.line THEN 1.0 ELSE 0.0 END) * 100')} AS over_pct,
  {SB.round6('100 - avg(CASE WHEN fv1.total_corners > lv.line THEN 1.0 ELSE 0.0 END) * 100')} AS under_pct
FROM fv1, lv GROUP BY lv.line"""))
    register("home_away_corners", q(lambda s, d: R.home_away_corners(P.features_v3(s, d))), sql(F3, f"""
SELECT {sql_select(['home_avg', 'away_avg', 'home_advantage', 'home_more', 'away_more', 'equal',
                    'home_more_pct', 'away_more_pct', 'equal_pct'], {
        'home_avg': 'avg(home_team_corner_count)', 'away_avg': 'avg(away_team_corner_count)',
        'home_advantage': 'avg(home_team_corner_count) - avg(away_team_corner_count)',
        'home_more': 'CAST(sum(CASE WHEN home_team_corner_count > away_team_corner_count THEN 1 ELSE 0 END) AS BIGINT)',
        'away_more': 'CAST(sum(CASE WHEN away_team_corner_count > home_team_corner_count THEN 1 ELSE 0 END) AS BIGINT)',
        'equal': 'CAST(sum(CASE WHEN home_team_corner_count = away_team_corner_count THEN 1 ELSE 0 END) AS BIGINT)',
        'home_more_pct': 'sum(CASE WHEN home_team_corner_count > away_team_corner_count THEN 1 ELSE 0 END) * 100.0 / count(*)',
        'away_more_pct': 'sum(CASE WHEN away_team_corner_count > home_team_corner_count THEN 1 ELSE 0 END) * 100.0 / count(*)',
        'equal_pct': 'sum(CASE WHEN home_team_corner_count = away_team_corner_count THEN 1 ELSE 0 END) * 100.0 / count(*)'})}
FROM f3"""))
    targets = [line_name(L) for L in CORNER_LINES]
    tbody = " UNION ALL ".join(
        f"SELECT '{t}' AS target, avg(CAST({t} AS DOUBLE)) AS p, count(DISTINCT {t}) AS k FROM warm" for t in targets)
    register("class_balance",
             q(lambda s, d: R.class_balance(C.skip_warmup(P.features_v3(s, d), 30), targets)),
             sql(F3 + ",\nwarm AS (SELECT * FROM f3 QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30)",
                 f"""SELECT target, {SB.round6('p')} AS positive_rate,
  {SB.round6('CASE WHEN p > 0 THEN (1 - p) / p ELSE 1.0 END')} AS scale_pos_weight,
  CAST(k AS BIGINT) AS n_classes, CAST(k >= 2 AS INTEGER) AS trainable FROM ({tbody})"""))
    register("class_diversity",
             q(lambda s, d: R.class_balance(C.skip_warmup(P.features_v3(s, d), 30), targets)
               .where(F.col("trainable") == 0).select("target", "n_classes")),
             sql(F3 + ",\nwarm AS (SELECT * FROM f3 QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30)",
                 f"SELECT target, CAST(k AS BIGINT) AS n_classes FROM ({tbody}) WHERE k < 2"))
    # lines that few or no matches reach: some of them have one class
    rare = {f"over_{str(L).replace('.', '_')}_corners": L for L in (17.5, 19.5, 20.5, 24.5)}
    rbody = " UNION ALL ".join(f"SELECT '{t}' AS target, count(DISTINCT total_corners > {L}) AS k FROM warm" for t, L in rare.items())
    register("class_diversity_rare",
             lambda s, d: R.class_balance(C.skip_warmup(P.features_v3(s, d), 30).withColumns(
                 {t: (F.col("total_corners") > L).cast("int") for t, L in rare.items()}), list(rare))
             .where(F.col("trainable") == 0).select("target", "n_classes"),
             sql(F3 + ",\nwarm AS (SELECT * FROM f3 QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30)",
                 f"SELECT target, CAST(k AS BIGINT) AS n_classes FROM ({rbody}) WHERE k < 2"))
    register("frequent_teams",
             q(lambda s, d: R.frequent_teams(P.features_tv(s, d)).select("match_id", "home_team_group",
                                                                          "away_team_group")),
             sql(FTV + """,
keep AS (SELECT home_team_name AS t FROM ftv2 GROUP BY 1 HAVING count(*) >= 10
         ORDER BY count(*) DESC, 1 ASC LIMIT 50)""", """
SELECT match_id, CASE WHEN home_team_name IN (SELECT t FROM keep) THEN home_team_name ELSE 'Other' END
    AS home_team_group,
  CASE WHEN away_team_name IN (SELECT t FROM keep) THEN away_team_name ELSE 'Other' END AS away_team_group
FROM ftv2"""))

    def summary(s, d):
        feats = P.available(P.history_v3(s, d, wanted=P.FEATURE_CANDIDATES_V3), P.FEATURE_CANDIDATES_V3)
        return R.feature_summary(P.history_rows(s, d, P.history_v3, [], 30), feats)

    register("feature_summary", summary, sql(H3, f"""
SELECT CAST({len(P.FEATURE_CANDIDATES_V3)} AS INTEGER) AS n_features, count(*) AS n_rows,
  strftime(min(date_gmt), '%Y-%m-%d') AS first_date, strftime(max(date_gmt), '%Y-%m-%d') AS last_date
FROM (SELECT * FROM h3 QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30)"""))
    register("skip_warmup",
             lambda s, d: P.history_rows(s, d, P.history_v3, [], 30).select("match_id"),
             sql(H3, "SELECT match_id FROM h3 QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30"))


# -- T: text ---------------------------------------------------------------------

def _msgs(s, d):
    return messages(s, d)


def _mult(s, d):
    return T.total_multiplier(messages(s, d), adjustment_rules(s))


def _asked(s, d):
    """The match that each predicting conversation asks about: its features, or the form's defaults where the
    match is not in the cleaned table."""
    asked = messages(s, d).where(T.command_of() == "predict").select(F.col("conv_id").alias("match_id")).distinct()
    known = P.history_v3(s, d, wanted=["expected_total_corners"]).select("match_id", "expected_total_corners")
    return asked.join(known, "match_id", "left").select(
        "match_id", F.coalesce("expected_total_corners", F.lit(S.DEFAULT_EXPECTED_TOTAL)).alias("expected_total_corners"))


def _line_probs(s, d):
    dec = S.all_lines(S.line_scores(_asked(s, d)))
    return dec.select(F.col("match_id").alias("conv_id"), "line", "over_probability")


def _register_text():
    tc = f"{SM.text_ctes()}"
    register("tag_messages", lambda s, d: T.tag_messages(_msgs(s, d), adjustment_rules(s)),
             sql(tc, "SELECT conv_id, turn, rule_id, type, ROUND(multiplier, 6) AS multiplier, description FROM tags"))
    register("command_messages", lambda s, d: T.command_messages(_msgs(s, d)),
             sql(tc, "SELECT conv_id, turn, command FROM cmd"))
    register("unmatched_messages", lambda s, d: T.unmatched_messages(_msgs(s, d), adjustment_rules(s)),
             sql(tc, "SELECT conv_id, turn, text FROM cmd WHERE command = 'text' AND NOT EXISTS "
                     "(SELECT 1 FROM tags t WHERE t.conv_id = cmd.conv_id AND t.turn = cmd.turn)"))
    register("active_adjustments",
             q(lambda s, d: T.active_adjustments(_msgs(s, d), adjustment_rules(s))
               .select("conv_id", "turn", "rule_id", "until_turn", "n_predicts")),
             sql(tc, """SELECT t.conv_id, t.turn, t.rule_id,
  (SELECT min(r.turn) FROM seg r WHERE r.conv_id = t.conv_id AND r.turn > t.turn AND r.command = 'reset') AS until_turn,
  (SELECT count(*) FROM active a WHERE a.conv_id = t.conv_id AND a.turn = t.turn AND a.rule_id = t.rule_id)
    AS n_predicts
FROM tags t JOIN seg s ON s.conv_id = t.conv_id AND s.turn = t.turn"""))
    register("adjustments_by_type", lambda s, d: T.adjustments_by_type(_msgs(s, d), adjustment_rules(s)),
             sql(tc + """,
lastseg AS (SELECT conv_id, max(segment) AS segment FROM seg GROUP BY 1),
cur AS (SELECT t.* FROM tags t JOIN seg s ON s.conv_id = t.conv_id AND s.turn = t.turn
        JOIN lastseg l ON l.conv_id = s.conv_id AND l.segment = s.segment),
per_rule AS (SELECT conv_id, type, rule_id, description, multiplier, count(*) AS k, min(turn) AS first_turn
             FROM cur GROUP BY ALL)""", """
SELECT conv_id, type, CAST(sum(k) AS BIGINT) AS n,
  string_agg(description || ' x' || k, '; ' ORDER BY first_turn, rule_id) AS descriptions,
  CAST(sum(CASE WHEN multiplier > 1 THEN k ELSE 0 END) AS BIGINT) AS n_up,
  CAST(sum(CASE WHEN multiplier > 1 THEN 0 ELSE k END) AS BIGINT) AS n_down
FROM per_rule GROUP BY conv_id, type"""))
    register("total_multiplier", q(_mult),
             sql(tc, f"SELECT conv_id, predict_turn, n_active, {SB.round6('total_multiplier')} AS total_multiplier "
                     "FROM mult"))
    register("impact_pct", q(lambda s, d: T.impact_pct(_mult(s, d))),
             sql(tc, f"SELECT conv_id, predict_turn, {SB.round6('(total_multiplier - 1) * 100')} AS impact_pct, "
                     "CASE WHEN abs((total_multiplier - 1) * 100) < 1 THEN 'minimal' "
                     "WHEN (total_multiplier - 1) * 100 > 0 THEN 'more' ELSE 'fewer' END AS impact_label FROM mult"))

    def adj_total(s, d):
        base = _asked(s, d).select(F.col("match_id").alias("conv_id"),
                                   F.col("expected_total_corners").alias("original_prediction"))
        return T.adjust_total(_mult(s, d), base)

    h3t = f"""{H3},
{SM.text_ctes()},
asked AS (SELECT DISTINCT m.conv_id AS match_id, COALESCE(h.expected_total_corners, (5.0 + 4.5 + 4.2 + 4.8) / 2)
            AS expected_total_corners FROM mult m LEFT JOIN h3 h ON h.match_id = m.conv_id)"""
    register("adjust_total", q(adj_total), sql(h3t, f"""
SELECT m.conv_id, m.predict_turn, {SB.round6('h.expected_total_corners')} AS original_prediction,
  {SB.round6('m.total_multiplier')} AS adjustment_factor,
  {SB.round6('round_even((h.expected_total_corners * m.total_multiplier) * 100.0, 0) / 100.0')} AS adjusted_prediction
FROM mult m LEFT JOIN asked h ON h.match_id = m.conv_id"""))

    def adj_lines(s, d):
        return T.adjust_line_probs(_mult(s, d), _line_probs(s, d))

    adj_sql = f"""{h3t},
{SM.line_scores_cte('asked')},
{SM.decisions_cte()},
adj AS (SELECT m.conv_id, m.predict_turn, d.line, d.over_probability AS orig,
  CASE WHEN m.total_multiplier > 1 THEN LEAST(0.95, d.over_probability + LEAST(0.2, (m.total_multiplier - 1) * 0.5))
       ELSE GREATEST(0.05, d.over_probability - LEAST(0.2, (1 - m.total_multiplier) * 0.5)) END AS adj
  FROM mult m JOIN dec d ON d.match_id = m.conv_id)"""
    register("adjust_line_probs", q(adj_lines), sql(adj_sql, f"""
SELECT conv_id, predict_turn, line, {SB.round6('orig')} AS original_over_probability,
  {SB.round6('adj')} AS adjusted_over_probability, {SB.round6('1 - adj')} AS adjusted_under_probability,
  CASE WHEN adj > 0.5 THEN 'Over' ELSE 'Under' END AS adjusted_prediction FROM adj"""))
    register("adjusted_recommendation", q(lambda s, d: T.adjusted_recommendation(adj_lines(s, d))),
             sql(adj_sql, f"""
SELECT conv_id, predict_turn, line, {SB.round6('orig * 100')} AS original_pct, {SB.round6('adj * 100')} AS adjusted_pct,
  {SB.round6('adj * 100 - orig * 100')} AS change,
  CASE WHEN abs(adj * 100 - orig * 100) < 2 THEN '~' ELSE 'changed' END AS change_label,
  CASE WHEN adj * 100 > 65 THEN 'OVER strong' WHEN adj * 100 < 35 THEN 'UNDER strong'
       WHEN adj * 100 > 55 THEN 'Over' WHEN adj * 100 < 45 THEN 'Under' ELSE 'Skip' END AS recommendation
FROM adj"""))


# -- P: scoring --------------------------------------------------------------------

def _register_scoring():
    ls_sql = f"{H3},\n{SM.line_scores_cte('h3')}"
    dec_sql = f"{ls_sql},\n{SM.decisions_cte()}"

    def scores(s, d):
        return S.line_scores(P.history_v3(s, d, wanted=["expected_total_corners"]))

    register("line_scores", q(scores), sql(ls_sql, f"SELECT match_id, line, {SB.round6('p1')} AS p1, "
                                                    f"{SB.round6('p2')} AS p2, {SB.round6('p3')} AS p3 FROM ls"))
    req_feats = ["pre_match_ppg_home", "pre_match_xg_home", "odds_home", "avg_corners_pre", "btts_pct_pre",
                 "home_corners_avg_6", "away_corners_against_avg_6", "expected_total_corners",
                 "corner_advantage_home", "corner_advantage_away", "home_recent_form", "teams_familiarity",
                 "not_a_known_feature"]

    def requests(s, d):
        return S.request_features(P.history_v3(s, d, wanted=[*S.FORM_DEFAULTS, *req_feats]), req_feats)

    fd = S.FORM_DEFAULTS

    def dflt(c):
        return f"COALESCE(CASE WHEN isfinite({c}) THEN {c} END, {fd[c]})"

    hf, af = dflt("home_corners_avg_6"), dflt("away_corners_avg_6")
    ha, aa = dflt("home_corners_against_avg_6"), dflt("away_corners_against_avg_6")
    exprs = {c: dflt(c) for c in req_feats if c in fd}
    exprs.update({"expected_total_corners": f"({hf} + {af} + {ha} + {aa}) / 2",
                  "corner_advantage_home": f"{hf} - {ha}", "corner_advantage_away": f"{af} - {aa}",
                  "teams_familiarity": "COALESCE(teams_familiarity, 0.0)", "not_a_known_feature": "0.0"})
    register("request_features", q(requests),
             sql(H3, f"SELECT match_id, {sql_select(req_feats, exprs)} FROM h3"))

    def interval(s, d):
        return S.total_interval(P.history_v3(s, d, wanted=["expected_total_corners"]).select(
            "match_id", F.col("expected_total_corners").alias("prediction")))

    register("total_interval", q(interval), sql(H3, f"""
SELECT match_id, {SB.round6('round_even((expected_total_corners) * 100.0, 0) / 100.0')} AS prediction,
  {SB.round6('round_even((expected_total_corners) * 1.0, 0) / 1.0')} AS rounded,
  {SB.round6('GREATEST(0.0, expected_total_corners - 2)')} AS lower, {SB.round6('expected_total_corners + 2')} AS upper
FROM h3"""))

    def interval_v1(s, d):
        h = P.history_v1(s, d, wanted=["expected_corners_total"]).select(
            "match_id", F.col("expected_corners_total").alias("prediction"))
        return S.total_interval(h, v1=True)

    hv1 = f"{SB.features_v1_ctes()},\n{SH.v1_history_ctes('fv1')}"
    register("total_interval_v1", q(interval_v1), sql(hv1, f"""
SELECT match_id, {SB.round6('round_even((expected_corners_total) * 10.0, 0) / 10.0')} AS prediction,
  {SB.round6('round_even((expected_corners_total - 1.96 * 1.5) * 10.0, 0) / 10.0')} AS lower,
  {SB.round6('round_even((expected_corners_total + 1.96 * 1.5) * 10.0, 0) / 10.0')} AS upper FROM hv1"""))
    dec_cols = ["match_id", "line", "over_probability", "under_probability", "prediction", "confidence",
                "recommended", "edge"]
    register("line_decision", q(lambda s, d: S.line_decision(scores(s, d))), sql(ls_sql, f"""
SELECT {sql_select(dec_cols, {
        'over_probability': 'p1', 'under_probability': '1 - p1',
        'prediction': "CASE WHEN p1 > 0.5 THEN 'Over' ELSE 'Under' END",
        'confidence': 'GREATEST(p1, 1 - p1)',
        'recommended': "CASE WHEN p1 > 0.6 THEN 'Over' WHEN 1 - p1 > 0.6 THEN 'Under' ELSE 'Skip' END",
        'edge': 'abs(p1 - 0.5) * 2'})} FROM ls"""))
    ens_cols = dec_cols + ["consensus", "special_info"]
    hard = ", ".join(str(float(h)) for h in S.HARD_LINES)
    register("ensemble_decision",
             q(lambda s, d: S.ensemble_decision(scores(s, d).where(F.col("line").isin(*S.HARD_LINES)))),
             sql(dec_sql, f"SELECT {sql_select(ens_cols)} FROM dec WHERE line IN ({hard})"))
    register("ensemble_consensus",
             q(lambda s, d: S.ensemble_decision(scores(s, d).where(F.col("line").isin(*S.HARD_LINES)))
               .select("match_id", "line", "consensus", "special_info")),
             sql(dec_sql, f"SELECT match_id, line, consensus, special_info FROM dec WHERE line IN ({hard})"))
    tier_cols = ["match_id", "line", "recommended", "confidence", "edge", "is_hard_line", "special_info",
                 "probability", "tier"]
    register("bet_tiers_standard",
             q(lambda s, d: S.bet_tiers(S.all_lines(scores(s, d))).where(F.col("is_hard_line") == 0)),
             sql(dec_sql, f"SELECT {sql_select(tier_cols)} FROM tiers WHERE is_hard_line = 0"))
    register("bet_tiers_hard",
             q(lambda s, d: S.bet_tiers(S.all_lines(scores(s, d))).where(F.col("is_hard_line") == 1)),
             sql(dec_sql, f"SELECT {sql_select(tier_cols)} FROM tiers WHERE is_hard_line = 1"))
    # members far apart, so that splits and all tiers occur
    register("bet_tiers_hard_split",
             q(lambda s, d: S.bet_tiers(S.all_lines(S.line_scores(P.history_v3(s, d, wanted=["expected_total_corners"]), spread=0.3)))
               .where(F.col("is_hard_line") == 1)),
             sql(dec_sql.replace("p1 + 0.05", "p1 + 0.3").replace("p1 - 0.05", "p1 - 0.3"), f"SELECT {sql_select(tier_cols)} FROM tiers WHERE is_hard_line = 1"))
    register("bet_summary", q(lambda s, d: S.bet_summary(S.all_lines(scores(s, d)))), sql(dec_sql, """
SELECT match_id, count(*) AS lines_analysed, CAST(sum(is_hard_line) AS BIGINT) AS hard_lines,
  CAST(sum(CASE WHEN tier IN ('strong', 'ensemble') THEN 1 ELSE 0 END) AS BIGINT) AS high_confidence_bets
FROM tiers GROUP BY match_id"""))
    register("rank_bets", q(lambda s, d: S.rank_bets(S.all_lines(scores(s, d)))), sql(dec_sql, f"""
SELECT match_id, tier, line, {SB.round6('confidence')} AS confidence,
  row_number() OVER (PARTITION BY match_id, tier ORDER BY confidence DESC, line) AS rank
FROM tiers WHERE tier IS NOT NULL"""))


_register_reports()
_register_text()
_register_scoring()


# -- variant keys where the variants differ ------------------------------------

def _register_variants():
    from touchline.plans.registry import ESSENTIAL_OUT, projection

    def c1_v1(s, d):
        return C.drop_missing_essential(C.parse_dates(P.raw(s, d)), "v1")

    notnull = " AND ".join(f"{c} IS NOT NULL" for c in SB.ESSENTIAL if c != "date_gmt")
    projection("drop_missing_essential_v1", c1_v1, ESSENTIAL_OUT, SB.fixture_ctes(), f"parsed WHERE {notnull}")
    htv = f"{FTV},\n{SH.tv_history_ctes('ftv2')}"
    avgs = [f"{s}_corners_avg_{n}" for s in ("home", "away") for n in (3, 6, 10)] + \
           [f"{s}_corners_against_avg_{n}" for s in ("home", "away") for n in (3, 6, 10)]
    projection("corner_avgs_tv", P.history_tv, ["match_id", *avgs], htv, "htv")
    register("skip_warmup_tv", lambda s, d: P.history_rows(s, d, P.history_tv, [], 50).select("match_id"),
             sql(htv, "SELECT match_id FROM htv QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 50"))
    from touchline.operators import model as M
    register("chrono_holdout_tv",
             lambda s, d: M.chrono_holdout(P.history_rows(s, d, P.history_tv, [], 50), 0.80),
             sql(htv + ",\npp AS (SELECT match_id, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position, "
                       "count(*) OVER () AS n FROM htv QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 50)",
                 "SELECT match_id, position - 50 AS position, CASE WHEN position - 50 < floor(CAST(n - 50 AS DOUBLE) * 0.8::DOUBLE) "
                 "THEN 'train' ELSE 'test' END AS role FROM pp"))
    register("corner_stats_tv", q(lambda s, d: R.corner_stats(P.features_tv(s, d))), sql(FTV, f"""
SELECT {sql_select(['mean', 'median', 'mode', 'std', 'min', 'max'], {
        'mean': 'avg(total_corners)', 'median': 'median(total_corners)',
        'mode': '(SELECT total_corners FROM ftv2 GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1)',
        'std': 'stddev_samp(total_corners)', 'min': 'min(total_corners)', 'max': 'max(total_corners)'})}
FROM ftv2"""))


_register_variants()
