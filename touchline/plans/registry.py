"""Registered queries: key -> (Spark plan builder, DuckDB oracle SQL or None).

Spark results and oracle results use the same column names; doubles are
rounded to 6 places on both sides before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import clean as C
from touchline.operators import features as Fe
from touchline.operators import history as H
from touchline.plans import pipeline as P
from touchline.plans import sqlbase as SB
from touchline.plans import sqlhistory as SH
from touchline.sources.testdata import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Columns that are integers or strings in every output (never rounded in SQL).
NOT_ROUNDED = {
    "match_id", "season", "home_team_name", "away_team_name", "date", "side", "team", "opponent",
    "corner_category", "season_period", "month", "day_of_week", "is_weekend", "high_scoring",
    "both_teams_scored", "home_win", "draw", "away_win", "over_9_corners", "over_11_corners",
    "over_13_corners", "team_strength_diff", "home_advantage", "prior_matches", "odds_home_raw", "date_raw", "stage", "step", "removed", "initial",
    "column_name", "inf_count", "has_inf",
    *[Fe.line_name(L) for L in Fe.CORNER_LINES],
}


def sql_select(cols: list[str], exprs: dict[str, str] | None = None) -> str:
    exprs = exprs or {}
    parts = []
    for c in cols:
        e = exprs.get(c, c)
        parts.append(f"{e} AS {c}" if c in NOT_ROUNDED else f"{SB.round6(e)} AS {c}")
    return ", ".join(parts)


def register(key: str, fn: QueryFn, sql: str | None) -> None:
    REGISTRY[key] = Query(fn, sql)


def projection(key: str, plan: QueryFn, cols: list[str], ctes: str | None, final: str,
               spark_exprs: dict | None = None, sql_exprs: dict | None = None) -> None:
    """Register `cols` of a plan; the oracle selects the same columns from CTE `final`. A history plan is told the columns."""
    spark_exprs = spark_exprs or {}
    history = plan in (P.history_v1, P.history_v2, P.history_v3, P.history_tv)

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan(spark, sf_dir, wanted=cols) if history else plan(spark, sf_dir)
        exprs = [spark_exprs[c]() if c in spark_exprs else F.col(c) for c in cols]
        return round_doubles(df.select([e.alias(c) for e, c in zip(exprs, cols)]))

    sql = None if ctes is None else f"WITH {ctes}\nSELECT {sql_select(cols, sql_exprs)} FROM {final}"
    register(key, fn, sql)


DATE_SPARK = {"date": lambda: F.date_format("date_gmt", "yyyy-MM-dd")}
DATE_SQL = {"date": "strftime(date_gmt, '%Y-%m-%d')"}
ESSENTIAL_OUT = ["match_id", "home_team_name", "away_team_name", "home_team_goal_count",
                 "away_team_goal_count", "home_team_corner_count", "away_team_corner_count"]


# -- S6, C ------------------------------------------------------------------

def _parsed(spark, sf):
    return C.parse_dates(P.raw(spark, sf))


def _c1(spark, sf):
    return C.drop_missing_essential(_parsed(spark, sf))


def _c2(spark, sf):
    return C.sentinels_to_null(_c1(spark, sf))


def _c3(spark, sf):
    return C.median_impute(_c2(spark, sf))


def _c5(spark, sf):
    return C.dedup_matches(_c3(spark, sf))


def _v1_pre_dedup(spark, sf):
    out = _parsed(spark, sf).withColumn("odds_home", C.coerce_numeric("odds_home"))
    return C.median_impute_two_pass(C.drop_missing_essential(out, "v1"))


def _tv_stage(n):
    def plan(spark, sf):
        out = C.drop_missing_essential(_parsed(spark, sf))
        steps = [C.red_card_filter, C.scoreline_filter, C.sentinels_to_null, C.dedup_matches,
                 lambda d: C.corner_range_filter(d, 36.0)]
        for s in steps[:n]:
            out = s(out)
        return out
    return plan


def _register_clean():
    num = SB.NUMERIC
    projection("parse_dates", _parsed, ["match_id", "date_raw", "date"], SB.fixture_ctes(), "parsed",
               DATE_SPARK, DATE_SQL)
    projection("drop_missing_essential", _c1, ESSENTIAL_OUT, SB.clean_v3_ctes(), "c1")
    projection("sentinels_to_null", _c2, ["match_id", *num], SB.clean_v3_ctes(), "c2")
    projection("median_impute", _c3, ["match_id", *num], SB.clean_v3_ctes(), "c3")
    projection("median_impute_two_pass", _v1_pre_dedup, ["match_id", *num, "odds_home"],
               SB.clean_v1_ctes(), "v3a")
    projection("dedup_matches", _c5, ["match_id", "date", "home_team_name", "away_team_name"],
               SB.clean_v3_ctes(), "c5", DATE_SPARK, DATE_SQL)
    projection("corner_range_filter", lambda s, d: P.cleaned(s, d, "v3"), ESSENTIAL_OUT,
               SB.clean_v3_ctes(), "clean3")
    projection("corner_range_filter_tv", _tv_stage(5), ESSENTIAL_OUT, SB.clean_tv_ctes(), "t6")
    projection("red_card_filter", _tv_stage(1), ["match_id"], SB.clean_tv_ctes(), "t2")
    projection("scoreline_filter", _tv_stage(2), ESSENTIAL_OUT, SB.clean_tv_ctes(), "t3")
    projection("possession_filter", lambda s, d: C.possession_filter(_tv_stage(5)(s, d)),
               ["match_id", "home_team_possession", "away_team_possession"], SB.clean_tv_ctes(),
               "t6 WHERE NOT COALESCE(home_team_possession = 0 AND away_team_possession = 0, FALSE) "
               "AND COALESCE(home_team_possession + away_team_possession BETWEEN 85 AND 120, FALSE)")
    projection("shots_filter", lambda s, d: C.shots_filter(_tv_stage(5)(s, d)),
               ["match_id", "home_team_shots", "away_team_shots"], SB.clean_tv_ctes(),
               "t6 WHERE NOT COALESCE(home_team_shots = 0 AND away_team_shots = 0, FALSE)")
    projection("clean_tv", lambda s, d: P.cleaned(s, d, "tv"), ESSENTIAL_OUT, SB.clean_tv_ctes(), "cleantv")
    projection("dedup_matches_v1", lambda s, d: P.cleaned(s, d, "v1"),
               ["match_id", "date", "home_team_goal_count", "home_team_corner_count", "odds_home"],
               SB.clean_v1_ctes(), "clean1", DATE_SPARK, DATE_SQL)
    projection("inf_to_null", lambda s, d: C.inf_to_null(P.raw(s, d), ["avg_goals_pre"]),
               ["match_id", "avg_goals_pre"], SB.fixture_ctes(), "raw",
               sql_exprs={"avg_goals_pre": "CASE WHEN isfinite(avg_goals_pre) THEN avg_goals_pre END"})
    projection("coerce_numeric", P.raw,
               ["match_id", "odds_home", "home_team_red_cards", "away_team_red_cards"], SB.fixture_ctes(), "raw",
               spark_exprs={"odds_home": lambda: C.coerce_numeric("odds_home"),
                            "home_team_red_cards": lambda: C.coerce_numeric("home_team_red_cards", 0),
                            "away_team_red_cards": lambda: C.coerce_numeric("away_team_red_cards", 0)},
               sql_exprs={"odds_home": "TRY_CAST(odds_home AS DOUBLE)",
                          "home_team_red_cards": "COALESCE(TRY_CAST(home_team_red_cards AS DOUBLE), 0)",
                          "away_team_red_cards": "COALESCE(TRY_CAST(away_team_red_cards AS DOUBLE), 0)"})

    # C11: removal funnel
    def funnel(spark, sf):
        return round_doubles(C.removal_funnel(P.raw(spark, sf)))

    notnull = " AND ".join(f"{c} IS NOT NULL" for c in SB.ESSENTIAL)
    rc = "COALESCE(TRY_CAST({c} AS DOUBLE), 0) = 0"
    funnel_sql = f"""WITH {SB.clean_tv_ctes()},
tagged AS (SELECT CASE
    WHEN NOT ({notnull}) THEN 'missing_essential'
    WHEN NOT ({rc.format(c='home_team_red_cards')} AND {rc.format(c='away_team_red_cards')}) THEN 'red_cards'
    WHEN NOT COALESCE(home_team_goal_count + away_team_goal_count <= 15 AND home_team_goal_count <= 10
                      AND away_team_goal_count <= 10, FALSE) THEN 'unusual_scoreline' END AS stage FROM parsed),
removed AS (
  SELECT stage, count(*) AS n FROM tagged WHERE stage IS NOT NULL GROUP BY stage
  UNION ALL SELECT 'duplicate', (SELECT count(*) FROM t4) - (SELECT count(*) FROM t5)
  UNION ALL SELECT 'corner_outlier', (SELECT count(*) FROM t5) - (SELECT count(*) FROM t6)
  UNION ALL SELECT 'quality', (SELECT count(*) FROM t6) - (SELECT count(*) FROM cleantv)),
stages AS (SELECT * FROM (VALUES (1, 'missing_essential'), (2, 'red_cards'), (3, 'unusual_scoreline'),
    (4, 'duplicate'), (5, 'corner_outlier'), (6, 'quality')) s(step, stage)),
per AS (SELECT s.step, s.stage, CAST(COALESCE(sum(r.n), 0) AS BIGINT) AS removed FROM stages s
  LEFT JOIN removed r ON r.stage = s.stage GROUP BY s.step, s.stage),
allrows AS (SELECT * FROM per UNION ALL SELECT 7, 'total', CAST(sum(removed) AS BIGINT) FROM per),
init AS (SELECT count(*) AS initial FROM raw)
SELECT CAST(step AS INTEGER) AS step, stage, removed, CAST(initial AS BIGINT) AS initial,
  {SB.round6("CASE WHEN initial > 0 THEN removed * 100.0 / initial ELSE 0.0 END")} AS removed_pct
FROM allrows, init"""
    register("removal_funnel", funnel, funnel_sql)

    # Columns holding infinities (raw table, before cleaning)
    def nonfinite(spark, sf):
        return C.nonfinite_columns(P.raw(spark, sf), SB.NUMERIC)

    union = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(COALESCE(sum(CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END), 0)"
        f" AS BIGINT) AS inf_count FROM raw" for c in SB.NUMERIC)
    register("nonfinite_columns", nonfinite,
             f"WITH {SB.fixture_ctes()}, u AS ({union})\n"
             "SELECT column_name, inf_count, CAST(inf_count > 0 AS INTEGER) AS has_inf FROM u")


# -- F ------------------------------------------------------------------------

def _register_features():
    f3, fv1, ftv = SB.features_v3_ctes(), SB.features_v1_ctes(), SB.features_tv_ctes()
    v3, v1, tv = P.features_v3, P.features_v1, P.features_tv
    lines = [Fe.line_name(L) for L in Fe.CORNER_LINES]
    m = ["match_id"]
    projection("safe_divide", v3, m + ["home_corner_ratio", "pre_match_strength_ratio", "pre_match_xg_ratio",
                                       "home_away_odds_ratio"], f3, "f3")
    projection("safe_divide_tv", tv, m + ["home_corner_ratio", "strength_ratio", "attacking_ratio"], ftv, "ftv2")
    projection("corner_totals", v3, m + ["total_corners", "corner_difference", "home_corner_ratio"], f3, "f3")
    projection("over_line_targets", v3, m + lines, f3, "f3")
    projection("over_int_targets", v1, m + ["over_9_corners", "over_11_corners", "over_13_corners"], fv1, "fv1")
    projection("corner_category", v1, m + ["total_corners", "corner_category"], fv1, "fv1")
    projection("ppg_features", v3, m + ["pre_match_ppg_difference", "pre_match_ppg_total",
                                        "pre_match_strength_ratio"], f3, "f3")
    projection("ppg_features_v1", v1, m + ["ppg_difference", "pre_match_ppg_difference"], fv1, "fv1")
    projection("xg_features", v3, m + ["pre_match_xg_difference", "pre_match_xg_total", "pre_match_xg_ratio"],
               f3, "f3")
    projection("odds_clean", v3, m + ["odds_home", "odds_draw", "odds_away"], f3, "f3")
    projection("odds_clean_tv", tv, m + ["home_odds", "draw_odds", "away_odds"], ftv, "ftv2")
    probs = ["implied_home_prob", "implied_draw_prob", "implied_away_prob"]
    projection("implied_probs", v3, m + probs, f3, "f3")
    projection("implied_probs_v1", v1, m + probs, fv1, "fv1")
    projection("implied_probs_tv", tv, m + probs, ftv, "ftv2")
    projection("market_margin", v3, m + ["market_margin"], f3, "f3")
    projection("market_margin_tv", tv, m + ["market_margin"], ftv, "ftv2")
    projection("match_competitiveness", v3, m + ["match_competitiveness"], f3, "f3")
    projection("odds_ratio", v3, m + ["home_away_odds_ratio"], f3, "f3")
    projection("odds_ratio_v1", v1, m + ["odds_home_away_ratio"], fv1, "fv1")
    projection("odds_variance", tv, m + ["odds_variance"], ftv, "ftv2")
    projection("percent_to_unit", v3, m + ["btts_pct_pre", "over25_pct_pre", "over35_pct_pre"], f3, "f3")
    projection("historical_alias", v3, m + ["expected_corners_base"], f3, "f3")
    projection("historical_alias_v1", v1, m + ["corner_expectation"], fv1, "fv1")
    projection("rename_with_defaults", tv, m + ["home_ppg", "away_ppg", "home_xg", "away_xg",
                                                "avg_corners_historical", "btts_pct", "over25_pct"], ftv, "ftv2")
    projection("goal_features", tv, m + ["total_goals", "goal_difference", "high_scoring", "both_teams_scored"],
               ftv, "ftv2")
    projection("outcome_flags", tv, m + ["home_win", "draw", "away_win"], ftv, "ftv2")
    projection("calendar_features", tv, m + ["month", "day_of_week", "is_weekend"], ftv, "ftv2")
    projection("season_period", tv, m + ["month", "season_period"], ftv, "ftv2")
    projection("constant_features_v1", v1, m + ["team_strength_diff", "home_advantage"], fv1, "fv1")


# -- W ------------------------------------------------------------------------

def _register_history():
    h3 = f"{SB.features_v3_ctes()},\n{SH.v3_history_ctes('f3')}"
    htv = f"{SB.features_tv_ctes()},\n{SH.tv_history_ctes('ftv2')}"
    h2 = f"{SB.features_v3_ctes()},\n{SH.v2_history_ctes('f3')}"
    hv1 = f"{SB.features_v1_ctes()},\n{SH.v1_history_ctes('fv1')}"
    v3, tv, v2, v1 = P.history_v3, P.history_tv, P.history_v2, P.history_v1
    m = ["match_id"]
    sides = ("home", "away")

    def per_side(fmt):
        return [fmt.format(s=s) for s in sides]

    # Long form with each team's prior-match count
    def long_plan(spark, sf):
        t = H.sequence_position(H.team_long(P.features_v3(spark, sf)), ["team"])
        return t.select("match_id", "side", "team", "opponent", "corners_for", "corners_against",
                        "goals_for", "goals_against", "result", F.col("prior").alias("prior_matches"))

    long_sql = (f"WITH {SB.features_v3_ctes()},\n{SH.team_ctes('f3')}\n"
                "SELECT match_id, side, team, CASE WHEN side = 'home' THEN a.away_team_name ELSE a.home_team_name END"
                " AS opponent, cf AS corners_for, ca AS corners_against, "
                "gf AS goals_for, ga AS goals_against, res AS result, prior AS prior_matches "
                "FROM tw JOIN f3 a USING (match_id)")
    register("team_long", lambda s, d: round_doubles(long_plan(s, d)), long_sql)

    avgs = [f"{s}_corners_avg_{n}" for s in sides for n in (3, 6, 10)] + \
           [f"{s}_corners_against_avg_{n}" for s in sides for n in (3, 6, 10)]
    projection("corner_avgs", v3, m + avgs, h3, "h3")
    projection("corner_avgs_v2", v2, m + avgs, h2, "h2")
    projection("corner_avgs_5", v1, m + ["home_team_avg_corners_for", "home_team_avg_corners_against",
                                         "away_team_avg_corners_for", "away_team_avg_corners_against"], hv1, "hv1")
    goals = [f"{s}_goals_avg_{n}" for s in sides for n in (3, 6, 10)] + \
            [f"{s}_goals_against_avg_{n}" for s in sides for n in (3, 6, 10)]
    projection("goal_avgs", tv, m + goals, htv, "htv")
    projection("corner_trend", v3, m + per_side("{s}_corner_trend"), h3, "h3")
    projection("corner_trend_tv", tv, m + per_side("{s}_corner_trend"), htv, "htv")
    projection("recent_form", v3, m + per_side("{s}_recent_form"), h3, "h3")
    projection("recent_form_tv", tv, m + per_side("{s}_form_3") + per_side("{s}_form_6"), htv, "htv")
    projection("corner_variance", v3, m + per_side("{s}_corner_variance"), h3, "h3")
    projection("corner_variance_tv", tv, m + per_side("{s}_corner_variance_6"), htv, "htv")
    projection("corner_momentum", v3, m + per_side("corner_momentum_{s}"), h3, "h3")
    projection("high_low_rate", v3, m + per_side("{s}_high_corner_rate") + per_side("{s}_low_corner_rate"),
               h3, "h3")
    projection("high_low_rate_tv", tv, m + per_side("{s}_high_corner_rate_8") + per_side("{s}_low_corner_rate_8"),
               htv, "htv")
    projection("combined_volatility", v3, m + ["combined_corner_volatility"], h3, "h3")
    projection("h2h_history", v3, m + ["h2h_corner_history"], h3, "h3")
    projection("teams_familiarity", v3, m + ["teams_familiarity"], h3, "h3")
    projection("h2h_pruned", tv, m + ["h2h_avg_corners", "h2h_matches_count"], htv, "htv")
    projection("rest_days", tv, m + per_side("{s}_rest_days"), htv, "htv")
    projection("style_clash", v3, m + ["style_clash_indicator"], h3, "h3")
    projection("corner_consistency", v3, m + per_side("{s}_corner_consistency"), h3, "h3")
    projection("attacking_desperation", v3, m + ["attacking_desperation_factor"], h3, "h3")
    projection("defensive_solidity", v3, m + ["defensive_solidity_factor"], h3, "h3")
    projection("defensive_solidity_tv", tv, m + per_side("{s}_defensive_solidity"), htv, "htv")
    projection("attacking_tendency", tv, m + per_side("{s}_attacking_tendency"), htv, "htv")
    projection("expected_total_corners", v3, m + ["expected_total_corners"], h3, "h3")
    projection("expected_total_corners_v2", v2, m + ["expected_total_corners"], h2, "h2")
    projection("expected_corners_tv", tv, m + ["expected_corners_base"], htv, "htv")
    projection("corner_advantage", v3, m + ["corner_advantage_home", "corner_advantage_away"], h3, "h3")
    projection("v1_strength", v1, m + ["expected_corners_total", "corner_strength_diff"], hv1, "hv1")
    projection("seasonal_factor", v3, m + ["seasonal_corner_adjustment"], h3, "h3")
    projection("constant_features", v3, m + ["match_importance_factor", "referee_corner_tendency",
                                             "venue_corner_factor", "rest_impact_factor"], h3, "h3")


_register_clean()
_register_features()
_register_history()


def queries() -> dict[str, QueryFn]:
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
