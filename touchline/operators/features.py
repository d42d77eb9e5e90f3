"""Scalar features: one projection each, all built-in expressions (codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip, flag, safe_divide
from touchline.operators.clean import coerce_numeric, column_medians

# The over/under corner lines, and v1's integer lines.
CORNER_LINES = [7.5, 8.5, 9.5, 10.5, 11.5, 12.5, 13.5, 14.5, 15.5]
V1_LINES = [9, 11, 13]
# Lines handled by the ensemble / stricter tiers.
HARD_LINES = [8.5, 9.5, 10.5, 11.5, 12.5, 13.5]
# Month -> seasonal factor (other months 1.0).
SEASONAL_FACTORS = {8: 0.95, 9: 0.97, 10: 0.98, 11: 1.0, 12: 1.0, 1: 1.0, 2: 1.0, 3: 1.02, 4: 1.03, 5: 1.05}


def line_name(line: float) -> str:
    return "over_" + (f"{line:g}".replace(".", "_")) + "_corners"


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


# -- F2 / F3 / F4 / F5 ------------------------------------------------------

def corner_totals(df: DataFrame, ratio_bound: float = 100.0) -> DataFrame:
    h, a = F.col("home_team_corner_count"), F.col("away_team_corner_count")
    return df.withColumns({
        "total_corners": h + a,
        "corner_difference": h - a,
        "home_corner_ratio": safe_divide(h, h + a, 0.5, bound=ratio_bound),
    })


def over_line_targets(df: DataFrame, lines=tuple(CORNER_LINES)) -> DataFrame:
    return df.withColumns({line_name(L): flag(F.col("total_corners") > L) for L in lines})


def over_int_targets(df: DataFrame, lines=tuple(V1_LINES)) -> DataFrame:
    return df.withColumns({f"over_{L}_corners": flag(F.col("total_corners") > L) for L in lines})


def corner_category(df: DataFrame) -> DataFrame:
    """Right-closed bins (0,6], (6,10], (10,14], (14,inf); 0 or NULL -> NULL."""
    t = F.col("total_corners")
    cat = (F.when(t <= 0, None).when(t <= 6, "Low").when(t <= 10, "Medium")
           .when(t <= 14, "High").when(t.isNotNull(), "Very High"))
    return df.withColumn("corner_category", cat)


# -- F6 - F15 (v3 / chatbot) -------------------------------------------------

def ppg_features(df: DataFrame, h="pre_match_ppg_home", a="pre_match_ppg_away") -> DataFrame:
    if not _has(df, h, a):
        return df
    return df.withColumns({
        "pre_match_ppg_difference": F.col(h) - F.col(a),
        "pre_match_ppg_total": F.col(h) + F.col(a),
        "pre_match_strength_ratio": safe_divide(F.col(h), F.col(a), 1.0),
    })


def xg_features(df: DataFrame, h="pre_match_xg_home", a="pre_match_xg_away") -> DataFrame:
    if not _has(df, h, a):
        return df
    return df.withColumns({
        "pre_match_xg_difference": F.col(h) - F.col(a),
        "pre_match_xg_total": F.col(h) + F.col(a),
        "pre_match_xg_ratio": safe_divide(F.col(h), F.col(a), 1.0),
    })


ODDS = ["odds_home", "odds_draw", "odds_away"]


def odds_clean(df: DataFrame, lo: float = 1.01, hi: float = 100.0, all_null_default=None,
               columns=tuple(ODDS), out_names=None) -> DataFrame:
    """Coerce to number, NULL -> median (one broadcast row), clip [lo, hi]."""
    columns = [c for c in columns if c in df.columns]
    out_names = out_names or {c: c for c in columns}
    coerced = df.withColumns({out_names[c]: coerce_numeric(F.col(c).cast("string")) for c in columns})
    outs = [out_names[c] for c in columns]
    med = column_medians(coerced, outs).select([F.col(c).alias("__med_" + c) for c in outs])
    joined = coerced.crossJoin(F.broadcast(med))
    fills = {}
    for c in outs:
        filler = F.col("__med_" + c)
        if all_null_default is not None:
            filler = F.coalesce(filler, F.lit(float(all_null_default)))
        fills[c] = clip(F.coalesce(F.col(c), filler), lo, hi)
    return joined.withColumns(fills).drop(*["__med_" + c for c in outs])


def implied_probs(df: DataFrame, defaults=(0.33, 0.33, 0.33), bound=100.0,
                  names=("odds_home", "odds_draw", "odds_away")) -> DataFrame:
    h, d, a = names
    return df.withColumns({
        "implied_home_prob": safe_divide(F.lit(1.0), F.col(h), defaults[0], bound=bound),
        "implied_draw_prob": safe_divide(F.lit(1.0), F.col(d), defaults[1], bound=bound),
        "implied_away_prob": safe_divide(F.lit(1.0), F.col(a), defaults[2], bound=bound),
    })


def market_features(df: DataFrame) -> DataFrame:
    """F10 market margin, F11 competitiveness."""
    ph, pd_, pa = F.col("implied_home_prob"), F.col("implied_draw_prob"), F.col("implied_away_prob")
    return df.withColumns({
        "market_margin": ph + pd_ + pa - 1,
        "match_competitiveness": 1 - F.abs(ph - pa),
    })


def odds_ratio(df: DataFrame, h="odds_home", a="odds_away", name="home_away_odds_ratio", **kw) -> DataFrame:
    return df.withColumn(name, safe_divide(F.col(h), F.col(a), 1.0, **kw))


def odds_variance(df: DataFrame, names=("home_odds", "draw_odds", "away_odds")) -> DataFrame:
    """Population variance of the three odds of a row (closed form)."""
    xs = [F.col(n) for n in names]
    mean = (xs[0] + xs[1] + xs[2]) / 3.0
    var = ((xs[0] - mean) ** 2 + (xs[1] - mean) ** 2 + (xs[2] - mean) ** 2) / 3.0
    return df.withColumn("odds_variance", var)


PERCENT_COLUMNS = ["btts_pct_pre", "over25_pct_pre", "over35_pct_pre"]


def percent_to_unit(df: DataFrame, columns=tuple(PERCENT_COLUMNS), renames=None) -> DataFrame:
    renames = renames or {}
    return df.withColumns({renames.get(c, c): coerce_numeric(F.col(c), 50) / 100
                           for c in columns if c in df.columns})


def historical_alias(df: DataFrame, name: str = "expected_corners_base", source: str = "avg_corners_pre") -> DataFrame:
    return df.withColumn(name, F.col(source)) if source in df.columns else df


def engineer_features(df: DataFrame) -> DataFrame:
    """v2 / v3 feature set."""
    out = over_line_targets(corner_totals(df))
    out = xg_features(ppg_features(out))
    if _has(out, *ODDS):
        out = odds_clean(out)
        out = odds_ratio(market_features(implied_probs(out)))
    out = historical_alias(out)
    return percent_to_unit(out)


# -- v1 features (F4, F5, F6, F7, F9, F12, F15, F22) ----------------------

def engineer_features_v1(df: DataFrame) -> DataFrame:
    v1 = dict(eps=1e-10, bound=1000.0, check_finite=False)
    out = corner_category(corner_totals(df).drop("home_corner_ratio"))
    out = over_int_targets(out)
    out = out.withColumn("ppg_difference", F.col("home_ppg") - F.col("away_ppg"))
    if _has(out, "pre_match_ppg_home", "pre_match_ppg_away"):
        out = out.withColumn("pre_match_ppg_difference", F.col("pre_match_ppg_home") - F.col("pre_match_ppg_away"))
    if _has(out, "pre_match_xg_home", "pre_match_xg_away"):
        out = out.withColumns({
            "pre_match_xg_difference": F.col("pre_match_xg_home") - F.col("pre_match_xg_away"),
            "pre_match_xg_total": F.col("pre_match_xg_home") + F.col("pre_match_xg_away"),
        })
    if _has(out, "odds_home", "odds_away"):
        out = out.withColumns({
            "odds_home_away_ratio": safe_divide(F.col("odds_home"), F.col("odds_away"), 1.0, **v1),
            "implied_home_prob": safe_divide(F.lit(1.0), F.col("odds_home"), 0.5, **v1),
            "implied_away_prob": safe_divide(F.lit(1.0), F.col("odds_away"), 0.5, **v1),
        })
    if "odds_draw" in out.columns:
        out = out.withColumn("implied_draw_prob", safe_divide(F.lit(1.0), F.col("odds_draw"), 0.33, **v1))
    out = historical_alias(out, "corner_expectation")
    return constant_features(out, v1=True)


def constant_features(df: DataFrame, v1: bool = False) -> DataFrame:
    """constants the reference sets and never changes."""
    if v1:
        return df.withColumns({"team_strength_diff": F.lit(0), "home_advantage": F.lit(1)})
    return df.withColumns({
        "match_importance_factor": F.lit(1.0),
        "referee_corner_tendency": F.lit(0.0),
        "venue_corner_factor": F.lit(0.0),
        "rest_impact_factor": F.lit(0.0),
    })


# -- tuned variant (F16 - F20) ------------------------------------------------

# Tv renames and defaults for absent source columns.
TV_RENAMES = [
    ("pre_match_ppg_home", "home_ppg", 1.0),
    ("pre_match_ppg_away", "away_ppg", 1.0),
    ("pre_match_xg_home", "home_xg", 1.0),
    ("pre_match_xg_away", "away_xg", 1.0),
]
TV_ODDS = [("odds_home", "home_odds", 2.0), ("odds_draw", "draw_odds", 3.5), ("odds_away", "away_odds", 3.0)]
TV_HIST = [("avg_corners_pre", "avg_corners_historical", 10.0), ("btts_pct_pre", "btts_pct", 0.55),
           ("over25_pct_pre", "over25_pct", 0.60)]


def rename_with_defaults(df: DataFrame) -> DataFrame:
    """F16: source column if present, else the constant."""
    out = df
    for src, dst, default in TV_RENAMES:
        out = out.withColumn(dst, coerce_numeric(F.col(src)) if src in df.columns else F.lit(default))
    present = [s for s, _, _ in TV_ODDS if s in out.columns]
    if present:
        out = odds_clean(out, lo=1.01, hi=50.0, all_null_default=2.5, columns=present,
                         out_names={s: d for s, d, _ in TV_ODDS})
    for src, dst, default in TV_ODDS:
        if src not in df.columns:
            out = out.withColumn(dst, F.lit(default))
    for src, dst, default in TV_HIST:
        if src in df.columns:
            v = coerce_numeric(F.col(src))
            out = out.withColumn(dst, v if dst == "avg_corners_historical" else F.coalesce(v, F.lit(50.0)) / 100)
        else:
            out = out.withColumn(dst, F.lit(default))
    return out


def goal_features(df: DataFrame) -> DataFrame:
    h, a = F.col("home_team_goal_count"), F.col("away_team_goal_count")
    return df.withColumns({
        "total_goals": h + a,
        "goal_difference": h - a,
        "high_scoring": flag(h + a > 2.5),
        "both_teams_scored": flag((h > 0) & (a > 0)),
    })


def outcome_flags(df: DataFrame) -> DataFrame:
    h, a = F.col("home_team_goal_count"), F.col("away_team_goal_count")
    return df.withColumns({"home_win": flag(h > a), "draw": flag(h == a), "away_win": flag(h < a)})


def calendar_features(df: DataFrame, date: str = "date_gmt") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "month": F.month(d),
        "day_of_week": F.weekday(d),
        "is_weekend": flag(F.weekday(d).isin(5, 6)),
    })


def season_period_col(month: Column) -> Column:
    return (F.when(month.isin(12, 1), "winter").when(month.isin(5, 6, 7), "late_season")
            .when(month.isin(8, 9), "early_season").otherwise("mid_season"))


def season_period(df: DataFrame) -> DataFrame:
    return df.withColumn("season_period", season_period_col(F.col("month")))


def seasonal_factor_col(date: Column) -> Column:
    m = F.month(date)
    expr = None
    for month, factor in SEASONAL_FACTORS.items():
        expr = (F.when(m == month, F.lit(factor)) if expr is None else expr.when(m == month, F.lit(factor)))
    return F.when(date.isNull(), F.lit(0.0)).otherwise(expr.otherwise(F.lit(1.0)))


def engineer_features_tv(df: DataFrame) -> DataFrame:
    tvb = 10.0
    out = over_line_targets(corner_totals(df, ratio_bound=tvb))
    out = rename_with_defaults(out)
    out = out.withColumns({
        "ppg_difference": F.col("home_ppg") - F.col("away_ppg"),
        "ppg_total": F.col("home_ppg") + F.col("away_ppg"),
        "xg_difference": F.col("home_xg") - F.col("away_xg"),
        "xg_total": F.col("home_xg") + F.col("away_xg"),
        "strength_ratio": safe_divide(F.col("home_ppg"), F.col("away_ppg"), 1.0, bound=tvb),
        "attacking_ratio": safe_divide(F.col("home_xg"), F.col("away_xg"), 1.0, bound=tvb),
    })
    out = implied_probs(out, defaults=(0.4, 0.3, 0.3), bound=tvb, names=("home_odds", "draw_odds", "away_odds"))
    out = odds_variance(market_features(out))
    out = outcome_flags(goal_features(out))
    return season_period(calendar_features(out))
