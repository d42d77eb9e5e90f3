"""Batch scoring (P1-P8): probabilities -> decisions -> bet tiers.

Predictions are long, one row per (match, line); every step is a column
expression on that table, and the per-match summary is one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import nonfinite_to_null, round_half_even
from touchline.operators.features import CORNER_LINES, HARD_LINES

# Cross-validation accuracies of the three ensemble members used
# by the model-free line-score fixture.
MEMBER_ACCURACIES = [0.58, 0.55, 0.52]

# Defaults of the interactive match form (feature -> default).
FORM_DEFAULTS = {
    "pre_match_ppg_home": 1.2, "pre_match_ppg_away": 1.1, "pre_match_xg_home": 1.4, "pre_match_xg_away": 1.3,
    "odds_home": 2.0, "odds_draw": 3.5, "odds_away": 3.0, "avg_corners_pre": 9.5, "btts_pct_pre": 55.0,
    "over25_pct_pre": 65.0, "home_corners_avg_6": 5.0, "away_corners_avg_6": 4.5,
    "home_corners_against_avg_6": 4.2, "away_corners_against_avg_6": 4.8, "home_recent_form": 0.67,
    "away_recent_form": 0.33,
}

# What the form's defaults give for the expected total: all four six-match averages, halved.
DEFAULT_EXPECTED_TOTAL = sum(FORM_DEFAULTS[c] for c in (
    "home_corners_avg_6", "away_corners_avg_6", "home_corners_against_avg_6", "away_corners_against_avg_6")) / 2

# Defaults of the tuned variant's request (numeric, categorical); other numeric fields default to 0.
TV_NUMERIC_DEFAULTS = {
    "home_ppg": 1.2, "away_ppg": 1.1, "home_xg": 1.4, "away_xg": 1.3, "home_odds": 2.0, "draw_odds": 3.5,
    "away_odds": 3.0, "avg_corners_historical": 10.0, "btts_pct": 0.55, "over25_pct": 0.60,
}
TV_CATEGORY_DEFAULTS = {"season_period": "mid_season", "home_team_name": "Unknown", "away_team_name": "Unknown"}


def request_features_tv(requests: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """P1 (tuned): a field that the request lacks takes its default; one that it has but leaves empty, 0 or 'Unknown'."""
    has = set(requests.columns)
    return requests.select(
        "match_id",
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in has
          else F.lit(TV_NUMERIC_DEFAULTS.get(f, 0.0)).alias(f) for f in numeric],
        *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) if c in has
          else F.lit(TV_CATEGORY_DEFAULTS.get(c, "Unknown")).alias(c) for c in categorical])


def line_scores(features: DataFrame, lines=tuple(CORNER_LINES), spread: float = 0.05) -> DataFrame:
    """Model-free member probabilities per (match, line), FIXTURES.md §4; `spread`: how far the members stand apart."""
    lines_arr = F.array(*[F.lit(float(L)) for L in lines])
    x = features.select("match_id", "expected_total_corners", F.explode(lines_arr).alias("line"))
    p1 = 1 / (1 + F.exp((F.col("line") - F.col("expected_total_corners")) / 2))
    return x.select("match_id", "line", p1.alias("p1")).select(
        "match_id", "line", "p1", F.least(F.lit(0.99), F.col("p1") + spread).alias("p2"),
        F.greatest(F.lit(0.01), F.col("p1") - spread).alias("p3"))


def request_features(requests: DataFrame, features: list[str]) -> DataFrame:
    """Form defaults for missing inputs, derived fields recomputed, then any
    missing / non-finite model input -> 0 (prepare_features)."""
    out = requests
    for name, default in FORM_DEFAULTS.items():
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(nonfinite_to_null(F.col(name).cast("double")), F.lit(default)))
        else:
            out = out.withColumn(name, F.lit(default))
    hf, af = F.col("home_corners_avg_6"), F.col("away_corners_avg_6")
    ha, aa = F.col("home_corners_against_avg_6"), F.col("away_corners_against_avg_6")
    out = out.withColumns({
        "expected_total_corners": (hf + af + ha + aa) / 2,
        "corner_advantage_home": hf - ha,
        "corner_advantage_away": af - aa,
    })
    return out.select("match_id", *[F.coalesce(nonfinite_to_null(F.col(f).cast("double")), F.lit(0.0)).alias(f)
                                    if f in out.columns else F.lit(0.0).alias(f) for f in features])


def total_interval(pred: DataFrame, col: str = "prediction", v1: bool = False) -> DataFrame:
    """Rounded prediction (half-even) and its interval."""
    x = F.col(col)
    if v1:
        return pred.select("match_id", round_half_even(x, 1).alias("prediction"),
                           round_half_even(x - 1.96 * 1.5, 1).alias("lower"), round_half_even(x + 1.96 * 1.5, 1).alias("upper"))
    return pred.select("match_id", round_half_even(x, 2).alias("prediction"), round_half_even(x, 0).alias("rounded"),
                       F.greatest(F.lit(0.0), x - 2).alias("lower"), (x + 2).alias("upper"))


def line_decision(scores: DataFrame, p: str = "p1", threshold: float = 0.6) -> DataFrame:
    """Single-model line decision."""
    over = F.col(p)
    under = 1 - over
    return scores.select(
        "match_id", "line", over.alias("over_probability"), under.alias("under_probability"),
        F.when(over > 0.5, "Over").otherwise("Under").alias("prediction"),
        F.greatest(over, under).alias("confidence"),
        F.when(over > threshold, "Over").when(under > threshold, "Under").otherwise("Skip").alias("recommended"),
        (F.abs(over - 0.5) * 2).alias("edge"))


def _ensemble(scores: DataFrame, probability, n_over, consensus, threshold: float) -> DataFrame:
    over = F.col("__p")
    under = 1 - over
    return scores.withColumn("__p", probability).select(
        "match_id", "line", over.alias("over_probability"), under.alias("under_probability"),
        F.when(over > 0.5, "Over").otherwise("Under").alias("prediction"),
        F.greatest(over, under).alias("confidence"),
        F.when(over > threshold, "Over").when(under > threshold, "Under").otherwise("Skip").alias("recommended"),
        (F.abs(over - 0.5) * 2).alias("edge"),
        consensus.cast("int").alias("consensus"),
        F.when(consensus, F.lit("CONSENSUS"))
        .otherwise(F.concat(F.lit("Split("), n_over.cast("string"), F.lit("/3)"))).alias("special_info"))


def ensemble_decision(scores: DataFrame, accuracies=tuple(MEMBER_ACCURACIES), threshold: float = 0.62) -> DataFrame:
    """P4 + P5: weighted member probability (weights = accuracy / sum) and consensus."""
    total = sum(accuracies)
    w = [a / total for a in accuracies]
    members = [F.col("p1"), F.col("p2"), F.col("p3")]
    prob = w[0] * members[0] + w[1] * members[1] + w[2] * members[2]
    n_over = sum((m > 0.5).cast("int") for m in members)
    return _ensemble(scores, prob, n_over, (n_over == 0) | (n_over == 3), threshold)


def weighted_decision(scores: DataFrame, threshold: float = 0.62) -> DataFrame:
    """P4 + P5 for fitted members: `scores(match_id, line, p1..p3, w1..w3)`, the weights of a line's members summing to 1; a NULL
    member is one that the line does not have. Consensus: all members that there are on one side."""
    members, weights = [F.col(f"p{k}") for k in (1, 2, 3)], [F.col(f"w{k}") for k in (1, 2, 3)]
    prob = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(members, weights)), F.lit(0.0))
    n_over = sum((F.coalesce((p > 0.5).cast("int"), F.lit(0)) for p in members), F.lit(0))
    there = sum((p.isNotNull().cast("int") for p in members), F.lit(0))
    return _ensemble(scores, prob, n_over, (n_over == 0) | (n_over == there), threshold)


def all_lines(scores: DataFrame, hard=tuple(HARD_LINES)) -> DataFrame:
    """Hard lines use the ensemble decision, the others the single model."""
    is_hard = F.col("line").isin(*[float(h) for h in hard])
    single = line_decision(scores.where(~is_hard)).withColumns(
        {"consensus": F.lit(None).cast("int"), "special_info": F.lit("Standard")})
    ens = ensemble_decision(scores.where(is_hard))
    return single.unionByName(ens).withColumn("is_hard_line", F.col("line").isin(*[float(h) for h in hard])
                                              .cast("int"))


def fitted_lines(scores: DataFrame, hard=tuple(HARD_LINES)) -> DataFrame:
    """`all_lines` for fitted members: hard lines by `weighted_decision`, the others by their one model."""
    is_hard = F.col("line").isin(*[float(h) for h in hard])
    single = line_decision(scores.where(~is_hard)).withColumns(
        {"consensus": F.lit(None).cast("int"), "special_info": F.lit("Standard")})
    return single.unionByName(weighted_decision(scores.where(is_hard))).withColumn(
        "is_hard_line", F.col("line").isin(*[float(h) for h in hard]).cast("int"))


# The least confidence and edge of the tiers, by kind of line.
def bet_tier_col():
    conf, edge = F.col("confidence"), F.col("edge")
    hard = F.col("is_hard_line") == 1
    cons = F.coalesce(F.col("consensus") == 1, F.lit(False))
    standard = (F.when((conf >= 0.75) & (edge >= 0.3), "strong")
                .when((conf >= 0.65) & (edge >= 0.2), "good").otherwise("avoid"))
    hard_cons = (F.when((conf >= 0.68) & (edge >= 0.25), "ensemble")
                 .when((conf >= 0.62) & (edge >= 0.15), "good").otherwise("avoid"))
    hard_split = (F.when((conf >= 0.72) & (edge >= 0.35), "strong")
                  .when((conf >= 0.65) & (edge >= 0.22), "good").otherwise("avoid"))
    tier = F.when(hard & cons, hard_cons).when(hard, hard_split).otherwise(standard)
    return F.when(F.col("recommended") != "Skip", tier)


def bet_tiers(decisions: DataFrame) -> DataFrame:
    """P6 + P7: tier per (match, line); Skip lines get no tier."""
    prob = F.when(F.col("recommended") == "Over", F.col("over_probability")) \
        .otherwise(F.col("under_probability")) * 100
    return decisions.select("match_id", "line", "recommended", "confidence", "edge", "is_hard_line",
                            "special_info", prob.alias("probability"), bet_tier_col().alias("tier"))


def bet_summary(decisions: DataFrame) -> DataFrame:
    """Per match: lines analysed, hard lines, strong + ensemble bets."""
    t = bet_tiers(decisions)
    return t.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("lines_analysed"),
        F.sum("is_hard_line").cast("bigint").alias("hard_lines"),
        F.sum(F.when(F.col("tier").isin("strong", "ensemble"), 1).otherwise(0)).cast("bigint")
        .alias("high_confidence_bets"))


def rank_bets(decisions: DataFrame) -> DataFrame:
    """K4: rank inside (match, tier) by confidence desc, then line."""
    t = bet_tiers(decisions).where(F.col("tier").isNotNull())
    w = Window.partitionBy("match_id", "tier").orderBy(F.col("confidence").desc(), F.col("line"))
    return t.select("match_id", "tier", "line", "confidence", F.row_number().over(w).alias("rank"))
