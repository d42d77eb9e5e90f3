"""Registered queries for feature matrices, scoring/selection, splits, metrics
and model training (C13-C15, C18, K1-K3, M1-M20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import clean as C
from touchline.operators import history as H
from touchline.operators import model as M
from touchline.operators import report as R
from touchline.operators import score as S
from touchline.operators import select as SE
from touchline.operators.features import CORNER_LINES, HARD_LINES, line_name
from touchline.plans import pipeline as P
from touchline.plans import sqlbase as SB
from touchline.plans import sqlhistory as SH
from touchline.plans import sqlmore as SM
from touchline.plans.registry import NOT_ROUNDED, register, sql_select
from touchline.sources.testdata import round_doubles

NOT_ROUNDED.update({"label", "model", "trial", "max_depth", "min_instances", "n_folds", "used", "line_key",
                    "season_period", "home_team_name", "away_team_name"})

LINES = [line_name(L) for L in CORNER_LINES]
HARD = [line_name(L) for L in HARD_LINES]
STANDARD = [t for t in LINES if t not in HARD]
TARGETS_V3 = ["total_corners"] + LINES
V1_TARGETS = ["over_9_corners", "over_11_corners", "over_13_corners"]
# How many features each selector keeps (total, hard lines, other lines).
K_BY_TARGET = {"total_corners": 40, **{t: 35 for t in HARD}, **{t: 25 for t in STANDARD}}

# Numeric feature list of the tuned variant's matrix (M7, strict),
# in schema order; tests check it equals numeric_feature_list() on the plan.
TV_NUMERIC = [
    "pre_match_ppg_home", "pre_match_ppg_away", "pre_match_xg_home", "pre_match_xg_away", "odds_draw", "odds_away",
    "odds_over25", "odds_btts_yes", "home_ppg", "away_ppg", "avg_goals_pre", "avg_corners_pre", "btts_pct_pre",
    "over25_pct_pre", "over35_pct_pre", "home_xg", "away_xg", "home_odds", "draw_odds", "away_odds",
    "avg_corners_historical", "btts_pct", "over25_pct", "ppg_difference", "ppg_total", "xg_difference", "xg_total",
    "strength_ratio", "attacking_ratio", "implied_home_prob", "implied_draw_prob", "implied_away_prob",
    "market_margin", "match_competitiveness", "odds_variance", "month", "day_of_week", "is_weekend",
    "home_corners_avg_3", "home_corners_against_avg_3", "home_corners_avg_6", "home_corners_against_avg_6",
    "home_corners_avg_10", "home_corners_against_avg_10", "home_goals_avg_3", "home_goals_against_avg_3",
    "home_goals_avg_6", "home_goals_against_avg_6", "home_goals_avg_10", "home_goals_against_avg_10",
    "home_corner_trend", "home_form_3", "home_form_6", "home_corner_variance_6", "home_high_corner_rate_8",
    "home_low_corner_rate_8", "home_attacking_tendency", "home_defensive_solidity", "home_rest_days",
    "away_corners_avg_3", "away_corners_against_avg_3", "away_corners_avg_6", "away_corners_against_avg_6",
    "away_corners_avg_10", "away_corners_against_avg_10", "away_goals_avg_3", "away_goals_against_avg_3",
    "away_goals_avg_6", "away_goals_against_avg_6", "away_goals_avg_10", "away_goals_against_avg_10",
    "away_corner_trend", "away_form_3", "away_form_6", "away_corner_variance_6", "away_high_corner_rate_8",
    "away_low_corner_rate_8", "away_attacking_tendency", "away_defensive_solidity", "away_rest_days",
    "h2h_avg_corners", "expected_corners_base",
]
# The reference's own list (M7, not strict), with the post-match columns.
TV_NUMERIC_ALL = [*TV_NUMERIC[:15], *SE.POST_MATCH[4:], *TV_NUMERIC[15:35], *SE.POST_MATCH[:4], *TV_NUMERIC[35:]]
FS_SQL = "CASE WHEN sum(k * v) > 0 AND sum(k) > 2 THEN sum(k * (m - g) * (m - g)) / (sum(k * v) / (sum(k) - 2)) END"
TV_CATEGORICAL = ["season_period", "home_team_name", "away_team_name"]


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def q(fn):
    return lambda spark, sf: round_doubles(fn(spark, sf))


def feats_v3() -> list[str]:
    return list(P.FEATURE_CANDIDATES_V3)


def mutual_information_v3(spark: SparkSession, sf: str) -> DataFrame:
    """(target, feature, mi) of all ten targets, from one pass over the matrix; read by every selection."""
    return P.shared_stage(spark, ("mi_v3", sf), lambda: SE.mutual_information(
        P.feature_matrix_v3(spark, sf), feats_v3(), TARGETS_V3))


def feats_v1() -> list[str]:
    return list(P.FEATURE_CANDIDATES_V1)


# -- SQL: feature matrices ----------------------------------------------------------

def matrix_v3_ctes() -> str:
    return _winsorised_ctes(feats_v3(), SH.v3_history_ctes("f3"), "h3", "m3")


def matrix_v2_ctes() -> str:
    return _winsorised_ctes(P.FEATURE_CANDIDATES_V2, SH.v2_history_ctes("f3"), "h2", "m3")


def _winsorised_ctes(fs: list[str], history: str, h: str, out: str) -> str:
    warm_cols = ", ".join(["match_id", "date_gmt", "expected_total_corners AS __etc", *TARGETS_V3] +
                          [f"CASE WHEN isfinite({f}) THEN {f} END AS {f}" for f in fs if f != "expected_total_corners"] +
                          ["CASE WHEN isfinite(expected_total_corners) THEN expected_total_corners END "
                           "AS expected_total_corners"])
    qs = ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS q_{f}" for f in fs)
    clipped = ", ".join(
        f"COALESCE(CASE WHEN {f} IS NULL THEN NULL ELSE LEAST(GREATEST({f}, q_{f}[1] - 2.5 * (q_{f}[3] - q_{f}[1])),"
        f" q_{f}[3] + 2.5 * (q_{f}[3] - q_{f}[1])) END, q_{f}[2], 0.0) AS {f}" for f in fs)
    return f"""{SB.features_v3_ctes()},
{history},
wi AS (SELECT {warm_cols} FROM {h} QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 30),
wq AS (SELECT {qs} FROM wi),
{out} AS (SELECT match_id, date_gmt, __etc, {', '.join(TARGETS_V3)}, {clipped} FROM wi, wq)"""


def matrix_v1_ctes() -> str:
    fs = feats_v1()
    z1 = ", ".join(f"COALESCE(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in fs)
    z2 = ", ".join(f"CASE WHEN isfinite({f}) THEN {f} END AS {f}" for f in fs)
    med = ", ".join(f"median({f}) AS d_{f}" for f in fs)
    z3 = ", ".join(f"COALESCE({f}, d_{f}, 0.0) AS {f}" for f in fs)
    pq = ", ".join(f"quantile_cont({f}, [0.01, 0.99]) AS p_{f}" for f in fs)
    clip = ", ".join(f"CASE WHEN {f} IS NULL THEN NULL ELSE LEAST(GREATEST({f}, p_{f}[1]), p_{f}[2]) END AS {f}"
                     for f in fs)
    keep = "match_id, date_gmt, total_corners, " + ", ".join(V1_TARGETS)
    return f"""{SB.features_v1_ctes()},
{SH.v1_history_ctes('fv1')},
z1 AS (SELECT {keep}, {z1} FROM hv1 WHERE total_corners IS NOT NULL
       QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 50),
z2 AS (SELECT {keep}, {z2} FROM z1),
zm AS (SELECT {med} FROM z2),
z3 AS (SELECT {keep}, {z3} FROM z2, zm),
zq AS (SELECT {pq} FROM z3),
mx1 AS (SELECT {keep}, {clip} FROM z3, zq)"""


def matrix_tv_ctes() -> str:
    num = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in TV_NUMERIC)
    med = ", ".join(f"median({f}) AS d_{f}" for f in TV_NUMERIC)
    imp = ", ".join(f"COALESCE({f}, d_{f}, 0.0) AS {f}" for f in TV_NUMERIC)
    stats = ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in TV_NUMERIC)
    scaled = ", ".join(f"({f} - a_{f}) / (CASE WHEN s_{f} = 0 THEN 1.0 ELSE s_{f} END) AS {f}" for f in TV_NUMERIC)
    return f"""{SB.features_tv_ctes()},
{SH.tv_history_ctes('ftv2')},
tw1 AS (SELECT * FROM htv QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 50),
keep AS (SELECT home_team_name AS t FROM tw1 GROUP BY 1 HAVING count(*) >= 10 ORDER BY count(*) DESC, 1 ASC LIMIT 50),
tw2 AS (SELECT match_id, date_gmt, total_corners, {num},
    COALESCE(season_period, 'Unknown') AS season_period,
    COALESCE(CASE WHEN home_team_name IN (SELECT t FROM keep) THEN home_team_name ELSE 'Other' END, 'Unknown')
      AS home_team_name,
    COALESCE(CASE WHEN away_team_name IN (SELECT t FROM keep) THEN away_team_name ELSE 'Other' END, 'Unknown')
      AS away_team_name
  FROM tw1),
tmed AS (SELECT {med} FROM tw2),
mtv AS (SELECT match_id, date_gmt, total_corners, season_period, home_team_name, away_team_name, {imp}
  FROM tw2, tmed),
tst AS (SELECT {stats} FROM mtv),
stv AS (SELECT match_id, {scaled} FROM mtv, tst)"""


# -- Spark: feature matrices ----------------------------------------------------------

def matrix_v3(spark: SparkSession, sf: str) -> DataFrame:
    """(match_id, date_gmt, total_corners, __etc: the expected total before winsorising) of the matrix's rows. Neither total is
    winsorised, so no quantile is taken; written, for positions, counts and rows read it."""
    def build():
        h = P.history_rows(spark, sf, P.history_v3, ["total_corners", "expected_total_corners"])
        rows = C.skip_warmup(h.select("match_id", "date_gmt", "total_corners"), 30)
        return rows.join(h.select("match_id", F.col("expected_total_corners").alias("__etc")), "match_id")

    return P.shared_stage(spark, ("expected_v3", sf), build)


def matrix_v1(spark: SparkSession, sf: str) -> DataFrame:
    return P.feature_matrix_v1(spark, sf)


def fill_zero_v1(spark: SparkSession, sf: str) -> DataFrame:
    feats = P.available(P.history_v1(spark, sf, wanted=feats_v1()), feats_v1())
    known = P.history_rows(spark, sf, P.history_v1, [*feats, "total_corners"]).where(F.col("total_corners").isNotNull())
    body = C.skip_warmup(known, 50)
    return C.fill_zero(body.select("match_id", *[F.col(f).cast("double").alias(f) for f in feats]), feats)


def numeric_tv(spark: SparkSession, sf: str, strict: bool = True) -> list[str]:
    """M7 from the schema of the tuned variant's whole history; no history is computed for it."""
    return SE.numeric_feature_list(H.history_features_tv(P.features_tv(spark, sf)), LINES, strict)


def matrix_tv(spark: SparkSession, sf: str, numeric: list[str] | None = None) -> DataFrame:
    """tv training matrix: skip 50, team buckets, numeric median / category 'Unknown'; `numeric`: the numeric features that are read (all)."""
    numeric = numeric_tv(spark, sf) if numeric is None else numeric
    h = P.history_rows(spark, sf, P.history_tv, ["total_corners", *TV_CATEGORICAL, *numeric], 50)
    grouped = R.frequent_teams(h).drop("home_team_name", "away_team_name") \
        .withColumnRenamed("home_team_group", "home_team_name").withColumnRenamed("away_team_group", "away_team_name")
    base = grouped.select("match_id", "date_gmt", "total_corners", *TV_CATEGORICAL,
                          *[F.col(f).cast("double").alias(f) for f in numeric])
    return C.impute_before_encode(base, numeric, TV_CATEGORICAL)


# -- registration ------------------------------------------------------------------------

def _register_matrices():
    fs3, fs1 = feats_v3(), feats_v1()
    register("iqr_winsorise", q(lambda s, d: P.feature_matrix_v3(s, d).select("match_id", *fs3)),
             sql(matrix_v3_ctes(), f"SELECT match_id, {sql_select(fs3)} FROM m3"))
    register("pct_winsorise", q(lambda s, d: matrix_v1(s, d).select("match_id", *fs1)),
             sql(matrix_v1_ctes(), f"SELECT match_id, {sql_select(fs1)} FROM mx1"))
    register("fill_zero_fallback", q(fill_zero_v1),
             sql(matrix_v1_ctes(), f"SELECT match_id, "
                 f"{sql_select(fs1, {f: f'COALESCE(CASE WHEN isfinite({f}) THEN {f} END, 0.0)' for f in fs1})} FROM z1"))
    register("impute_before_encode", q(lambda s, d: matrix_tv(s, d).select("match_id", *TV_CATEGORICAL, *TV_NUMERIC)),
             sql(matrix_tv_ctes(), f"SELECT match_id, {', '.join(TV_CATEGORICAL)}, {sql_select(TV_NUMERIC)} FROM mtv"))
    register("standard_scale",
             q(lambda s, d: SE.standard_scale(matrix_tv(s, d), TV_NUMERIC, ["match_id"])),
             sql(matrix_tv_ctes(), f"SELECT match_id, {sql_select(TV_NUMERIC)} FROM stv"))
    register("one_hot", lambda s, d: SE.one_hot(matrix_tv(s, d, []), TV_CATEGORICAL),
             sql(matrix_tv_ctes() + ",\nfirsts AS (SELECT " + ", ".join(f"min({c}) AS f_{c}" for c in TV_CATEGORICAL)
                 + " FROM mtv)",
                 " UNION ALL ".join(f"SELECT match_id, '{c}_' || {c} AS feature FROM mtv, firsts WHERE {c} <> f_{c}"
                                    for c in TV_CATEGORICAL)))

    ptv = matrix_tv_ctes() + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position, count(*) OVER () AS n FROM mtv),
tr AS (SELECT * FROM ranked WHERE position < floor(CAST(n AS DOUBLE) * 0.80::DOUBLE)),
te AS (SELECT * FROM ranked WHERE NOT position < floor(CAST(n AS DOUBLE) * 0.80::DOUBLE))"""

    def split_tv(s, d):
        m = P.shared_stage(s, ("matrix_tv", d), lambda: matrix_tv(s, d))
        role = M.chrono_holdout(m.select("match_id", "date_gmt"), 0.80).select("match_id", "role")
        mm = m.join(role, "match_id")
        return mm.where(F.col("role") == "train"), mm.where(F.col("role") == "test")

    def scaled_test(s, d):
        tr, te = split_tv(s, d)
        return SE.apply_scale(te, SE.fit_scale(tr, TV_NUMERIC), TV_NUMERIC, ["match_id"])

    def encoded_test(s, d):
        tr, te = split_tv(s, d)
        return SE.apply_one_hot(te, SE.fit_one_hot(tr, TV_CATEGORICAL), TV_CATEGORICAL)

    register("standard_scale_transform", q(scaled_test), sql(ptv + ",\nst AS (SELECT " + ", ".join(
        f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in TV_NUMERIC) + " FROM tr)",
        "SELECT match_id, " + sql_select(TV_NUMERIC, {
            f: f"({f} - a_{f}) / (CASE WHEN s_{f} = 0 THEN 1.0 ELSE s_{f} END)" for f in TV_NUMERIC}) + " FROM te, st"))
    register("one_hot_transform", encoded_test, sql(ptv, " UNION ALL ".join(
        f"SELECT match_id, '{c}_' || {c} AS feature FROM te WHERE {c} IN (SELECT {c} FROM tr) "
        f"AND {c} <> (SELECT min({c}) FROM tr)" for c in TV_CATEGORICAL)))

    given = ["ppg_difference", "month", "home_corners_avg_6", "season_period", "away_team_name"]
    asked = ["home_ppg", "away_odds", "over25_pct", "ppg_difference", "month", "home_corners_avg_6", "away_rest_days"]

    def requests_tv(s, d):
        h = P.history_tv(s, d, wanted=given).select("match_id", *given)
        return S.request_features_tv(h, asked, TV_CATEGORICAL)

    filled = {"home_ppg": "1.2", "away_odds": "3.0", "over25_pct": "0.60", "away_rest_days": "0.0",
              **{f: f"COALESCE(CAST({f} AS DOUBLE), 0.0)" for f in asked if f in given}}
    register("request_features_tv", q(requests_tv), sql(
        f"{SB.features_tv_ctes()},\n{SH.tv_history_ctes('ftv2')}",
        f"SELECT match_id, {sql_select(asked, filled)}, COALESCE(season_period, 'Unknown') AS season_period, "
        "'Unknown' AS home_team_name, COALESCE(away_team_name, 'Unknown') AS away_team_name FROM htv"))

    def numeric_list(strict):
        def run(s, d):
            names = numeric_tv(s, d, strict)
            # only counted, so the wide history is not written
            h = C.skip_warmup(P.history_tv(s, d, wanted=["date_gmt", *names]), 50, keys=P.history_rows(s, d, P.history_tv, []))
            one = h.agg(*[F.count(f).alias(f) for f in names])
            pairs = ", ".join(f"{i}, '{f}', `{f}`" for i, f in enumerate(names))
            return one.selectExpr(f"stack({len(names)}, {pairs}) AS (position, feature, n_values)")
        return run

    tv1 = f"""{SB.features_tv_ctes()},
{SH.tv_history_ctes('ftv2')},
tw1 AS (SELECT * FROM htv QUALIFY row_number() OVER (ORDER BY date_gmt, match_id) > 50)"""
    for key, strict, names in (("numeric_feature_list", True, TV_NUMERIC),
                               ("numeric_feature_list_all", False, TV_NUMERIC_ALL)):
        register(key, numeric_list(strict), sql(tv1, " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, '{f}' AS feature, count({f}) AS n_values FROM tw1"
            for i, f in enumerate(names))))
    NOT_ROUNDED.update({"position", "n_values"})


def _register_scores():
    fs1, fs3 = feats_v1(), feats_v3()
    m1 = matrix_v1_ctes()
    register("f_regression_scores", q(lambda s, d: SE.f_regression_scores(matrix_v1(s, d), fs1, "total_corners")),
             sql(m1, " UNION ALL ".join(
                 f"SELECT '{f}' AS feature, {SB.round6('r')} AS r, "
                 f"{SB.round6('CASE WHEN r * r < 1 THEN r * r / (1 - r * r) * (n - 2) END')} AS f_score FROM ("
                 f"SELECT count(*) AS n, CASE WHEN var_pop({f}) > 0 AND var_pop(total_corners) > 0 "
                 f"THEN corr({f}, total_corners) END AS r FROM mx1)"
                 for f in fs1)))

    def fclassif(s, d):
        m = matrix_v1(s, d)
        out = None
        for t in V1_TARGETS:
            part = SE.f_classif_scores(m, fs1, t).select(F.lit(t).alias("target"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    parts = []
    for t in V1_TARGETS:
        for f in fs1:
            grouped = (f"SELECT {t} AS y, count(*) AS k, avg({f}) AS m, var_pop({f}) AS v FROM mx1 GROUP BY {t}")
            whole = f"(SELECT avg({f}) FROM mx1)"
            parts.append(f"SELECT '{t}' AS target, '{f}' AS feature, {SB.round6(FS_SQL)} AS f_score "
                         f"FROM (SELECT *, {whole} AS g FROM ({grouped}))")
    register("f_classif_scores", q(fclassif), sql(m1, " UNION ALL ".join(parts)))

    r9 = "floor({x} * 1000000000.0 + 0.5) / 1000000000.0"

    def mi_sql(targets, matrix=matrix_v3_ctes, fs=tuple(fs3)):
        cuts = ", ".join(f"quantile_cont({f}, [{', '.join(str(p) for p in SE.DECILES)}]) AS c_{f}" for f in fs)
        bins = ", ".join(f"CAST(len(list_filter(c_{f}, lambda x: {r9.format(x='x')} < {r9.format(x=f'm3.{f}')})) "
                         f"AS INTEGER) AS {f}" for f in fs)
        tcols = ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in targets)
        return sql(matrix() + f""",
cuts AS (SELECT {cuts} FROM m3),
bins AS (SELECT {tcols}, {bins} FROM m3, cuts),
lt AS (UNPIVOT bins ON {', '.join(targets)} INTO NAME target VALUE y),
lf AS (UNPIVOT lt ON {', '.join(fs)} INTO NAME feature VALUE bin),
cnt AS (SELECT target, feature, bin, y, count(*) AS n_by FROM lf GROUP BY ALL),
cw AS (SELECT *, sum(n_by) OVER (PARTITION BY target, feature) AS n,
    sum(n_by) OVER (PARTITION BY target, feature, bin) AS n_b,
    sum(n_by) OVER (PARTITION BY target, feature, y) AS n_y FROM cnt),
mi AS (SELECT target, feature, sum((n_by / n) * ln(n_by * n / (n_b * n_y))) AS mi FROM cw GROUP BY ALL)""",
                   f"SELECT target, feature, {SB.round6('mi')} AS mi FROM mi")

    register("mi_regression_scores",
             q(lambda s, d: SE.mutual_information(P.feature_matrix_v3(s, d), fs3, ["total_corners"])),
             mi_sql(["total_corners"]))
    register("mi_classif_scores",
             q(lambda s, d: SE.mutual_information(P.feature_matrix_v3(s, d), fs3, LINES)),
             mi_sql(LINES))

    def topk(s, d):
        return SE.top_k_features(mutual_information_v3(s, d), K_BY_TARGET)

    kvals = " UNION ALL ".join(f"SELECT '{t}' AS target, {k} AS k" for t, k in K_BY_TARGET.items())
    topk_ctes = mi_sql(TARGETS_V3).split("\nSELECT target, feature, ")[0][len("WITH "):] + f""",
kk AS ({kvals}),
rk AS (SELECT m.target, m.feature, m.mi, row_number() OVER (PARTITION BY m.target ORDER BY m.mi DESC, m.feature) AS rank,
  kk.k FROM mi m JOIN kk ON kk.target = m.target)"""
    register("top_k_features", q(topk),
             sql(topk_ctes, f"SELECT target, feature, {SB.round6('mi')} AS mi, rank FROM rk WHERE rank <= k"))
    register("recent_feature_subset",
             lambda s, d: SE.recent_feature_subset(topk(s, d).where(F.col("target").isin(*HARD))),
             sql(topk_ctes + """,
rs AS (SELECT target, feature FROM rk WHERE rank <= k AND target IN (""" + ", ".join(f"'{t}'" for t in HARD) + """)
       AND regexp_matches(lower(feature), '_3|_6|recent|trend|momentum'))""",
                 "SELECT target, feature, CAST(count(*) OVER (PARTITION BY target) > 10 AS INTEGER) AS used FROM rs"))
    # with every candidate selected there are more than ten recent ones, so the subset is used
    register("recent_feature_subset_all", lambda s, d: SE.recent_feature_subset(SE.top_k_features(
        mutual_information_v3(s, d), {t: len(fs3) for t in HARD})), sql("c AS (SELECT 1)", " UNION ALL ".join(
            f"SELECT '{t}' AS target, '{f}' AS feature, CAST(1 AS INTEGER) AS used" for t in HARD for f in fs3
            if any(k in f for k in SE.RECENT_KEYS))))

    # v1: the 20 best by F, of the total and of each of its three flags
    def topk_v1(s, d):
        m = matrix_v1(s, d)
        scores = SE.f_regression_scores(m, fs1, "total_corners").select(F.lit("total_corners").alias("target"), "feature", "f_score")
        for t in V1_TARGETS:
            scores = scores.unionByName(SE.f_classif_scores(m, fs1, t).select(F.lit(t).alias("target"), "feature", "f_score"))
        top = SE.top_k_features(scores.where("f_score IS NOT NULL"), {t: 20 for t in ["total_corners", *V1_TARGETS]}, "f_score")
        return top.select("target", "feature")

    reg = " UNION ALL ".join(
        f"SELECT 'total_corners' AS target, '{f}' AS feature, CASE WHEN var_pop({f}) > 0 THEN "
        f"corr({f}, total_corners) * corr({f}, total_corners) / (1 - corr({f}, total_corners) * corr({f}, total_corners)) * (count(*) - 2) END "
        f"AS f_score FROM mx1" for f in fs1)
    cls = " UNION ALL ".join(x.replace(SB.round6(FS_SQL), FS_SQL) for x in parts)
    register("top_k_features_v1", topk_v1, sql(matrix_v1_ctes() + f""",
fs AS ({reg} UNION ALL {cls}),
fr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f_score DESC, feature) AS rank FROM fs WHERE f_score IS NOT NULL)""",
                                               "SELECT target, feature FROM fr WHERE rank <= 20"))

    # v2: its own matrix, 20 for the total and 25 for each line
    k_v2 = {"total_corners": 20, **{t: 25 for t in LINES}}
    register("top_k_features_v2", q(lambda s, d: SE.top_k_features(
        SE.mutual_information(P.feature_matrix_v2(s, d), P.FEATURE_CANDIDATES_V2, TARGETS_V3), k_v2)),
             sql(mi_sql(TARGETS_V3, matrix_v2_ctes, P.FEATURE_CANDIDATES_V2).split("\nSELECT target, feature, ")[0][len("WITH "):] + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mi DESC, feature) AS rank FROM mi)""",
                 f"SELECT target, feature, {SB.round6('mi')} AS mi, rank FROM rk "
                 "WHERE rank <= CASE WHEN target = 'total_corners' THEN 20 ELSE 25 END"))


def _register_splits():
    m3 = matrix_v3_ctes()
    register("chronological_order", lambda s, d: M.global_position(P.features_v3(s, d)).select("match_id", "position"),
             sql(SB.features_v3_ctes(), "SELECT match_id, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position FROM f3"))
    pos = "pp AS (SELECT match_id, row_number() OVER (ORDER BY date_gmt, match_id) - 1 AS position, count(*) OVER () AS n FROM m3)"
    folds_sql = f"""{m3},
{pos},
fd AS (SELECT pp.match_id, CAST(f.fold AS INTEGER) AS fold,
    CASE WHEN position < n - (5 - f.fold) * (n // 6) THEN 'train'
         WHEN position < n - (5 - f.fold) * (n // 6) + n // 6 THEN 'test' END AS role
  FROM pp, range(5) AS f(fold))"""
    register("time_series_folds", lambda s, d: M.time_series_folds(P.split_keys_v3(s, d)),
             sql(folds_sql, "SELECT match_id, fold, role FROM fd WHERE role IS NOT NULL"))
    register("chrono_holdout", lambda s, d: M.chrono_holdout(P.split_keys_v3(s, d)),
             sql(f"{m3},\n{pos}", "SELECT match_id, position, CASE WHEN position < floor(CAST(n AS DOUBLE) * 0.85::DOUBLE) THEN 'train' "
                                  "ELSE 'test' END AS role FROM pp"))

    register("chrono_holdout_v1", lambda s, d: M.chrono_holdout(P.split_keys_v1(s, d), 0.80),
             sql(f"""{matrix_v1_ctes()},
pp AS (SELECT match_id, row_number() OVER (ORDER BY date_gmt NULLS LAST, match_id) - 1 AS position, count(*) OVER () AS n
  FROM mx1)""", "SELECT match_id, position, CASE WHEN position < floor(CAST(n AS DOUBLE) * 0.80::DOUBLE) THEN 'train' "
                 "ELSE 'test' END AS role FROM pp"))

    def cv(s, d):
        m = matrix_v3(s, d)
        f = M.time_series_folds(m).where(F.col("role") == "test")
        pred = f.join(m.select("match_id", F.col("total_corners").alias("y"), F.col("__etc").alias("prediction")),
                      "match_id")
        return M.cv_scores(pred)

    per_fold = """pf AS (SELECT fd.fold, avg(abs(m3.total_corners - m3.__etc)) AS mae,
    CASE WHEN sum(m3.total_corners * m3.total_corners) - sum(m3.total_corners) * sum(m3.total_corners) / count(*) > 0
         THEN 1 - sum((m3.total_corners - m3.__etc) * (m3.total_corners - m3.__etc)) /
              (sum(m3.total_corners * m3.total_corners) - sum(m3.total_corners) * sum(m3.total_corners) / count(*))
    END AS r2
  FROM fd JOIN m3 USING (match_id) WHERE fd.role = 'test' GROUP BY fd.fold)"""
    register("cv_scores", q(cv), sql(folds_sql + ",\n" + per_fold, f"""
SELECT {SB.round6('avg(mae)')} AS mae_mean, {SB.round6('2 * stddev_pop(mae)')} AS mae_two_std,
  {SB.round6('avg(r2)')} AS r2_mean, {SB.round6('2 * stddev_pop(r2)')} AS r2_two_std, count(*) AS n_folds FROM pf"""))
    NOT_ROUNDED.add("n_folds")

    def holdout_metrics(s, d):
        m = matrix_v3(s, d)
        h = M.chrono_holdout(m).where(F.col("role") == "test")
        pred = h.join(m.select("match_id", F.col("total_corners").alias("y"), F.col("__etc").alias("prediction")),
                      "match_id")
        return M.regression_metrics(pred)

    register("regression_metrics", q(holdout_metrics), sql(f"{m3},\n{pos}", f"""
SELECT {SB.round6('avg(abs(total_corners - __etc))')} AS mae,
  {SB.round6('sqrt(avg((total_corners - __etc) * (total_corners - __etc)))')} AS rmse,
  {SB.round6('CASE WHEN sum(total_corners * total_corners) - sum(total_corners) * sum(total_corners) / count(*) > 0 THEN 1 - sum((total_corners - __etc) * (total_corners - __etc)) / (sum(total_corners * total_corners) - sum(total_corners) * sum(total_corners) / count(*)) END')} AS r2
FROM pp JOIN m3 USING (match_id) WHERE position >= floor(CAST(n AS DOUBLE) * 0.85::DOUBLE)"""))

    def line_pred(s, d):
        h = P.history_rows(s, d, P.history_v3, ["expected_total_corners", *LINES])
        ls = S.line_scores(h)
        stacked = h.select("match_id", F.explode(F.array(*[F.struct(F.lit(float(L)).alias("line"),
                                                                     F.col(line_name(L)).alias("y"))
                                                           for L in CORNER_LINES])).alias("t")).select("match_id", "t.*")
        return ls.join(stacked, ["match_id", "line"]).select("match_id", "line", "y", F.col("p1").alias("p"))

    h3 = f"{SB.features_v3_ctes()},\n{SH.v3_history_ctes('f3')},\n{SM.line_scores_cte('h3')}"
    ycase = "CASE " + " ".join(f"WHEN ls.line = {float(L)} THEN h3.{line_name(L)}" for L in CORNER_LINES) + " END"
    lp = f"lp AS (SELECT ls.match_id, ls.line, {ycase} AS y, ls.p1 AS p FROM ls JOIN h3 USING (match_id))"
    register("classification_metrics", q(lambda s, d: M.classification_metrics(line_pred(s, d), ["line"])),
             sql(h3 + ",\n" + lp, f"""
SELECT line, {SB.round6('avg(CASE WHEN CAST(p > 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END)')} AS accuracy,
  {SB.round6('avg(-(y * ln(LEAST(GREATEST(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - LEAST(GREATEST(p, 1e-15), 1 - 1e-15))))')} AS log_loss
FROM lp GROUP BY line"""))
    cm = """cm AS (SELECT line,
    CAST(sum(CASE WHEN p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN NOT p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
    CAST(sum(CASE WHEN NOT p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM lp GROUP BY line),
prc AS (SELECT line, tn + fp AS s0, tp + fn AS s1,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1
  FROM cm),
pf1 AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
    CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM prc),
rep AS (
  SELECT line, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM pf1
  UNION ALL SELECT line, '1', p1, r1, f1, s1 FROM pf1
  UNION ALL SELECT line, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM pf1
  UNION ALL SELECT line, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM pf1)"""
    register("classification_report", q(lambda s, d: M.classification_report(line_pred(s, d), ["line"])),
             sql(h3 + ",\n" + lp + ",\n" + cm,
                 f"SELECT line, label, {sql_select(['precision', 'recall', 'f1', 'support'])} FROM rep"))


_register_matrices()
_register_scores()
_register_splits()
