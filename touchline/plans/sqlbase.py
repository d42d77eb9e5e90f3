"""DuckDB SQL text for the oracles: shared CTEs for the fixture and the
cleaning / feature stages. Written independently of the Spark plans (plain
ROW_NUMBER / QUALIFY / window SQL, no chunking), so an agreement checks the
Spark formulation rather than repeating it.
"""

from __future__ import annotations

from touchline.operators.features import CORNER_LINES, SEASONAL_FACTORS, line_name
from touchline.sources.testdata import MATCH_COLUMNS

STRING_COLUMNS = {"date_raw", "home_team_name", "away_team_name", "odds_home",
                  "home_team_red_cards", "away_team_red_cards"}
ID_COLUMNS = {"match_id", "season"}
ALL_COLUMNS = [name for name, _ in MATCH_COLUMNS] + ["date_gmt"]
NUMERIC = [n for n, _ in MATCH_COLUMNS if n not in STRING_COLUMNS | ID_COLUMNS]
ESSENTIAL_NUM = ["home_team_goal_count", "away_team_goal_count", "home_team_corner_count",
                 "away_team_corner_count"]
ESSENTIAL = ESSENTIAL_NUM + ["home_team_name", "away_team_name", "date_gmt"]
NON_ESSENTIAL_NUM = [c for c in NUMERIC if c not in ESSENTIAL_NUM]


def round6(expr: str) -> str:
    """Same arithmetic as the Spark side's round6."""
    return (f"(CASE WHEN isfinite({expr}) THEN CAST(floor(({expr}) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0 "
            f"ELSE {expr} END)")


def sdiv(n: str, d: str, default: float, bound: float | None = 100.0, eps: str = "1e-12",
         finite: bool = True) -> str:
    cond = f"({d}) <> 0 AND abs({d}) > {eps}"
    if finite:
        cond += f" AND isfinite({d}) AND isfinite({n})"
    val = f"({n}) / ({d})"
    if bound is not None:
        val = f"LEAST(GREATEST({val}, {-bound}), {bound})"
    return f"(CASE WHEN {cond} THEN {val} ELSE {float(default)} END)"


def clipx(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE LEAST(GREATEST({x}, {lo}), {hi}) END)"


def fixture_ctes() -> str:
    cols = ",\n    ".join(f"{expr} AS {name}" for name, expr in MATCH_COLUMNS)
    return f"""li AS (
  SELECT l_orderkey,
    CAST(SUM(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS BIGINT) AS q_odd,
    CAST(SUM(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS BIGINT) AS q_even,
    COUNT(*) AS n_li, MAX(l_linenumber) AS mx
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS k, o_orderdate AS d, c_mktsegment AS seg, c_nationkey AS nk,
    CAST(FLOOR(o_totalprice) AS BIGINT) AS tp, CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS ab,
    li.q_odd, li.q_even, li.n_li, li.mx
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
raw AS (SELECT
    {cols}
  FROM b),
parsed AS (SELECT *, TRY_CAST(date_raw AS TIMESTAMP) AS date_gmt FROM raw)"""


def _sentinel(c: str, values=("-1", "-999", "999"), inf: bool = True) -> str:
    cond = f"{c} IN ({', '.join(values)})"
    if inf:
        cond += f" OR NOT isfinite({c})"
    return f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}"


def _select_replacing(repl: dict[str, str], columns=None) -> str:
    columns = columns or ALL_COLUMNS
    return ", ".join(repl.get(c, c) for c in columns)


def clean_v3_ctes() -> str:
    """c1 (drop essential) -> c2 (sentinels) -> c3 (median) -> c5 (dedup) -> clean3 (range)."""
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ESSENTIAL)
    sent = {c: _sentinel(c) for c in NUMERIC}
    meds = ", ".join(f"median({c}) AS {c}" for c in NON_ESSENTIAL_NUM)
    fill = {c: f"COALESCE(c2.{c}, med.{c}, 0) AS {c}" for c in NON_ESSENTIAL_NUM}
    fill_sel = ", ".join(fill.get(c, f"c2.{c}") for c in ALL_COLUMNS)
    return f"""{fixture_ctes()},
c1 AS (SELECT * FROM parsed WHERE {notnull}),
c2 AS (SELECT {_select_replacing(sent)} FROM c1),
med AS (SELECT {meds} FROM c2),
c3 AS (SELECT {fill_sel} FROM c2, med),
c5 AS (SELECT * FROM c3 QUALIFY row_number() OVER (
         PARTITION BY date_gmt, home_team_name, away_team_name ORDER BY match_id) = 1),
clean3 AS (SELECT * FROM c5 WHERE home_team_corner_count BETWEEN 0 AND 25
                              AND away_team_corner_count BETWEEN 0 AND 25)"""


def clean_tv_ctes() -> str:
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ESSENTIAL)
    sent = {c: _sentinel(c) for c in NUMERIC}
    rc = "COALESCE(TRY_CAST({c} AS DOUBLE), 0)"
    return f"""{fixture_ctes()},
t1 AS (SELECT * FROM parsed WHERE {notnull}),
t2 AS (SELECT * FROM t1 WHERE {rc.format(c='home_team_red_cards')} = 0
                          AND {rc.format(c='away_team_red_cards')} = 0),
t3 AS (SELECT * FROM t2 WHERE home_team_goal_count + away_team_goal_count <= 15
                          AND home_team_goal_count <= 10 AND away_team_goal_count <= 10),
t4 AS (SELECT {_select_replacing(sent)} FROM t3),
t5 AS (SELECT * FROM t4 QUALIFY row_number() OVER (
         PARTITION BY date_gmt, home_team_name, away_team_name ORDER BY match_id) = 1),
t6 AS (SELECT * FROM t5 WHERE home_team_corner_count BETWEEN 0 AND 36
                          AND away_team_corner_count BETWEEN 0 AND 36),
cleantv AS (SELECT * FROM t6
  WHERE NOT COALESCE(home_team_possession = 0 AND away_team_possession = 0, FALSE)
    AND COALESCE(home_team_possession + away_team_possession BETWEEN 85 AND 120, FALSE)
    AND NOT COALESCE(home_team_shots = 0 AND away_team_shots = 0, FALSE))"""


def clean_v1_ctes() -> str:
    numeric = NUMERIC + ["odds_home"]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ESSENTIAL if c != "date_gmt")
    meds1 = ", ".join(f"median({c}) AS {c}" for c in numeric)
    fill1 = ", ".join((f"COALESCE(v0.{c}, m1.{c}) AS {c}" if c in numeric else f"v0.{c}") for c in ALL_COLUMNS)
    rep = ", ".join((f"CASE WHEN {c} = -1 THEN NULL ELSE {c} END AS {c}" if c in numeric else c)
                    for c in ALL_COLUMNS)
    fill2 = ", ".join((f"COALESCE(v2.{c}, m2.{c}) AS {c}" if c in numeric else f"v2.{c}") for c in ALL_COLUMNS)
    v0_cols = ", ".join(("TRY_CAST(odds_home AS DOUBLE) AS odds_home" if c == "odds_home" else c)
                        for c in ALL_COLUMNS)
    return f"""{fixture_ctes()},
v0 AS (SELECT {v0_cols} FROM parsed WHERE {notnull}),
m1 AS (SELECT {meds1} FROM v0),
v1a AS (SELECT {fill1} FROM v0, m1),
v2 AS (SELECT {rep} FROM v1a),
m2 AS (SELECT {meds1} FROM v2),
v3a AS (SELECT {fill2} FROM v2, m2),
clean1 AS (SELECT * FROM v3a QUALIFY row_number() OVER (
         PARTITION BY date_gmt, home_team_name, away_team_name ORDER BY match_id) = 1)"""


def features_v3_ctes() -> str:
    """clean3 -> f3 (engineer_features)."""
    h, a = "home_team_corner_count", "away_team_corner_count"
    lines = ",\n    ".join(
        f"CAST(COALESCE({h} + {a} > {L}, FALSE) AS INTEGER) AS {line_name(L)}" for L in CORNER_LINES)
    odds_med = ("median(TRY_CAST(odds_home AS DOUBLE)) AS oh, median(odds_draw) AS od, "
                "median(odds_away) AS oa")
    oh = clipx("COALESCE(TRY_CAST(odds_home AS DOUBLE), om.oh)", 1.01, 100)
    od = clipx("COALESCE(odds_draw, om.od)", 1.01, 100)
    oa = clipx("COALESCE(odds_away, om.oa)", 1.01, 100)
    pct = {c: f"COALESCE({c}, 50) / 100 AS {c}" for c in ("btts_pct_pre", "over25_pct_pre", "over35_pct_pre")}
    base_cols = [c for c in ALL_COLUMNS if c not in ("odds_home", "odds_draw", "odds_away")]
    base_sel = ", ".join(pct.get(c, c) for c in base_cols)
    return f"""{clean_v3_ctes()},
om AS (SELECT {odds_med} FROM clean3),
fa AS (SELECT {base_sel},
    {oh} AS odds_home, {od} AS odds_draw, {oa} AS odds_away,
    {h} + {a} AS total_corners, {h} - {a} AS corner_difference,
    {sdiv(h, f'{h} + {a}', 0.5)} AS home_corner_ratio,
    {lines},
    pre_match_ppg_home - pre_match_ppg_away AS pre_match_ppg_difference,
    pre_match_ppg_home + pre_match_ppg_away AS pre_match_ppg_total,
    {sdiv('pre_match_ppg_home', 'pre_match_ppg_away', 1.0)} AS pre_match_strength_ratio,
    pre_match_xg_home - pre_match_xg_away AS pre_match_xg_difference,
    pre_match_xg_home + pre_match_xg_away AS pre_match_xg_total,
    {sdiv('pre_match_xg_home', 'pre_match_xg_away', 1.0)} AS pre_match_xg_ratio,
    avg_corners_pre AS expected_corners_base
  FROM clean3, om),
f3 AS (SELECT *,
    implied_home_prob + implied_draw_prob + implied_away_prob - 1 AS market_margin,
    1 - abs(implied_home_prob - implied_away_prob) AS match_competitiveness
  FROM (SELECT *,
    {sdiv('1.0', 'odds_home', 0.33)} AS implied_home_prob,
    {sdiv('1.0', 'odds_draw', 0.33)} AS implied_draw_prob,
    {sdiv('1.0', 'odds_away', 0.33)} AS implied_away_prob,
    {sdiv('odds_home', 'odds_away', 1.0)} AS home_away_odds_ratio
  FROM fa))"""


def features_tv_ctes() -> str:
    h, a = "home_team_corner_count", "away_team_corner_count"
    hg, ag = "home_team_goal_count", "away_team_goal_count"
    lines = ",\n    ".join(
        f"CAST(COALESCE({h} + {a} > {L}, FALSE) AS INTEGER) AS {line_name(L)}" for L in CORNER_LINES)
    med = ("median(TRY_CAST(odds_home AS DOUBLE)) AS oh, median(odds_draw) AS od, median(odds_away) AS oa")

    def odd(expr, m):
        return clipx(f"COALESCE({expr}, om.{m}, 2.5)", 1.01, 50)

    return f"""{clean_tv_ctes()},
om AS (SELECT {med} FROM cleantv),
ga AS (SELECT *,
    {h} + {a} AS total_corners, {h} - {a} AS corner_difference,
    {sdiv(h, f'{h} + {a}', 0.5, bound=10.0)} AS home_corner_ratio,
    {lines},
    pre_match_ppg_home AS home_ppg_tv, pre_match_ppg_away AS away_ppg_tv,
    pre_match_xg_home AS home_xg, pre_match_xg_away AS away_xg,
    {odd('TRY_CAST(odds_home AS DOUBLE)', 'oh')} AS home_odds,
    {odd('odds_draw', 'od')} AS draw_odds,
    {odd('odds_away', 'oa')} AS away_odds,
    avg_corners_pre AS avg_corners_historical,
    COALESCE(btts_pct_pre, 50) / 100 AS btts_pct,
    COALESCE(over25_pct_pre, 50) / 100 AS over25_pct,
    {hg} + {ag} AS total_goals, {hg} - {ag} AS goal_difference,
    CAST(COALESCE({hg} + {ag} > 2.5, FALSE) AS INTEGER) AS high_scoring,
    CAST(COALESCE({hg} > 0 AND {ag} > 0, FALSE) AS INTEGER) AS both_teams_scored,
    CAST(COALESCE({hg} > {ag}, FALSE) AS INTEGER) AS home_win,
    CAST(COALESCE({hg} = {ag}, FALSE) AS INTEGER) AS draw,
    CAST(COALESCE({hg} < {ag}, FALSE) AS INTEGER) AS away_win,
    CAST(month(date_gmt) AS INTEGER) AS month,
    CAST(isodow(date_gmt) - 1 AS INTEGER) AS day_of_week,
    CAST(isodow(date_gmt) IN (6, 7) AS INTEGER) AS is_weekend,
    CASE WHEN month(date_gmt) IN (12, 1) THEN 'winter' WHEN month(date_gmt) IN (5, 6, 7) THEN 'late_season'
         WHEN month(date_gmt) IN (8, 9) THEN 'early_season' ELSE 'mid_season' END AS season_period
  FROM cleantv, om),
gb AS (SELECT * EXCLUDE (home_ppg, away_ppg) RENAME (home_ppg_tv AS home_ppg, away_ppg_tv AS away_ppg) FROM ga),
ftv AS (SELECT *,
    home_ppg - away_ppg AS ppg_difference, home_ppg + away_ppg AS ppg_total,
    home_xg - away_xg AS xg_difference, home_xg + away_xg AS xg_total,
    {sdiv('home_ppg', 'away_ppg', 1.0, bound=10.0)} AS strength_ratio,
    {sdiv('home_xg', 'away_xg', 1.0, bound=10.0)} AS attacking_ratio,
    {sdiv('1.0', 'home_odds', 0.4, bound=10.0)} AS implied_home_prob,
    {sdiv('1.0', 'draw_odds', 0.3, bound=10.0)} AS implied_draw_prob,
    {sdiv('1.0', 'away_odds', 0.3, bound=10.0)} AS implied_away_prob,
    var_pop_3 AS odds_variance
  FROM (SELECT *, ((home_odds - (home_odds + draw_odds + away_odds) / 3) ^ 2
                 + (draw_odds - (home_odds + draw_odds + away_odds) / 3) ^ 2
                 + (away_odds - (home_odds + draw_odds + away_odds) / 3) ^ 2) / 3 AS var_pop_3 FROM gb)),
ftv2 AS (SELECT *, implied_home_prob + implied_draw_prob + implied_away_prob - 1 AS market_margin,
    1 - abs(implied_home_prob - implied_away_prob) AS match_competitiveness FROM ftv)"""


def seasonal_sql(date: str) -> str:
    whens = " ".join(f"WHEN month({date}) = {m} THEN {f}" for m, f in SEASONAL_FACTORS.items())
    return f"(CASE WHEN {date} IS NULL THEN 0.0 {whens} ELSE 1.0 END)"


def features_v1_ctes() -> str:
    """clean1 -> fv1 (v1 engineer_features)."""
    h, a = "home_team_corner_count", "away_team_corner_count"
    v1 = dict(eps="1e-10", bound=1000.0, finite=False)
    t = f"({h} + {a})"
    return f"""{clean_v1_ctes()},
fv1 AS (SELECT *,
    {t} AS total_corners, {h} - {a} AS corner_difference,
    CASE WHEN {t} <= 0 THEN NULL WHEN {t} <= 6 THEN 'Low' WHEN {t} <= 10 THEN 'Medium'
         WHEN {t} <= 14 THEN 'High' WHEN {t} IS NOT NULL THEN 'Very High' END AS corner_category,
    CAST(COALESCE({t} > 9, FALSE) AS INTEGER) AS over_9_corners,
    CAST(COALESCE({t} > 11, FALSE) AS INTEGER) AS over_11_corners,
    CAST(COALESCE({t} > 13, FALSE) AS INTEGER) AS over_13_corners,
    home_ppg - away_ppg AS ppg_difference,
    pre_match_ppg_home - pre_match_ppg_away AS pre_match_ppg_difference,
    pre_match_xg_home - pre_match_xg_away AS pre_match_xg_difference,
    pre_match_xg_home + pre_match_xg_away AS pre_match_xg_total,
    {sdiv('odds_home', 'odds_away', 1.0, **v1)} AS odds_home_away_ratio,
    {sdiv('1.0', 'odds_home', 0.5, **v1)} AS implied_home_prob,
    {sdiv('1.0', 'odds_away', 0.5, **v1)} AS implied_away_prob,
    {sdiv('1.0', 'odds_draw', 0.33, **v1)} AS implied_draw_prob,
    avg_corners_pre AS corner_expectation,
    0 AS team_strength_diff, 1 AS home_advantage
  FROM clean1)"""
