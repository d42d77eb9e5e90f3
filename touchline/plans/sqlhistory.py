"""DuckDB SQL for the history features: plain per-team windows over the whole
team (no chunks), and head-to-head via ASOF joins plus explicit pruned lists."""

from __future__ import annotations

from touchline.plans.sqlbase import seasonal_sql

W = "PARTITION BY team ORDER BY date_gmt, match_id"


def fr(n: int, m: int = 1) -> str:
    end = "CURRENT ROW" if m == 0 else f"{m} PRECEDING"
    return f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND {end})"


def all_present(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {fr(n)} = {n} THEN avg({c}) {fr(n)} END"


SIDE_RAW = {
    **{f"cf_avg_{n}": f"avg(cf) {fr(n)}" for n in (3, 5, 6, 10)},
    **{f"ca_avg_{n}": f"avg(ca) {fr(n)}" for n in (3, 5, 6, 10)},
    **{f"gf_avg_{n}": all_present("gf", n) for n in (3, 6, 10)},
    **{f"ga_avg_{n}": all_present("ga", n) for n in (3, 6, 10)},
    "trend": f"avg(cf) {fr(3)} - avg(cf) {fr(6, 4)}",
    "form_3": f"avg(res) {fr(3)}",
    "form_tv_3": f"avg(res_tv) {fr(3)}",
    "form_tv_6": f"avg(res_tv) {fr(6)}",
    "var_5": f"(sum(cf * cf) {fr(5)} - sum(cf) {fr(5)} * sum(cf) {fr(5)} / 5) / 5",
    "var_6": f"(sum(cf * cf) {fr(6)} - sum(cf) {fr(6)} * sum(cf) {fr(6)} / 6) / 6",
    "momentum": (f"0.4 * lag(cf, 4) OVER ({W}) + 0.3 * lag(cf, 3) OVER ({W}) "
                 f"+ 0.2 * lag(cf, 2) OVER ({W}) + 0.1 * lag(cf, 1) OVER ({W})"),
    "high_rate_8": f"sum(CASE WHEN tot >= 12 THEN 1 ELSE 0 END) {fr(8)} / 8.0",
    "low_rate_8": f"sum(CASE WHEN tot <= 8 THEN 1 ELSE 0 END) {fr(8)} / 8.0",
    "consistency": f"1.0 / (1.0 + (sum(cf * cf) {fr(5)} - sum(cf) {fr(5)} * sum(cf) {fr(5)} / 5) / 5)",
    "goal_diff_5": f"({all_present('gf', 5)}) - ({all_present('ga', 5)})",
    "solidity": f"1.0 / (1.0 + avg(ca) {fr(5)})",
    "solidity_tv": f"1.0 / (1.0 + avg(ca) {fr(5)})",
    "attacking_tendency": f"avg(cf) {fr(5)}",
    "rest_days": f"CAST(LEAST(date_diff('second', lag(date_gmt) OVER ({W}), date_gmt) // 86400, 30) AS DOUBLE)",
}
MIN_PRIOR = {
    **{f"{p}_avg_{n}": n for p in ("cf", "ca") for n in (3, 5, 6, 10)},
    **{f"{p}_avg_{n}": n for p in ("gf", "ga") for n in (3, 6, 10)},
    "trend": 6, "form_3": 3, "form_tv_3": 3, "form_tv_6": 6, "var_5": 5, "var_6": 6, "momentum": 4,
    "high_rate_8": 8, "low_rate_8": 8, "consistency": 6, "goal_diff_5": 5, "solidity": 5, "solidity_tv": 5,
    "attacking_tendency": 5, "rest_days": 1,
}
DEFAULTS = {"solidity": 0.5}


def team_ctes(src: str) -> str:
    """src -> lng (2 rows per match) -> tw (guarded per-side values)."""
    h, a = "home_team_corner_count", "away_team_corner_count"
    hg, ag = "home_team_goal_count", "away_team_goal_count"
    raw = ",\n    ".join(f"{e} AS {k}" for k, e in SIDE_RAW.items())
    guarded = ",\n    ".join(
        f"CASE WHEN prior >= {MIN_PRIOR[k]} THEN {k} ELSE {DEFAULTS.get(k, 0.0)} END AS {k}" for k in SIDE_RAW)
    return f"""lng AS (
  SELECT match_id, date_gmt, 'home' AS side, home_team_name AS team, {h} AS cf, {a} AS ca,
         {hg} AS gf, {ag} AS ga, {h} + {a} AS tot FROM {src}
  UNION ALL
  SELECT match_id, date_gmt, 'away' AS side, away_team_name AS team, {a} AS cf, {h} AS ca,
         {ag} AS gf, {hg} AS ga, {h} + {a} AS tot FROM {src}),
lr AS (SELECT *,
    CASE WHEN gf > ga THEN 1.0 WHEN gf = ga THEN 0.5 ELSE 0.0 END AS res,
    CASE WHEN gf > ga THEN 1.0 WHEN gf < ga THEN 0.0 ELSE 0.5 END AS res_tv FROM lng),
tw0 AS (SELECT match_id, side, team, date_gmt, cf, ca, gf, ga, res,
    row_number() OVER ({W}) - 1 AS prior,
    {raw}
  FROM lr),
tw AS (SELECT match_id, side, team, date_gmt, cf, ca, gf, ga, res, prior,
    {guarded}
  FROM tw0)"""


def hw_cte(src: str) -> str:
    cols = list(SIDE_RAW) + ["prior"]
    sel = ", ".join(f"h.{c} AS h_{c}, a.{c} AS a_{c}" for c in cols)
    return f"""hw AS (SELECT s.*, {sel} FROM {src} s
  JOIN tw h ON h.match_id = s.match_id AND h.side = 'home'
  JOIN tw a ON a.match_id = s.match_id AND a.side = 'away')"""


def pair_ctes(src: str) -> str:
    h, a = "home_team_corner_count", "away_team_corner_count"
    sw = "PARTITION BY hn, an ORDER BY date_gmt, match_id"
    return f"""pm AS (SELECT match_id, date_gmt, home_team_name AS hn, away_team_name AS an, {h} + {a} AS tot,
    row_number() OVER (ORDER BY date_gmt, match_id) AS ok FROM {src}),
pw AS (SELECT *,
    row_number() OVER (PARTITION BY least(hn, an), greatest(hn, an) ORDER BY date_gmt, match_id) - 1 AS fam,
    avg(tot) OVER ({sw} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS same_avg3,
    avg(tot) OVER ({sw} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg3_after
  FROM pm),
pv AS (SELECT m.match_id, m.fam, COALESCE(m.same_avg3, r.avg3_after, 0.0) AS h2h_corner_history
  FROM pw m ASOF LEFT JOIN pw r ON r.hn = m.an AND r.an = m.hn AND m.ok > r.ok),
ps AS (SELECT m.match_id, m.hn, m.an, s.ok AS s_ok, s.date_gmt AS s_date
  FROM pw m ASOF LEFT JOIN pw s ON s.hn = m.hn AND s.an = m.an AND m.ok > s.ok),
pr AS (SELECT m.match_id, r.ok AS r_ok, r.date_gmt AS r_date
  FROM pw m ASOF LEFT JOIN pw r ON r.hn = m.an AND r.an = m.hn AND m.ok > r.ok),
items AS (
  SELECT x.match_id, 0 AS part, j.ok, j.tot FROM ps x JOIN pm j
    ON j.hn = x.hn AND j.an = x.an AND j.ok <= x.s_ok AND j.date_gmt >= x.s_date - INTERVAL 5 YEAR
  UNION ALL
  SELECT y.match_id, 1 AS part, j.ok, j.tot FROM ps x JOIN pr y ON y.match_id = x.match_id JOIN pm j
    ON j.hn = x.an AND j.an = x.hn AND j.ok <= y.r_ok AND j.date_gmt >= y.r_date - INTERVAL 5 YEAR),
ilist AS (SELECT match_id, count(*) AS n,
    avg(CASE WHEN rk <= 3 THEN tot END) AS avg3
  FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY part DESC, ok DESC) AS rk FROM items)
  GROUP BY match_id),
ptv AS (SELECT p.match_id, COALESCE(i.avg3, 0.0) AS h2h_avg_corners,
    CAST(COALESCE(i.n, 0) AS DOUBLE) AS h2h_matches_count
  FROM pm p LEFT JOIN ilist i ON i.match_id = p.match_id)"""


def v3_columns() -> dict[str, str]:
    cols: dict[str, str] = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = f"{p}cf_avg_{n}"
            cols[f"{side}_corners_against_avg_{n}"] = f"{p}ca_avg_{n}"
        cols[f"{side}_corner_trend"] = f"{p}trend"
        cols[f"{side}_recent_form"] = f"{p}form_3"
        cols[f"{side}_corner_variance"] = f"{p}var_5"
        cols[f"corner_momentum_{side}"] = f"{p}momentum"
        cols[f"{side}_high_corner_rate"] = f"{p}high_rate_8"
        cols[f"{side}_low_corner_rate"] = f"{p}low_rate_8"
        cols[f"{side}_corner_consistency"] = f"{p}consistency"
    vol = "((h_var_5 + a_var_5) / 2)"
    clash = "abs((h_cf_avg_6 - h_ca_avg_6) - (a_cf_avg_6 - a_ca_avg_6))"
    seasonal = seasonal_sql("date_gmt")
    cols["combined_corner_volatility"] = vol
    cols["h2h_corner_history"] = "pv.h2h_corner_history"
    cols["style_clash_indicator"] = clash
    cols["seasonal_corner_adjustment"] = seasonal
    cols["attacking_desperation_factor"] = (
        "COALESCE(GREATEST(0.0, (2 - h_goal_diff_5) + (2 - a_goal_diff_5)), 0.0) / 4")
    cols["defensive_solidity_factor"] = "(h_solidity + a_solidity) / 2"
    cols["expected_total_corners"] = (
        f"((h_cf_avg_6 + a_ca_avg_6 + a_cf_avg_6 + h_ca_avg_6) / 2) * (1 + ({vol} - 2) * 0.1)"
        f" * (1 + {clash} * 0.05) * {seasonal}")
    cols["corner_advantage_home"] = "h_cf_avg_6 - h_ca_avg_6"
    cols["corner_advantage_away"] = "a_cf_avg_6 - a_ca_avg_6"
    cols["teams_familiarity"] = "CAST(pv.fam AS DOUBLE)"
    cols["match_importance_factor"] = "1.0"
    cols["referee_corner_tendency"] = "0.0"
    cols["venue_corner_factor"] = "0.0"
    cols["rest_impact_factor"] = "0.0"
    return cols


def v3_history_ctes(src: str = "f3") -> str:
    """src -> h3 (src columns + all v3 history features)."""
    cols = ",\n    ".join(f"{e} AS {k}" for k, e in v3_columns().items())
    return f"""{team_ctes(src)},
{hw_cte(src)},
{pair_ctes(src)},
h3 AS (SELECT hw.*, {cols}
  FROM hw JOIN pv ON pv.match_id = hw.match_id)"""


def tv_columns() -> dict[str, str]:
    cols: dict[str, str] = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = f"{p}cf_avg_{n}"
            cols[f"{side}_corners_against_avg_{n}"] = f"{p}ca_avg_{n}"
        for n in (3, 6, 10):
            cols[f"{side}_goals_avg_{n}"] = f"{p}gf_avg_{n}"
            cols[f"{side}_goals_against_avg_{n}"] = f"{p}ga_avg_{n}"
        cols[f"{side}_corner_trend"] = f"{p}trend"
        cols[f"{side}_form_3"] = f"{p}form_tv_3"
        cols[f"{side}_form_6"] = f"{p}form_tv_6"
        cols[f"{side}_corner_variance_6"] = f"{p}var_6"
        cols[f"{side}_high_corner_rate_8"] = f"{p}high_rate_8"
        cols[f"{side}_low_corner_rate_8"] = f"{p}low_rate_8"
        cols[f"{side}_attacking_tendency"] = f"{p}attacking_tendency"
        cols[f"{side}_defensive_solidity"] = f"{p}solidity_tv"
        cols[f"{side}_rest_days"] = f"{p}rest_days"
    cols["h2h_avg_corners"] = "ptv.h2h_avg_corners"
    cols["h2h_matches_count"] = "ptv.h2h_matches_count"

    def pos(x, d):
        return f"(CASE WHEN {x} > 0 THEN {x} ELSE {d} END)"

    cols["expected_corners_base"] = (f"({pos('h_cf_avg_6', 5.0)} + {pos('a_ca_avg_6', 5.0)} + "
                                     f"{pos('a_cf_avg_6', 4.5)} + {pos('h_ca_avg_6', 4.5)}) / 2")
    return cols


def tv_history_ctes(src: str = "ftv2") -> str:
    cols = ",\n    ".join(f"{e} AS {k}" for k, e in tv_columns().items())
    return f"""{team_ctes(src)},
{hw_cte(src)},
{pair_ctes(src)},
htv AS (SELECT hw.*, {cols}
  FROM hw JOIN ptv ON ptv.match_id = hw.match_id)"""


def v2_columns() -> dict[str, str]:
    cols: dict[str, str] = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = f"{p}cf_avg_{n}"
            cols[f"{side}_corners_against_avg_{n}"] = f"{p}ca_avg_{n}"
        cols[f"{side}_corner_trend"] = f"{p}trend"
        cols[f"{side}_recent_form"] = f"{p}form_3"
        cols[f"{side}_corner_variance"] = f"{p}var_5"
    cols["expected_total_corners"] = "(h_cf_avg_6 + a_ca_avg_6 + a_cf_avg_6 + h_ca_avg_6) / 2"
    cols["corner_advantage_home"] = "h_cf_avg_6 - h_ca_avg_6"
    cols["corner_advantage_away"] = "a_cf_avg_6 - a_ca_avg_6"
    cols["teams_familiarity"] = "0.0"
    return cols


def v2_history_ctes(src: str = "f3") -> str:
    cols = ",\n    ".join(f"{e} AS {k}" for k, e in v2_columns().items())
    return f"""{team_ctes(src)},
{hw_cte(src)},
h2 AS (SELECT hw.*, {cols} FROM hw)"""


def v1_columns() -> dict[str, str]:
    return {
        "home_team_avg_corners_for": "h_cf_avg_5", "home_team_avg_corners_against": "h_ca_avg_5",
        "away_team_avg_corners_for": "a_cf_avg_5", "away_team_avg_corners_against": "a_ca_avg_5",
        "expected_corners_total": "h_cf_avg_5 + a_cf_avg_5",
        "corner_strength_diff": "(h_cf_avg_5 - h_ca_avg_5) - (a_cf_avg_5 - a_ca_avg_5)",
    }


def v1_history_ctes(src: str = "fv1") -> str:
    cols = ",\n    ".join(f"{e} AS {k}" for k, e in v1_columns().items())
    return f"""{team_ctes(src)},
{hw_cte(src)},
hv1 AS (SELECT hw.*, {cols} FROM hw)"""
