"""Per-team and head-to-head history features, with no look-ahead.

The reference walks the matches in date order and keeps per-team lists. Here
the same values come from window frames over a long table with one row per
(match, side):

* Each team row gets its exact position in the team's history
  (`sequence_position`): per-(team, date) counts are summed over the small
  count table, plus a rank inside the (team, date) group. No window ever holds
  a whole team.
* Rows are cut into chunks of `chunk_rows` positions per team; every chunk also
  receives the last `HALO` rows of the chunk before it. All team frames look at
  most `HALO` rows back, so a frame over (team, chunk) is exact, and a team
  holding a third of all rows is spread over many tasks.
* Head-to-head frames are partitioned by team pair. After de-duplication on
  (date, home, away) a pair has at most two rows per calendar day, so those
  partitions are bounded by the calendar, not by the data size.

The minimum-history rule (a feature is 0.0 until the team has N prior
matches) is `when(prior >= N, ...)`, prior being the position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.features import seasonal_factor_col

HALO = 10  # the longest look-back of any team frame (rows)
DEFAULT_CHUNK_ROWS = 1_000_000
FAR_FUTURE = "9999-12-31 00:00:00"


# -- W0 ---------------------------------------------------------------------

def team_long(df: DataFrame) -> DataFrame:
    """match -> 2 team rows (home, away) sharing one history per team."""
    hc, ac = F.col("home_team_corner_count"), F.col("away_team_corner_count")
    hg, ag = F.col("home_team_goal_count"), F.col("away_team_goal_count")
    total = hc + ac

    def side(name, team, opp, cf, ca, gf, ga):
        return F.struct(
            F.lit(name).alias("side"), F.col(team).alias("team"), F.col(opp).alias("opponent"),
            cf.alias("corners_for"), ca.alias("corners_against"),
            gf.alias("goals_for"), ga.alias("goals_against"),
        )

    sides = F.array(
        side("home", "home_team_name", "away_team_name", hc, ac, hg, ag),
        side("away", "away_team_name", "home_team_name", ac, hc, ag, hg),
    )
    long = df.select("match_id", "date_gmt", total.alias("match_total"), F.explode(sides).alias("s")) \
        .select("match_id", "date_gmt", "match_total", "s.*")
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return long.withColumns({
        # v2/v3: a missing goal makes both comparisons false -> 0 for both teams
        "result": F.when(gf > ga, 1.0).when(gf == ga, 0.5).otherwise(0.0),
        # tv: a missing goal falls through to a draw
        "result_tv": F.when(gf > ga, 1.0).when(gf < ga, 0.0).otherwise(0.5),
        "__d": F.coalesce(F.col("date_gmt"), F.lit(FAR_FUTURE).cast("timestamp_ntz")),
    })


def sequence_position(df: DataFrame, keys: list[str], date: str = "__d", order: str = "match_id",
                      out: str = "prior") -> DataFrame:
    """0-based position of each row in (date, order) order within `keys`.

    The running sum runs over the per-(keys, date) count table, which has one
    row per key and day; the rank runs inside one (keys, date) group. The
    join and the rank window share the (keys, date) partitioning.
    """
    counts = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, date, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    in_day = Window.partitionBy(*keys, date).orderBy(order)
    return (df.join(offsets, [*keys, date])
            .withColumn(out, (F.col("__off") + F.row_number().over(in_day) - 1).cast("bigint"))
            .drop("__off"))


def with_halo_chunks(df: DataFrame, pos: str = "prior", chunk_rows: int = DEFAULT_CHUNK_ROWS,
                     halo: int = HALO) -> DataFrame:
    """Add `__chunk`; rows near the end of a chunk are copied into the next one
    with `__halo` = true (at most one extra copy per row, as halo < chunk)."""
    if halo >= chunk_rows:
        raise ValueError("chunk_rows must exceed the look-back")
    c = (F.col(pos) / F.lit(chunk_rows)).cast("bigint")
    copies = F.when((F.col(pos) % chunk_rows) >= chunk_rows - halo,
                    F.array(F.struct(c.alias("c"), F.lit(False).alias("h")),
                            F.struct((c + 1).alias("c"), F.lit(True).alias("h")))) \
        .otherwise(F.array(F.struct(c.alias("c"), F.lit(False).alias("h"))))
    return df.withColumn("__cp", F.explode(copies)) \
        .withColumn("__chunk", F.col("__cp.c")).withColumn("__halo", F.col("__cp.h")).drop("__cp")


W_TEAM = "PARTITION BY team, __chunk ORDER BY prior"


def _fr(n: int, m: int = 1) -> str:
    """SQL window over the team chunk: rows n..m before the current one."""
    return f"OVER ({W_TEAM} ROWS BETWEEN {n} PRECEDING AND {m} PRECEDING)"


def _all_present(c: str, n: int) -> str:
    """np.mean over the last n: NULL (NaN) if any of them is missing."""
    return f"CASE WHEN count({c}) {_fr(n)} = {n} THEN avg({c}) {_fr(n)} END"


def _var_pop(c: str, n: int) -> str:
    """Population variance of the last n as (sum(x^2) - sum(x)^2 / n) / n.

    For count data (corners) both sums are exact integers, so the result does
    not depend on the order in which an engine adds the frame up.
    """
    return f"((sum({c} * {c}) {_fr(n)} - sum({c}) {_fr(n)} * sum({c}) {_fr(n)} / {n}) / {n})"


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({W_TEAM})"


# name -> (minimum prior matches, expression, value before that)
def _side_expressions() -> dict[str, tuple[int, str, float]]:
    cf, ca = "corners_for", "corners_against"
    out: dict[str, tuple[int, str, float]] = {}
    for n in (3, 5, 6, 10):
        out[f"cf_avg_{n}"] = (n, f"avg({cf}) {_fr(n)}", 0.0)
        out[f"ca_avg_{n}"] = (n, f"avg({ca}) {_fr(n)}", 0.0)
    for n in (3, 6, 10):
        out[f"gf_avg_{n}"] = (n, _all_present("goals_for", n), 0.0)
        out[f"ga_avg_{n}"] = (n, _all_present("goals_against", n), 0.0)
    out["trend"] = (6, f"avg({cf}) {_fr(3)} - avg({cf}) {_fr(6, 4)}", 0.0)
    out["form_3"] = (3, f"avg(result) {_fr(3)}", 0.0)
    out["form_tv_3"] = (3, f"avg(result_tv) {_fr(3)}", 0.0)
    out["form_tv_6"] = (6, f"avg(result_tv) {_fr(6)}", 0.0)
    out["var_5"] = (5, _var_pop(cf, 5), 0.0)
    out["var_6"] = (6, _var_pop(cf, 6), 0.0)
    # weights .4 .3 .2 .1 zipped with the last four, oldest first
    out["momentum"] = (4, f"0.4 * {_lag(cf, 4)} + 0.3 * {_lag(cf, 3)} + 0.2 * {_lag(cf, 2)} + 0.1 * {_lag(cf, 1)}",
                       0.0)
    out["high_rate_8"] = (8, f"sum(CASE WHEN match_total >= 12 THEN 1 ELSE 0 END) {_fr(8)} / 8.0D", 0.0)
    out["low_rate_8"] = (8, f"sum(CASE WHEN match_total <= 8 THEN 1 ELSE 0 END) {_fr(8)} / 8.0D", 0.0)
    out["consistency"] = (6, f"1.0 / (1.0 + {_var_pop(cf, 5)})", 0.0)
    out["goal_diff_5"] = (5, f"({_all_present('goals_for', 5)}) - ({_all_present('goals_against', 5)})", 0.0)
    out["solidity"] = (5, f"1.0 / (1.0 + avg({ca}) {_fr(5)})", 0.5)
    out["solidity_tv"] = (5, f"1.0 / (1.0 + avg({ca}) {_fr(5)})", 0.0)
    out["attacking_tendency"] = (5, f"avg({cf}) {_fr(5)}", 0.0)
    # whole 24-hour days between kick-offs
    out["rest_days"] = (1, f"CAST(least(timestampdiff(SECOND, {_lag('date_gmt', 1)}, date_gmt) DIV 86400, 30) AS DOUBLE)",
                        0.0)
    return out


def team_history(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, features=None) -> DataFrame:
    """Per (match, side): the per-team history values `features` (None: those used by any variant).

    All frames are bounded (at most HALO rows back) and share one window
    partitioning (team, chunk) and order (prior), so Spark plans one sort and
    one window pass over each chunk.
    """
    long = sequence_position(team_long(df), ["team"])
    t = with_halo_chunks(long, "prior", chunk_rows)
    exprs = _side_expressions()
    wanted = list(exprs) if features is None else [f for f in features if f in exprs]
    cols = [f"CASE WHEN prior >= {exprs[k][0]} THEN CAST({exprs[k][1]} AS DOUBLE) ELSE {exprs[k][2]}D END AS {k}"
            for k in wanted]
    return t.selectExpr("*", *cols).where(~F.col("__halo")).drop("__halo", "__chunk", "__d")


SIDE_FEATURES = [
    "prior", "cf_avg_3", "cf_avg_5", "cf_avg_6", "cf_avg_10", "ca_avg_3", "ca_avg_5", "ca_avg_6", "ca_avg_10",
    "gf_avg_3", "gf_avg_6", "gf_avg_10", "ga_avg_3", "ga_avg_6", "ga_avg_10", "trend", "form_3",
    "form_tv_3", "form_tv_6", "var_5", "var_6", "momentum", "high_rate_8", "low_rate_8", "consistency",
    "goal_diff_5", "solidity", "solidity_tv", "attacking_tendency", "rest_days",
]


def sides_wide(hist: DataFrame, features=tuple(SIDE_FEATURES)) -> DataFrame:
    """Team rows back to one row per match: columns h_<f>, a_<f>."""
    # the team rows are shuffled, not partial rows of twice their width; one primitive per aggregate, so the pivot is a hash aggregate
    return hist.select("match_id", "side", *features).repartition("match_id").groupBy("match_id").agg(*[
        F.expr(f"max(CASE WHEN side = '{side}' THEN `{f}` END) AS `{side[0]}_{f}`")
        for side in ("home", "away") for f in features])


# -- W10 / W11 / W12: head-to-head -------------------------------------------

def pair_history(df: DataFrame) -> DataFrame:
    """Per match: familiarity, same/reverse head-to-head means, tv pruned lists."""
    h, a = F.col("home_team_name"), F.col("away_team_name")
    base = df.select("match_id", "date_gmt", "home_team_name", "away_team_name",
                     (F.col("home_team_corner_count") + F.col("away_team_corner_count")).alias("tot"),
                     F.least(h, a).alias("p_lo"), F.greatest(h, a).alias("p_hi"),
                     (h < a).alias("o"))
    same = Window.partitionBy("home_team_name", "away_team_name").orderBy("date_gmt", "match_id")
    pair = Window.partitionBy("p_lo", "p_hi").orderBy("date_gmt", "match_id")
    before = pair.rowsBetween(Window.unboundedPreceding, -1)
    last5y = ("count(1) OVER (PARTITION BY home_team_name, away_team_name ORDER BY date_gmt "
              "RANGE BETWEEN INTERVAL 5 YEARS PRECEDING AND CURRENT ROW)")
    s1 = base.select(
        "*",
        F.avg("tot").over(same.rowsBetween(-3, -1)).alias("same_avg3"),
        F.avg("tot").over(same.rowsBetween(-2, 0)).alias("avg3_after"),
        F.expr(last5y).alias("len5"),
        F.lag("tot", 1).over(same).alias("t1"), F.lag("tot", 2).over(same).alias("t2"),
    )
    # state of this orientation's pruned list right after this meeting: (len, newest three)
    state = F.struct(F.col("len5").alias("n"), F.col("tot").alias("e0"),
                     F.when(F.col("len5") >= 2, F.col("t1")).alias("e1"),
                     F.when(F.col("len5") >= 3, F.col("t2")).alias("e2"))
    # one exchange for the ordered-pair frames above, one for the unordered-pair frames below
    s2 = s1.select(
        "*",
        (F.row_number().over(pair) - 1).cast("double").alias("familiarity"),
        F.last(F.when(F.col("o"), F.col("avg3_after")), ignorenulls=True).over(before).alias("last_o1"),
        F.last(F.when(~F.col("o"), F.col("avg3_after")), ignorenulls=True).over(before).alias("last_o0"),
        F.last(F.when(F.col("o"), state), ignorenulls=True).over(before).alias("st_o1"),
        F.last(F.when(~F.col("o"), state), ignorenulls=True).over(before).alias("st_o0"),
    )
    rev_avg = F.when(F.col("o"), F.col("last_o0")).otherwise(F.col("last_o1"))
    same_state = F.when(F.col("o"), F.col("st_o1")).otherwise(F.col("st_o0"))
    rev_state = F.when(F.col("o"), F.col("st_o0")).otherwise(F.col("st_o1"))

    def newest(st: Column) -> Column:
        n = F.coalesce(st["n"], F.lit(0))
        arr = F.array(st["e0"], st["e1"], st["e2"])
        return F.when(n > 0, F.slice(arr, 1, F.least(n, F.lit(3)).cast("int"))) \
            .otherwise(F.array().cast("array<double>"))

    # same ++ reverse (not re-sorted): the last three are the reverse list's newest first
    last3 = F.slice(F.concat(newest(rev_state), newest(same_state)), 1, 3)
    n_all = F.coalesce(same_state["n"], F.lit(0)) + F.coalesce(rev_state["n"], F.lit(0))
    mean3 = F.aggregate(last3, F.lit(0.0), lambda acc, x: acc + x) / F.size(last3)
    return s2.select(
        "match_id",
        "familiarity",
        F.coalesce(F.col("same_avg3"), rev_avg, F.lit(0.0)).alias("h2h_corner_history"),
        F.when(n_all > 0, mean3).otherwise(F.lit(0.0)).alias("h2h_avg_corners"),
        n_all.cast("double").alias("h2h_matches_count"),
    )


# -- assembled feature sets per variant --------------------------------------

PAIR_FEATURES = ["familiarity", "h2h_corner_history", "h2h_avg_corners", "h2h_matches_count"]


def side_features_of(cols: dict[str, Column]) -> dict[str, set[str]]:
    """Output -> the side features (h_<f>, a_<f>) and pair features that its expression reads."""
    return {name: (set(re.findall(r"\b[ha]_(\w+)", str(v))) & set(SIDE_FEATURES)) | (set(re.findall(r"\w+", str(v))) & set(PAIR_FEATURES))
            for name, v in cols.items()}


def _assembled(df: DataFrame, cols: dict[str, Column], chunk_rows: int, wanted: Iterable[str] | None,
               keep: list[str]) -> DataFrame:
    """`keep` of df and the outputs `wanted` (None: all), with no more history than these need: only the side features that they
    read are computed, the team windows are left out if there are none, and so are the pair windows."""
    paired = set().union(*side_features_of(cols).values()) & set(PAIR_FEATURES)
    if wanted is not None:
        wanted = set(wanted)
        cols, keep = {k: v for k, v in cols.items() if k in wanted}, [f for f in keep if f in wanted or f == "match_id"]
    used = set().union(*side_features_of(cols).values())
    sides = [f for f in SIDE_FEATURES if f in used]
    x = df
    if sides:
        x = x.join(sides_wide(team_history(df, chunk_rows, sides), tuple(sides)), "match_id")
    if used & set(PAIR_FEATURES):
        x = x.join(pair_history(df).select("match_id", *[f for f in PAIR_FEATURES if f in used]), "match_id")
    elif paired:
        # of a repeated match_id, the pair windows would give each row one for each of its repeats
        times = df.groupBy("match_id").agg(F.count(F.lit(1)).cast("int").alias("__times"))
        x = x.join(times, "match_id").withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("__times"))))
    return x.select(*keep, *[v.alias(k) for k, v in cols.items()])


def history_features_v3(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                        wanted: Iterable[str] | None = None) -> DataFrame:
    """W1, W4-W11, W14-W17, W19, W21 plus F21 / F22 (chatbot and v3)."""
    c = F.col
    cols = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = c(f"{p}cf_avg_{n}")
            cols[f"{side}_corners_against_avg_{n}"] = c(f"{p}ca_avg_{n}")
        cols[f"{side}_corner_trend"] = c(f"{p}trend")
        cols[f"{side}_recent_form"] = c(f"{p}form_3")
        cols[f"{side}_corner_variance"] = c(f"{p}var_5")
        cols[f"corner_momentum_{side}"] = c(f"{p}momentum")
        cols[f"{side}_high_corner_rate"] = c(f"{p}high_rate_8")
        cols[f"{side}_low_corner_rate"] = c(f"{p}low_rate_8")
        cols[f"{side}_corner_consistency"] = c(f"{p}consistency")
    hf, ha, af, aa = c("h_cf_avg_6"), c("h_ca_avg_6"), c("a_cf_avg_6"), c("a_ca_avg_6")
    vol = (c("h_var_5") + c("a_var_5")) / 2
    clash = F.abs((hf - ha) - (af - aa))
    seasonal = seasonal_factor_col(c("date_gmt"))
    cols["combined_corner_volatility"] = vol
    cols["h2h_corner_history"] = c("h2h_corner_history")
    cols["style_clash_indicator"] = clash
    cols["seasonal_corner_adjustment"] = seasonal
    cols["attacking_desperation_factor"] = F.greatest(
        F.lit(0.0), (2 - c("h_goal_diff_5")) + (2 - c("a_goal_diff_5"))) / 4
    cols["defensive_solidity_factor"] = (c("h_solidity") + c("a_solidity")) / 2
    cols["expected_total_corners"] = ((hf + aa + af + ha) / 2) * (1 + (vol - 2) * 0.1) * (1 + clash * 0.05) * seasonal
    cols["corner_advantage_home"] = hf - ha
    cols["corner_advantage_away"] = af - aa
    cols["teams_familiarity"] = c("familiarity")
    cols["match_importance_factor"] = F.lit(1.0)
    cols["referee_corner_tendency"] = F.lit(0.0)
    cols["venue_corner_factor"] = F.lit(0.0)
    cols["rest_impact_factor"] = F.lit(0.0)
    return _assembled(df, cols, chunk_rows, wanted, df.columns)


def history_features_v2(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                        wanted: Iterable[str] | None = None) -> DataFrame:
    """v2: W1, W4, W5, W6, base expected total, W21; familiarity stays 0."""
    c = F.col
    cols = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = c(f"{p}cf_avg_{n}")
            cols[f"{side}_corners_against_avg_{n}"] = c(f"{p}ca_avg_{n}")
        cols[f"{side}_corner_trend"] = c(f"{p}trend")
        cols[f"{side}_recent_form"] = c(f"{p}form_3")
        cols[f"{side}_corner_variance"] = c(f"{p}var_5")
    hf, ha, af, aa = c("h_cf_avg_6"), c("h_ca_avg_6"), c("a_cf_avg_6"), c("a_ca_avg_6")
    cols["expected_total_corners"] = (hf + aa + af + ha) / 2
    cols["corner_advantage_home"] = hf - ha
    cols["corner_advantage_away"] = af - aa
    cols["teams_familiarity"] = F.lit(0.0)
    return _assembled(df, cols, chunk_rows, wanted, df.columns)


def history_features_tv(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                        wanted: Iterable[str] | None = None) -> DataFrame:
    """tv: W1, W3, W4, W5 (3, 6), W6 (6), W8, W12, W13, W17, W18, W20."""
    c = F.col
    cols = {}
    for side, p in (("home", "h_"), ("away", "a_")):
        for n in (3, 6, 10):
            cols[f"{side}_corners_avg_{n}"] = c(f"{p}cf_avg_{n}")
            cols[f"{side}_corners_against_avg_{n}"] = c(f"{p}ca_avg_{n}")
        for n in (3, 6, 10):
            cols[f"{side}_goals_avg_{n}"] = c(f"{p}gf_avg_{n}")
            cols[f"{side}_goals_against_avg_{n}"] = c(f"{p}ga_avg_{n}")
        cols[f"{side}_corner_trend"] = c(f"{p}trend")
        cols[f"{side}_form_3"] = c(f"{p}form_tv_3")
        cols[f"{side}_form_6"] = c(f"{p}form_tv_6")
        cols[f"{side}_corner_variance_6"] = c(f"{p}var_6")
        cols[f"{side}_high_corner_rate_8"] = c(f"{p}high_rate_8")
        cols[f"{side}_low_corner_rate_8"] = c(f"{p}low_rate_8")
        cols[f"{side}_attacking_tendency"] = c(f"{p}attacking_tendency")
        cols[f"{side}_defensive_solidity"] = c(f"{p}solidity_tv")
        cols[f"{side}_rest_days"] = c(f"{p}rest_days")
    cols["h2h_avg_corners"] = c("h2h_avg_corners")
    cols["h2h_matches_count"] = c("h2h_matches_count")

    def pos_or(x_: Column, d: float) -> Column:
        return F.when(x_ > 0, x_).otherwise(F.lit(d))

    cols["expected_corners_base"] = (pos_or(c("h_cf_avg_6"), 5.0) + pos_or(c("a_ca_avg_6"), 5.0)
                                     + pos_or(c("a_cf_avg_6"), 4.5) + pos_or(c("h_ca_avg_6"), 4.5)) / 2
    return _assembled(df, cols, chunk_rows, wanted, [f for f in df.columns if f not in cols])


def history_features_v1(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                        wanted: Iterable[str] | None = None) -> DataFrame:
    """v1: W2 (last 5, for / against) and W22."""
    c = F.col
    hf, ha, af, aa = c("h_cf_avg_5"), c("h_ca_avg_5"), c("a_cf_avg_5"), c("a_ca_avg_5")
    cols = {
        "home_team_avg_corners_for": hf, "home_team_avg_corners_against": ha,
        "away_team_avg_corners_for": af, "away_team_avg_corners_against": aa,
        "expected_corners_total": hf + af,
        "corner_strength_diff": (hf - ha) - (af - aa),
    }
    return _assembled(df, cols, chunk_rows, wanted, df.columns)


__all__ = [
    "team_long", "sequence_position", "with_halo_chunks", "team_history", "sides_wide", "pair_history",
    "history_features_v1", "history_features_v2", "history_features_v3", "history_features_tv",
]
