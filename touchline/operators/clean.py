"""Cleaning operators (filters, sentinels, imputation, dedup, winsorising).

Every global statistic (median, quantiles) is one multi-column aggregate that
returns a single row; that row is the only thing broadcast, so the broadcast
size is fixed no matter how large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import INF, nonfinite_to_null
from touchline.functions.quantiles import exact_quantiles, literal

ESSENTIAL = [
    "home_team_goal_count", "away_team_goal_count", "home_team_name", "away_team_name",
    "home_team_corner_count", "away_team_corner_count", "date_gmt",
]
ESSENTIAL_V1 = [c for c in ESSENTIAL if c != "date_gmt"]
DEDUP_KEY = ["date_gmt", "home_team_name", "away_team_name"]
# Columns added by us for determinism; the reference has no such columns, so
# no cleaning rule touches them.
ID_COLUMNS = ["match_id", "season"]
# Missing-value markers.
SENTINELS = [-1.0, -999.0, 999.0]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    skip = set(ID_COLUMNS) | set(exclude)
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float", "integer", "long", "short")
            and f.name not in skip]


# -- S6 ---------------------------------------------------------------------

def parse_dates(df: DataFrame, raw: str = "date_raw", out: str = "date_gmt") -> DataFrame:
    """String -> TIMESTAMP_NTZ; text that does not parse becomes NULL."""
    return df.withColumn(out, F.expr(f"try_cast({raw} AS TIMESTAMP_NTZ)"))


# -- C1 ---------------------------------------------------------------------

def drop_missing_essential(df: DataFrame, variant: str = "v3") -> DataFrame:
    return df.dropna(subset=ESSENTIAL_V1 if variant == "v1" else ESSENTIAL)


# -- C2 / C12 ---------------------------------------------------------------

def sentinels_to_null(df: DataFrame, columns: list[str] | None = None,
                      values=tuple(SENTINELS), infinities: bool = True) -> DataFrame:
    """Markers (and ±inf, NaN) -> NULL in every numeric column, one projection."""
    columns = numeric_columns(df) if columns is None else columns
    vals = ", ".join(f"CAST({float(v)} AS DOUBLE)" for v in values)

    def fix(name: str) -> str:
        c = f"`{name}`"
        bad = f"{c} IN ({vals})"
        if infinities:
            bad += f" OR isnan({c}) OR abs({c}) = double('Infinity')"
        return f"CASE WHEN {bad} THEN NULL ELSE {c} END AS {c}"

    return df.selectExpr(*[fix(f) if f in columns else f"`{f}`" for f in df.columns])


def inf_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    def fix(name: str) -> str:
        c = f"`{name}`"
        return f"CASE WHEN isnan({c}) OR abs({c}) = double('Infinity') THEN NULL ELSE {c} END AS {c}"

    return df.selectExpr(*[fix(f) if f in columns else f"`{f}`" for f in df.columns])


# -- C3 / C4 / C18 ----------------------------------------------------------

def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact (interpolated) median of each column."""
    return df.agg(*[F.expr(f"median(CAST(`{c}` AS DOUBLE)) AS `{c}`") for c in columns])


def fill_from_row(df: DataFrame, stats: DataFrame, columns: list[str], fallback=0.0,
                  prefix: str = "__stat_") -> DataFrame:
    """coalesce(column, value of the one-row `stats`, fallback).

    `stats` has exactly one row, so the broadcast is of fixed size.
    """
    if not columns:
        return df
    renamed = stats.selectExpr(*[f"`{c}` AS `{prefix}{c}`" for c in columns])
    joined = df.crossJoin(F.broadcast(renamed))
    out = []
    for f in df.columns:
        if f in columns:
            fb = "" if fallback is None else f", CAST({float(fallback)} AS DOUBLE)"
            out.append(f"coalesce(CAST(`{f}` AS DOUBLE), `{prefix}{f}`{fb}) AS `{f}`")
        else:
            out.append(f"`{f}`")
    return joined.selectExpr(*out)


def median_impute(df: DataFrame, columns: list[str] | None = None, exclude=tuple(ESSENTIAL)) -> DataFrame:
    """Nulls -> column median (0 if the column is all null)."""
    columns = numeric_columns(df, exclude) if columns is None else columns
    return fill_from_row(df, column_medians(df, columns), columns)


def median_impute_two_pass(df: DataFrame) -> DataFrame:
    """v1: fill medians, -1 -> NULL, fill again with the new medians (essential included)."""
    cols = numeric_columns(df)
    first = fill_from_row(df, column_medians(df, cols), cols, fallback=None)
    second = sentinels_to_null(first, cols, values=(-1.0,), infinities=False)
    return fill_from_row(second, column_medians(second, cols), cols, fallback=None)


def impute_before_encode(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """tv: numeric NULL -> median, category NULL -> 'Unknown'."""
    out = fill_medians(df, numeric)
    return out.select([F.coalesce(F.col(f), F.lit("Unknown")).alias(f) if f in categorical else F.col(f)
                       for f in out.columns])


# -- C5 ---------------------------------------------------------------------

def dedup_matches(df: DataFrame, key=tuple(DEDUP_KEY), order: str = "match_id") -> DataFrame:
    """Keep the first row (smallest match_id) of each (date, home, away) group.

    `order` is unique. The kept ids are found by a hash aggregate that is combined
    map-side, so a hot group never lands whole in one task, and the rows are picked by a
    semi-join on the id; the wide rows are not sorted or aggregated.
    """
    kept = df.groupBy(*key).agg(F.min(order).alias(order)).select(order)
    return df.join(kept, order, "left_semi").select(df.columns)


# -- C6 - C10 ---------------------------------------------------------------

def corner_range_filter(df: DataFrame, hi: float = 25.0) -> DataFrame:
    h, a = F.col("home_team_corner_count"), F.col("away_team_corner_count")
    return df.where(h.between(0, hi) & a.between(0, hi))


def coerce_numeric(c: Column | str, default=None) -> Column:
    """C17: text -> number, failures -> NULL (-> default)."""
    out = nonfinite_to_null(F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def red_card_ok(df: DataFrame) -> Column:
    if "home_team_red_cards" not in df.columns or "away_team_red_cards" not in df.columns:
        return F.lit(True)
    return (coerce_numeric("home_team_red_cards", 0) == 0) & (coerce_numeric("away_team_red_cards", 0) == 0)


def red_card_filter(df: DataFrame) -> DataFrame:
    return df.where(red_card_ok(df))


def scoreline_ok() -> Column:
    h, a = F.col("home_team_goal_count"), F.col("away_team_goal_count")
    return F.coalesce((h + a <= 15) & (h <= 10) & (a <= 10), F.lit(False))


def scoreline_filter(df: DataFrame) -> DataFrame:
    return df.where(scoreline_ok())


def possession_ok(df: DataFrame) -> Column:
    if "home_team_possession" not in df.columns or "away_team_possession" not in df.columns:
        return F.lit(True)
    h, a = F.col("home_team_possession"), F.col("away_team_possession")
    both_zero = F.coalesce((h == 0) & (a == 0), F.lit(False))
    return ~both_zero & F.coalesce((h + a).between(85, 120), F.lit(False))


def possession_filter(df: DataFrame) -> DataFrame:
    return df.where(possession_ok(df))


def shots_ok(df: DataFrame) -> Column:
    if "home_team_shots" not in df.columns or "away_team_shots" not in df.columns:
        return F.lit(True)
    h, a = F.col("home_team_shots"), F.col("away_team_shots")
    return ~F.coalesce((h == 0) & (a == 0), F.lit(False))


def shots_filter(df: DataFrame) -> DataFrame:
    return df.where(shots_ok(df))


# -- C11 --------------------------------------------------------------------

FUNNEL_STAGES = ["missing_essential", "red_cards", "unusual_scoreline", "duplicate",
                 "corner_outlier", "quality"]


def removal_funnel(raw: DataFrame) -> DataFrame:
    """tv cleaning as one tagged pass: rows removed per stage, total and %.

    Each row is tagged with the first rule it fails. The duplicate tag applies
    to rows that survived the earlier rules: the kept row of each key is found
    by a combined-map-side `min`, and joined back on match_id (unique), so no
    hot key reaches the join.
    """
    df = parse_dates(raw)
    essential_ok = F.lit(True)
    for c in ESSENTIAL:
        essential_ok = essential_ok & F.col(c).isNotNull()
    pre = (F.when(~essential_ok, F.lit("missing_essential"))
           .when(~red_card_ok(df), F.lit("red_cards"))
           .when(~scoreline_ok(), F.lit("unusual_scoreline")))
    tagged = df.withColumn("__pre", pre)
    survivors = tagged.where(F.col("__pre").isNull())
    kept = survivors.groupBy(*DEDUP_KEY).agg(F.min("match_id").alias("match_id")) \
        .select("match_id", F.lit(True).alias("__first"))
    s = sentinels_to_null(survivors.drop("__pre"))
    s = s.join(kept, "match_id", "left")
    h, a = F.col("home_team_corner_count"), F.col("away_team_corner_count")
    later = (F.when(F.col("__first").isNull(), F.lit("duplicate"))
             .when(~F.coalesce(h.between(0, 36) & a.between(0, 36), F.lit(False)), F.lit("corner_outlier"))
             .when(~(possession_ok(s) & shots_ok(s)), F.lit("quality")))
    stage_of_row = tagged.where(F.col("__pre").isNotNull()).select(F.col("__pre").alias("stage")) \
        .unionByName(s.select(later.alias("stage")))
    # one pass: rows kept have a null stage, so the counts hold the initial number and the total as well
    one = stage_of_row.agg(
        F.count(F.lit(1)).alias("initial"), F.count("stage").alias("total"),
        *[F.count_if(F.col("stage") == s_).alias(s_) for s_ in FUNNEL_STAGES])
    stages = [*FUNNEL_STAGES, "total"]
    out = one.selectExpr("initial", f"stack({len(stages)}, " + ", ".join(
        f"{i + 1}, '{s_}', `{s_}`" for i, s_ in enumerate(stages)) + ") AS (step, stage, removed)")
    return out.select("step", "stage", "removed", "initial",
                      F.when(F.col("initial") > 0, F.col("removed") * 100.0 / F.col("initial"))
                      .otherwise(F.lit(0.0)).alias("removed_pct"))


# -- C13 / C14 / C15 / C16 --------------------------------------------------

def iqr_winsorise(df: DataFrame, columns: list[str], k: float = 2.5) -> DataFrame:
    """Clip to [Q1 - k*IQR, Q3 + k*IQR], then NULL -> median (0 if all NULL).

    Clipping cannot move the median, so one set of quantiles is enough.
    """
    if not columns:
        return df
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    out = []
    for f in df.columns:
        if f not in columns:
            out.append(f"`{f}`")
        elif q[f][0] is None:
            out.append(f"0.0D AS `{f}`")
        else:
            q1, median, q3 = q[f]
            lo, hi = literal(q1 - k * (q3 - q1)), literal(q3 + k * (q3 - q1))
            clipped = f"CASE WHEN `{f}` IS NOT NULL THEN least(greatest(`{f}`, {lo}), {hi}) END"
            out.append(f"coalesce({clipped}, {literal(median)}) AS `{f}`")
    return df.selectExpr(*out)


def fill_medians(df: DataFrame, columns: list[str], fallback: float = 0.0) -> DataFrame:
    """NULL -> the column's exact median (`fallback` if it has no value)."""
    q = exact_quantiles(df, columns, [0.5])
    return df.selectExpr(*[
        f"coalesce(CAST(`{f}` AS DOUBLE), {literal(fallback if q[f][0] is None else q[f][0])}) AS `{f}`"
        if f in q else f"`{f}`" for f in df.columns])


def pct_winsorise(df: DataFrame, columns: list[str]) -> DataFrame:
    """v1: NULL -> median (0 if none), then clip to [P1, P99] of the filled column."""
    if not columns:
        return df
    filled = fill_medians(inf_to_null(df, columns), columns)
    q = exact_quantiles(filled, columns, [0.01, 0.99])
    return filled.selectExpr(*[
        f"least(greatest(`{f}`, {literal(q[f][0])}), {literal(q[f][1])}) AS `{f}`"
        if f in q and q[f][0] is not None else f"`{f}`" for f in filled.columns])


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL / NaN / inf -> 0."""
    return df.select([F.coalesce(nonfinite_to_null(F.col(f)), F.lit(0.0)).alias(f) if f in columns
                      else F.col(f) for f in df.columns])


def nonfinite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, has_inf, inf_count) for every column, via one aggregate + stack."""
    agg = df.agg(*[F.sum((F.abs(F.col(c)) == F.lit(INF)).cast("bigint")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return agg.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, inf_count)") \
        .select("column_name", F.coalesce("inf_count", F.lit(0)).cast("bigint").alias("inf_count"),
                F.coalesce(F.col("inf_count") > 0, F.lit(False)).cast("int").alias("has_inf"))


# -- C19 --------------------------------------------------------------------

def skip_warmup(df: DataFrame, n: int = 30, date: str = "date_gmt", order_id: str = "match_id", keys: DataFrame | None = None) -> DataFrame:
    """Drop the first n rows in (date, match_id) order (missing dates sort last).

    The n-th key comes from a top-n (`orderBy.limit`, partial top-k per
    partition), so no global window or full sort is planned. `keys`: dates and ids of the same
    rows, for a df that is costly to read twice.
    """
    if n <= 0:
        return df
    key = F.struct(F.coalesce(F.col(date), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("d"),
                   F.col(order_id).alias("i"))
    firsts = (df if keys is None else keys).select(key.alias("__k")).orderBy(F.col("__k.d"), F.col("__k.i")).limit(n)
    cutoff = firsts.agg(F.max("__k").alias("__cut"))
    return df.crossJoin(F.broadcast(cutoff)).where(key > F.col("__cut")).drop("__cut")
