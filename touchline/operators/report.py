"""Descriptive report aggregates (A1-A10).

Each report is one aggregate (map-side partial aggregation, one small
result); percentages divide by a total computed in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import flag

# Report ranges (inclusive) and their labels.
CORNER_RANGES = [(0, 6, "0-6"), (7, 9, "7-9"), (10, 12, "10-12"), (13, 15, "13-15"), (16, 100, "16+")]
# v1's over/under report lines.
V1_REPORT_LINES = [8.5, 9.5, 10.5, 11.5, 12.5, 13.5]


def dataset_info(df: DataFrame) -> DataFrame:
    """A1: rows, first / last date, distinct teams over both columns."""
    teams = df.select(F.explode(F.array("home_team_name", "away_team_name")).alias("t")) \
        .agg(F.count_distinct("t").alias("n_teams"))
    info = df.agg(F.count(F.lit(1)).alias("n_matches"),
                  F.date_format(F.min("date_gmt"), "yyyy-MM-dd").alias("first_date"),
                  F.date_format(F.max("date_gmt"), "yyyy-MM-dd").alias("last_date"))
    return info.crossJoin(teams)


def corner_stats(df: DataFrame, c: str = "total_corners") -> DataFrame:
    """A2: mean, median, mode (smallest on ties), sample std, min, max."""
    x = F.col(c)
    return df.agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.mode(x, True).alias("mode"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def corner_ranges(df: DataFrame, c: str = "total_corners") -> DataFrame:
    """A3: count and % in each inclusive range (one aggregate, then stack)."""
    x = F.col(c)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for lo, hi, label in CORNER_RANGES:
        aggs.append(F.sum(flag((x >= lo) & (x <= hi))).cast("bigint").alias(f"r{lo}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{label}', {lo}, {hi}, r{lo}" for lo, hi, label in CORNER_RANGES)
    out = one.selectExpr("__n", f"stack({len(CORNER_RANGES)}, {stack}) AS (range_label, low, high, n)")
    return out.select("range_label", F.col("low").cast("int"), F.col("high").cast("int"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                      F.when(F.col("__n") > 0, F.coalesce("n", F.lit(0)) * 100.0 / F.col("__n")).alias("pct"))


def corner_histogram(df: DataFrame, c: str = "total_corners") -> DataFrame:
    """A4: count and % for each exact value (total via a window over the small result)."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(
        "value", "n", (F.col("n") * 100.0 / F.col("__t")).alias("pct"))


def over_under_rates(df: DataFrame, lines, c: str = "total_corners") -> DataFrame:
    """A5: over% / under% per line in one pass (no row explosion)."""
    x = F.col(c)
    one = df.agg(*[F.avg(flag(x > L).cast("double")).alias(f"l{i}") for i, L in enumerate(lines)])
    stack = ", ".join(f"CAST({L} AS DOUBLE), l{i}" for i, L in enumerate(lines))
    out = one.selectExpr(f"stack({len(lines)}, {stack}) AS (line, rate)")
    return out.select("line", (F.col("rate") * 100).alias("over_pct"), (100 - F.col("rate") * 100).alias("under_pct"))


def home_away_corners(df: DataFrame) -> DataFrame:
    """Mean per side, advantage, who won the corner count."""
    h, a = F.col("home_team_corner_count"), F.col("away_team_corner_count")
    n = F.count(F.lit(1))
    one = df.agg(F.avg(h).alias("home_avg"), F.avg(a).alias("away_avg"), n.alias("n"),
                 F.sum(flag(h > a)).cast("bigint").alias("home_more"),
                 F.sum(flag(a > h)).cast("bigint").alias("away_more"),
                 F.sum(flag(h == a)).cast("bigint").alias("equal"))
    return one.select("home_avg", "away_avg", (F.col("home_avg") - F.col("away_avg")).alias("home_advantage"),
                      "home_more", "away_more", "equal",
                      (F.col("home_more") * 100.0 / F.col("n")).alias("home_more_pct"),
                      (F.col("away_more") * 100.0 / F.col("n")).alias("away_more_pct"),
                      (F.col("equal") * 100.0 / F.col("n")).alias("equal_pct"))


def class_balance(df: DataFrame, targets: list[str]) -> DataFrame:
    """A7 + A8: positive rate, scale_pos_weight and class count per target flag."""
    one = df.agg(*[x for t in targets for x in (
        F.avg(F.col(t).cast("double")).alias(f"p_{t}"),
        # the flags are 0 / 1, so their classes are counted by their extremes
        F.when(F.min(t) < F.max(t), 2).otherwise(F.least(F.count(t), F.lit(1))).cast("bigint").alias(f"k_{t}"))])
    stack = ", ".join(f"'{t}', p_{t}, k_{t}" for t in targets)
    out = one.selectExpr(f"stack({len(targets)}, {stack}) AS (target, positive_rate, n_classes)")
    p = F.col("positive_rate")
    return out.select("target", p.alias("positive_rate"),
                      F.when(p > 0, (1 - p) / p).otherwise(F.lit(1.0)).alias("scale_pos_weight"),
                      F.col("n_classes").cast("bigint").alias("n_classes"),
                      (F.col("n_classes") >= 2).cast("int").alias("trainable"))


def frequent_teams(df: DataFrame, min_count: int = 10, top: int = 50) -> DataFrame:
    """Home-name counts >= min_count, top `top` (count desc, name asc);
    other names -> 'Other' in both columns. The kept list has at most `top`
    rows, so broadcasting it is safe."""
    keep = (df.groupBy("home_team_name").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count)
            .orderBy(F.col("n").desc(), F.col("home_team_name").asc()).limit(top)
            .select(F.col("home_team_name").alias("__t")))
    keep = F.broadcast(keep)
    out = df.join(keep.withColumnRenamed("__t", "__h"), F.col("home_team_name") == F.col("__h"), "left") \
        .join(keep.withColumnRenamed("__t", "__a"), F.col("away_team_name") == F.col("__a"), "left")
    return out.withColumns({
        "home_team_group": F.coalesce(F.col("__h"), F.lit("Other")),
        "away_team_group": F.coalesce(F.col("__a"), F.lit("Other")),
    }).drop("__h", "__a")


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """A10: how many candidate features exist and which rows remain."""
    return df.agg(F.lit(len(features)).cast("int").alias("n_features"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.date_format(F.min("date_gmt"), "yyyy-MM-dd").alias("first_date"),
                  F.date_format(F.max("date_gmt"), "yyyy-MM-dd").alias("last_date"))
