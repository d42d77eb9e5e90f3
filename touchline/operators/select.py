"""Feature scoring, selection and encoding (K2, M1-M8).

Every score is one aggregate over the (wide) feature matrix that returns one
small row per feature; nothing per-row reaches the driver. Mutual information
comes from contingency tables that each task counts over its columns as arrays,
so no row is widened and only counts are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.quantiles import exact_quantiles

DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _stack(df: DataFrame, keep: list[str], pairs: dict[str, str], names=("feature", "value")) -> DataFrame:
    body = ", ".join(f"'{k}', {v}" for k, v in pairs.items())
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(pairs)}, {body}) AS ({names[0]}, {names[1]})")


def f_regression_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """M1: F = r^2 / (1 - r^2) * (n - 2), r the Pearson correlation with the target (NULL when a side is constant)."""
    y = F.col(target).cast("double")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[
        # not corr(), which fails on a constant side
        F.try_divide(F.covar_pop(f, y), F.nullif(F.stddev_pop(f) * F.stddev_pop(y), F.lit(0.0))).alias(f"r_{f}")
        for f in features])
    long = _stack(one, ["__n"], {f: f"`r_{f}`" for f in features}, ("feature", "r"))
    r2 = F.col("r") * F.col("r")
    return long.select("feature", "r", F.when(r2 < 1, r2 / (1 - r2) * (F.col("__n") - 2)).alias("f_score"))


def f_classif_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """M2: one-way ANOVA F of each feature across the two classes of `target`."""
    y = F.col(target)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("n1")]
    for f in features:
        one_x, zero_x = F.when(y == 1, F.col(f)), F.when(y != 1, F.col(f))
        aggs += [F.avg(f).alias(f"m_{f}"), F.avg(one_x).alias(f"m1_{f}"), F.avg(zero_x).alias(f"m0_{f}"),
                 F.var_pop(one_x).alias(f"v1_{f}"), F.var_pop(zero_x).alias(f"v0_{f}")]
    body = ", ".join(f"'{f}', `m_{f}`, `m1_{f}`, `m0_{f}`, `v1_{f}`, `v0_{f}`" for f in features)
    long = df.agg(*aggs).selectExpr("n", "n1", f"stack({len(features)}, {body}) AS (feature, m, m1, m0, v1, v0)")
    n, n1 = F.col("n"), F.col("n1")
    none = F.lit(0.0)
    ss_between = (n1 * F.coalesce((F.col("m1") - F.col("m")) ** 2, none)
                  + (n - n1) * F.coalesce((F.col("m0") - F.col("m")) ** 2, none))
    ss_within = n1 * F.coalesce("v1", none) + (n - n1) * F.coalesce("v0", none)
    return long.select("feature", F.when((ss_within > 0) & (n > 2), ss_between / (ss_within / (n - 2))).alias("f_score"))


def _nine_decimals(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


def contingency(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(target, feature, bin, y, n): how many rows have feature bin 0..9 and target value y.

    Bins are the feature's exact deciles: the number of cut points below the value, 0 for a missing one. Cut points and
    values are compared at 9 decimals, so an interpolated cut that lands on a data value gives the same bin whatever the
    engine's last bit. One pass over the wide matrix in Arrow batches: a task bins each column as an array, counts the pairs of bins and
    target values, and sends its counts once, at most features x bins x distinct target values rows; no row of
    the matrix is widened or shuffled."""
    cuts = exact_quantiles(df, features, DECILES)
    edges = [None if cuts[f][0] is None else _nine_decimals(np.array(cuts[f], float)) for f in features]
    bins = len(DECILES) + 1
    n_features = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[float | None, np.ndarray]] = [{} for _ in targets]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.zeros((n_features, batch.num_rows), np.int64)  # feature and bin of every value as one number
            for j, edge in enumerate(edges):
                x = batch.column(j).to_numpy(zero_copy_only=False)
                if edge is not None:
                    cells[j] = np.where(np.isnan(x), 0, np.searchsorted(edge, _nine_decimals(x), "left"))
                cells[j] += j * bins
            for t in range(len(targets)):
                y = batch.column(n_features + t).to_numpy(zero_copy_only=False)
                for value in np.unique(y).tolist():
                    rows = np.isnan(y) if math.isnan(value) else y == value
                    found = np.bincount(cells[:, rows].ravel(), minlength=n_features * bins)
                    key = None if math.isnan(value) else value
                    counts[t][key] = counts[t].get(key, 0) + found
        out = [(t, *divmod(int(c), bins), y, int(own[c])) for t, by in enumerate(counts) for y, own in by.items()
               for c in np.flatnonzero(own)]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array([targets[t] for t in columns[0]], pa.string()), pa.array([features[f] for f in columns[1]], pa.string()),
             pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())],
            ["target", "feature", "bin", "y", "n"])

    wide = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*features, *targets])])
    parts = wide.mapInArrow(run, "target string, feature string, bin int, y double, n long")
    return parts.groupBy("target", "feature", "bin", "y").agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """M3 / M4 (re-aimed): discrete MI between the decile bin of each feature
    and each target, sum p(b,y) ln(p(b,y) / (p(b) p(y))), one job for all targets,
    from their contingency tables."""
    counts = contingency(df, features, targets).withColumnRenamed("n", "n_by")
    w_tf = Window.partitionBy("target", "feature")
    w_b = Window.partitionBy("target", "feature", "bin")
    w_y = Window.partitionBy("target", "feature", "y")
    c = counts.select("*", F.sum("n_by").over(w_tf).alias("n"), F.sum("n_by").over(w_b).alias("n_b"),
                      F.sum("n_by").over(w_y).alias("n_y"))
    term = (F.col("n_by") / F.col("n")) * F.ln(F.col("n_by") * F.col("n") / (F.col("n_b") * F.col("n_y")))
    return c.groupBy("target", "feature").agg(F.sum(term).alias("mi"))


def top_k_features(scores: DataFrame, k_by_target: dict[str, int], score: str = "mi") -> DataFrame:
    """K2: the k best features per target (score desc, then name)."""
    ks = scores.sparkSession.createDataFrame(list(k_by_target.items()), "target STRING, k INT")
    w = Window.partitionBy("target").orderBy(F.col(score).desc(), F.col("feature"))
    ranked = scores.select("target", "feature", score, F.row_number().over(w).alias("rank"))
    return ranked.join(F.broadcast(ks), "target").where(F.col("rank") <= F.col("k")).drop("k")


# Name fragments of "recent" features.
RECENT_KEYS = ["_3", "_6", "recent", "trend", "momentum"]


def recent_feature_subset(selected: DataFrame, min_count: int = 10) -> DataFrame:
    """M8: selected names containing a recent-key fragment; used only if > min_count."""
    pattern = "|".join(re.escape(k) for k in RECENT_KEYS)
    hits = selected.where(F.lower(F.col("feature")).rlike(pattern))
    w = Window.partitionBy("target")
    return hits.select("target", "feature", (F.count(F.lit(1)).over(w) > min_count).cast("int").alias("used"))


def fit_scale(train: DataFrame, features: list[str]) -> DataFrame:
    """One row of means and population deviations (a zero deviation counts as 1)."""
    return train.agg(*[x for f in features for x in (
        F.avg(f).alias(f"m_{f}"), F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"s_{f}"))])


def apply_scale(df: DataFrame, stats: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(x - mean) / deviation with the fitted values; `stats` is one row, so the broadcast is of fixed size."""
    j = df.crossJoin(F.broadcast(stats))
    return j.select(*keep, *[((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(f) for f in features])


def standard_scale(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """M5: (x - mean) / population std; a zero std divides by 1. Fitted on the frame itself."""
    return apply_scale(df, fit_scale(df, features), features, keep)


def _category_rows(df: DataFrame, categorical: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in categorical])
    return df.select(*keep, F.inline(pairs))


def fit_one_hot(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(column_name, category) of the indicators: the categories of the training rows, the alphabetically first dropped."""
    seen = _category_rows(train, categorical, []).distinct()
    first = seen.groupBy("column_name").agg(F.min("category").alias("first"))
    return seen.join(first, "column_name").where(F.col("category") != F.col("first")).drop("first")


def apply_one_hot(df: DataFrame, fitted: DataFrame, categorical: list[str], key: str = "match_id") -> DataFrame:
    """(key, feature) of the indicators that are 1; a category not seen in training has no row."""
    rows = _category_rows(df, categorical, [key]).join(fitted, ["column_name", "category"], "left_semi")
    return rows.select(key, F.concat_ws("_", "column_name", "category").alias("feature"))


def one_hot(df: DataFrame, categorical: list[str], key: str = "match_id") -> DataFrame:
    """M6: one indicator per category, the alphabetically first dropped; long
    form (key, feature) for the indicators that are 1. Fitted on the frame itself."""
    return apply_one_hot(df, fit_one_hot(df, categorical), categorical, key)


# Columns the tuned variant drops from its numeric list.
TV_EXCLUDE = ["total_corners", "corner_difference", "home_corner_ratio", "date_gmt", "home_win", "draw", "away_win"]
# Columns known only after the match (kept by the reference, dropped unless strict=False).
POST_MATCH = ["total_goals", "goal_difference", "high_scoring", "both_teams_scored", "home_team_possession",
              "away_team_possession", "home_team_shots", "away_team_shots"]
ID_COLUMNS = ["match_id", "season"]


def numeric_feature_list(df: DataFrame, line_targets: list[str], strict: bool = True) -> list[str]:
    """M7: numeric columns minus targets, minus names ending in `_count`."""
    skip = set(TV_EXCLUDE) | set(line_targets) | set(ID_COLUMNS)
    if strict:
        skip |= set(POST_MATCH)
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "integer", "long", "float", "short")
            and f.name not in skip and not f.name.endswith("_count")]
