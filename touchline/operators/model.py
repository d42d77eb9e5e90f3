"""Chronological splits, metrics, and model training as Spark jobs.

Splits need each match's position in date order. `global_position` gets it
without a global window or a full sort: rows are counted per day, kick-off and
id bucket; a running sum over days (one row each) and one inside each day give a
bucket's offset, and a rank inside the bucket (at most `bucket_rows` ids) finishes it.

Training uses MLlib gradient-boosted trees in place of the reference's
boosting library; fits are distributed by MLlib, only fitted models (trees,
importances - sized by the feature count) live on the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_ROWS = 1_000_000
EPS = 1e-15


def global_position(df: DataFrame, date: str = "date_gmt", order: str = "match_id",
                    bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """0-based position in (date, id) order, as column `position`; rows without a date come last.

    Only the per-day totals go through a window of one task (a row per calendar
    day, whatever the table's size); bucket offsets are summed per day."""
    day = F.coalesce(F.to_date(date), F.lit("9999-12-31").cast("date"))
    b = df.withColumns({"__d": day, "__b": (F.col(order) / F.lit(bucket_rows)).cast("bigint"),
                        "__t": F.coalesce(F.col(date), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))})
    counts = b.groupBy("__d", "__t", "__b").agg(F.count(F.lit(1)).alias("__n"))
    so_far = Window.unboundedPreceding, -1
    days = counts.groupBy("__d").agg(F.sum("__n").alias("__n")).select(
        "__d", F.coalesce(F.sum("__n").over(Window.orderBy("__d").rowsBetween(*so_far)), F.lit(0)).alias("__day_off"))
    within = Window.partitionBy("__d").orderBy("__t", "__b").rowsBetween(*so_far)
    offsets = counts.select("__d", "__t", "__b", F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__in_off")) \
        .join(days, "__d").select("__t", "__b", (F.col("__day_off") + F.col("__in_off")).alias("__off"))
    in_bucket = Window.partitionBy("__t", "__b").orderBy(order)
    return (b.drop("__d").join(offsets, ["__t", "__b"])
            .withColumn("position", (F.col("__off") + F.row_number().over(in_bucket) - 1).cast("bigint"))
            .drop("__off", "__b", "__t"))


def time_series_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """M9: expanding-window folds: test = n // (n_splits + 1) rows, train = all before.

    Output (match_id, fold, role) with role train / test.
    """
    pos = global_position(df)
    n = df.agg(F.count(F.lit(1)).alias("__total"))
    j = pos.crossJoin(F.broadcast(n))
    size = (F.col("__total") / (n_splits + 1)).cast("bigint")
    folds = F.array(*[F.lit(i) for i in range(n_splits)])
    x = j.select("match_id", "position", size.alias("__size"), "__total", F.explode(folds).alias("fold"))
    start = F.col("__total") - (n_splits - F.col("fold")) * F.col("__size")
    role = (F.when(F.col("position") < start, "train")
            .when(F.col("position") < start + F.col("__size"), "test"))
    return x.select("match_id", F.col("fold").cast("int").alias("fold"), role.alias("role")) \
        .where(F.col("role").isNotNull())


def chrono_holdout(df: DataFrame, train_frac: float = 0.85) -> DataFrame:
    """First int(frac * n) rows in date order train, the rest test."""
    pos = global_position(df)
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(train_frac)).alias("__cut"))
    return pos.crossJoin(F.broadcast(n)).select(
        "match_id", "position", F.when(F.col("position") < F.col("__cut"), "train").otherwise("test").alias("role"))


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R^2 (optionally per group)."""
    by = by or []
    err = F.col(y) - F.col(p)
    g = pred.groupBy(*by) if by else pred
    s = g.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(F.col(y)).alias("__var"))
    return s.select(*by, "mae", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("__var") > 0, 1 - F.col("mse") / F.col("__var")).alias("r2"))


def cv_scores(fold_pred: DataFrame) -> DataFrame:
    """Per-fold MAE and R^2 -> mean and 2 x population std over folds."""
    per = regression_metrics(fold_pred, by=["fold"])
    return per.agg(F.avg("mae").alias("mae_mean"), (2 * F.stddev_pop("mae")).alias("mae_two_std"),
                   F.avg("r2").alias("r2_mean"), (2 * F.stddev_pop("r2")).alias("r2_two_std"),
                   F.count(F.lit(1)).alias("n_folds"))


def classification_metrics(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy (p > .5) and log loss (p clipped to [eps, 1 - eps])."""
    pc = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    ll = -(F.col(y) * F.ln(pc) + (1 - F.col(y)) * F.ln(1 - pc))
    hit = ((F.col(p) > 0.5).cast("int") == F.col(y)).cast("double")
    return pred.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.avg(ll).alias("log_loss"))


def classification_report(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    yhat = (F.col(p) > 0.5).cast("int")
    c = pred.groupBy(*by).agg(
        F.sum(((yhat == 1) & (F.col(y) == 1)).cast("int")).alias("tp"),
        F.sum(((yhat == 1) & (F.col(y) == 0)).cast("int")).alias("fp"),
        F.sum(((yhat == 0) & (F.col(y) == 1)).cast("int")).alias("fn"),
        F.sum(((yhat == 0) & (F.col(y) == 0)).cast("int")).alias("tn"))

    def prf(tp, fp, fn):
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        return prec, rec, f1

    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), (s0 + s1).alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ((p0 * s0 + p1 * s1) / (s0 + s1)).alias("precision"),
                 ((r0 * s0 + r1 * s1) / (s0 + s1)).alias("recall"), ((f0 * s0 + f1 * s1) / (s0 + s1)).alias("f1"),
                 (s0 + s1).alias("support")),
    )
    return c.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


# -- training (MLlib) -------------------------------------------------------------

def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


# The boosting presets by kind of target (trees, depth, learning rate, row share, least rows of a
# leaf). "middle" are the lines 10.5 to 13.5, "other" the remaining lines.
PRESETS = {
    "total": {"trees": 2000, "max_depth": 12, "step": 0.04, "subsample": 0.85, "min_rows": 4},
    "middle": {"trees": 1700, "max_depth": 12, "step": 0.04, "subsample": 0.82, "min_rows": 5},
    "other": {"trees": 700, "max_depth": 8, "step": 0.07, "subsample": 0.8, "min_rows": 3},
}
# The lines of the middle preset.
MIDDLE_LINES = ("10_5", "11_5", "12_5", "13_5")


def preset(target: str, trees: int | None = None, max_depth: int | None = None, **changes) -> dict:
    """The preset of a target. `trees` and `max_depth` override its size where a smaller fit is wanted; the
    registered training queries do so, and show what they used."""
    kind = "total" if target == "total_corners" else "middle" if any(m in target for m in MIDDLE_LINES) else "other"
    out = {**PRESETS[kind], **changes}
    return {**out, "trees": trees or out["trees"], "max_depth": max_depth or out["max_depth"]}


def _boosting(p: dict, seed: int) -> dict:
    return {"maxIter": p["trees"], "maxDepth": p["max_depth"], "stepSize": p["step"],
            "subsamplingRate": p["subsample"], "minInstancesPerNode": p["min_rows"], "seed": seed}


def train_total(train: DataFrame, features: list[str], p: dict | None = None, label: str = "total_corners",
                seed: int = 42):
    """Regression on total corners."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, **_boosting(p or preset(label), seed))
    return gbt.fit(assemble(train, features))


def class_weighted(df: DataFrame, label: str) -> DataFrame:
    """scale_pos_weight as a weight column: positives get (1 - p) / p (1 if p = 0)."""
    p = df.agg(F.avg(F.col(label).cast("double")).alias("__p"))
    w = F.when(F.col("__p") > 0, (1 - F.col("__p")) / F.col("__p")).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(p)).withColumn("__w", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0))) \
        .drop("__p")


def positive_weight(share: float | None) -> float:
    """The weight of positives of a known share (None: no row): (1 - p) / p, 1 if p = 0."""
    return (1 - share) / share if share is not None and share > 0 else 1.0


def weighted(df: DataFrame, label: str, share: float | None) -> DataFrame:
    """`class_weighted` for a known share of positives (None: no row): no scan, no join."""
    w = positive_weight(share)
    return df.withColumn("__w", F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0)))


def train_line(train: DataFrame, features: list[str], label: str, p: dict | None = None, seed: int = 42):
    """One class-weighted classifier for an over-line target."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="__w", **_boosting(p or preset(label), seed))
    return gbt.fit(assemble(class_weighted(train, label), features))


def prob_over(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(assemble(df, features))
    return scored.select(*keep, vector_to_array("probability")[1].alias("p"))


def importances(model, features: list[str], spark, name: str) -> DataFrame:
    """Feature importances of one fitted model (one row per feature)."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(name, f, float(v)) for f, v in zip(features, imp)],
                                 "model STRING, feature STRING, importance DOUBLE")


def top_n_importance(imps: DataFrame, n: int = 15) -> DataFrame:
    """K3: per model, features by importance desc, top n."""
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    return imps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ensemble_importance(imps: DataFrame) -> DataFrame:
    """Member importances summed per feature and normalised."""
    s = imps.groupBy("feature").agg(F.sum("importance").alias("s"))
    t = s.agg(F.sum("s").alias("t"))
    return s.crossJoin(F.broadcast(t)).select("feature", F.when(F.col("t") > 0, F.col("s") / F.col("t"))
                                              .otherwise(F.lit(0.0)).alias("importance"))


# Search ranges by mode, for the parameters that MLlib shares with the reference's library.
SEARCH_SPACE = {
    "regression": {"maxDepth": (4, 15), "stepSize": (0.01, 0.3), "maxIter": (100, 2000),
                   "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 10)},
    "classification": {"maxDepth": (4, 12), "stepSize": (0.01, 0.3), "maxIter": (100, 1500),
                       "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 8)},
}
# Trials by mode.
TRIALS = {"regression": 50, "classification": 30}


def draw_params(mode: str, trial: int, seed: int = 42) -> dict:
    """The parameters of one trial: integers uniform, the step uniform in its logarithm, the share uniform."""
    rng, space = random.Random(seed * 1_000_003 + trial), SEARCH_SPACE[mode]
    return {"maxDepth": rng.randint(*space["maxDepth"]),
            "stepSize": math.exp(rng.uniform(*map(math.log, space["stepSize"]))),
            "maxIter": rng.randint(*space["maxIter"]),
            "subsamplingRate": rng.uniform(*space["subsamplingRate"]),
            "minInstancesPerNode": rng.randint(*space["minInstancesPerNode"])}
