"""Training at the level of a whole model set: one written vector table, fits submitted concurrently,
out-of-fold predictions, saved models, and batch scoring from them.

The feature matrix is assembled once into a vector column and written with each row's role (train / test of the holdout) and
the fold whose test part it is; every fit reads that table and slices its own features from the vector, so no fit joins
or assembles again. Fits are Spark jobs (`boost.py`): a pool of driver threads only submits them, one for each core, so that fits of
one task run beside each other. Predictions and models go to shared storage; the driver holds one fitted
model a thread (trees, sized by depth and count, never by rows).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from contextlib import closing
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import boost as B
from touchline.operators import model as M
from touchline.session import POOL, checkpoint_dir, in_pool

TASK_ROWS = 50_000  # predictions of few rows take no more tasks than one for each so many
MOST_FITS = 32  # submitted at once


@dataclass(frozen=True)
class Spec:
    """One model of the set: what it predicts, its name among the models of that target, its features and size."""

    target: str
    model: str
    features: tuple[str, ...]
    params: tuple[tuple[str, float], ...]
    regression: bool = False

    @property
    def sizes(self) -> dict:
        return dict(self.params)


def vector_table(matrix: DataFrame, holdout: DataFrame, features: list[str], targets: list[str],
                 n_splits: int = 5) -> DataFrame:
    """(match_id, role, test_fold, targets..., features): one row per match; test_fold: the expanding-window fold
    that tests the row, -1 before the first; folds are those of the training rows alone, so the holdout (test_fold null) takes no part."""
    train = holdout.where(F.col("role") == "train").select("match_id")
    folds = M.time_series_folds(matrix.select("match_id", "date_gmt").join(train, "match_id", "left_semi"), n_splits)
    tested = folds.where(F.col("role") == "test").select("match_id", F.col("fold").alias("__fold"))
    joined = matrix.join(holdout.select("match_id", "role"), "match_id").join(tested, "match_id", "left")
    fold = F.when(F.col("role") == "train", F.coalesce("__fold", F.lit(-1)))
    return M.assemble(joined, features).select(
        "match_id", "role", fold.cast("int").alias("test_fold"), *targets, "features")


def sliced(rows: DataFrame, all_features: list[str], features: Iterable[str], out: str = "x") -> DataFrame:
    return VectorSlicer(inputCol="features", outputCol=out, indices=[all_features.index(f) for f in features]).transform(rows)


@dataclass(frozen=True)
class Part:
    """Rows of the vector table: of one fold's training or test part, or of the whole training part."""

    rows: DataFrame
    n: int
    share: dict[str, float | None]  # of positives, or the mean, by target

    @property
    def few_tasks(self) -> DataFrame:
        """The rows in at most a partition for each TASK_ROWS, for predictions: the row samples of a fit follow its partitions."""
        return self.rows.coalesce(max(1, math.ceil(self.n / TASK_ROWS)))


def parts(table: DataFrame, targets: Iterable[str], n_splits: int = 5) -> tuple[list[tuple[Part, Part]], Part]:
    """(training part, test part) of every fold, and all training rows. Their numbers of rows and the targets' means come from one
    scan of the table, so that no fit has to scan its rows for them."""
    targets = sorted(set(targets))
    train = table.where(F.col("role") == "train")
    # a row for each fold
    by_fold = {r["test_fold"]: r for r in train.groupBy("test_fold").agg(
        F.count(F.lit(1)).alias("__n"), *[x for t in targets for x in (
            F.sum(F.col(t).cast("double")).alias(f"__s_{t}"), F.count(t).alias(f"__c_{t}"))]).collect()}

    def part(rows: DataFrame, folds: Iterable[int]) -> Part:
        own = [by_fold[k] for k in folds if k in by_fold]
        known = {t: sum(r[f"__c_{t}"] for r in own) for t in targets}
        return Part(rows, sum(r["__n"] for r in own), {
            t: sum(r[f"__s_{t}"] or 0.0 for r in own) / known[t] if known[t] else None for t in targets})

    return ([(part(train.where(F.col("test_fold") < k), range(-1, k)), part(table.where(F.col("test_fold") == k), [k]))
             for k in range(n_splits)], part(train, range(-1, n_splits)))


def whole(rows: DataFrame, target: str) -> Part:
    """Any rows of the vector table as a part, by a scan of them."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("share")).first()
    return Part(rows, one["n"], {target: one["share"]})


def fit(spec: Spec, train: Part | DataFrame, all_features: list[str], seed: int = 42):
    """The fitted model of `spec` on rows or a part of the vector table; classifiers weigh positives by (1 - p) / p."""
    if isinstance(train, DataFrame):
        train = whole(train, spec.target)
    p, share = spec.sizes, train.share[spec.target]
    size = B.Size(int(p["trees"]), int(p["max_depth"]), p["step"], p["subsample"], int(p["min_rows"]), seed,
                  *((None, share or 0.0) if spec.regression else (M.positive_weight(share),)))
    return B.fit(sliced(train.rows, all_features, spec.features), spec.target, train.n, size)


def _predicted(model, spec: Spec):
    return F.col("prediction") if spec.regression else F.col("probability")


def _fits_at_once(spark: SparkSession, pool: int | None, rows: int) -> int:
    """Fits of up to `rows` rows run beside each other: those of one task on all cores, those that take all cores in a small pool."""
    return pool or (POOL if rows > B.ONE_TASK else max(POOL, min(spark.sparkContext.defaultParallelism, MOST_FITS)))


def out_of_fold(table: DataFrame, specs: list[Spec], all_features: list[str], root: str, n_splits: int = 5,
                pool: int | None = None) -> DataFrame:
    """(target, model, fold, match_id, y, p): every model's prediction of every fold's test rows, by a fit on the
    rows before them. Each fit writes its own folder below `root`, overwriting what an earlier attempt left."""
    folds, _ = parts(table, [s.target for s in specs], n_splits)

    def work(job: tuple[Spec, int]) -> None:
        spec, fold = job
        train, test = folds[fold]
        with closing(fit(spec, train, all_features)) as model:
            tested = sliced(test.few_tasks, all_features, spec.features)
            model.transform(tested).select("match_id", F.col(spec.target).cast("double").alias("y"),
                                           _predicted(model, spec).alias("p")) \
                .write.mode("overwrite").parquet(f"{root}/target={spec.target}/model={spec.model}/fold={fold}")

    # the longest first, so that none is left alone at the end
    jobs = sorted([(s, k) for s in specs for k in range(n_splits)], key=lambda j: -j[0].sizes["trees"] * j[0].sizes["max_depth"] * (j[1] + 1))
    in_pool(work, jobs, _fits_at_once(table.sparkSession, pool, folds[-1][0].n))
    return load_out_of_fold(table.sparkSession, [root] if specs else [])


OUT_OF_FOLD = "match_id BIGINT, y DOUBLE, p DOUBLE, target STRING, model STRING, fold INT"


def load_out_of_fold(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The out-of-fold predictions written below all `roots`."""
    return reduce(DataFrame.unionByName, [spark.read.schema(OUT_OF_FOLD).parquet(r) for r in roots] or [
        spark.createDataFrame([], OUT_OF_FOLD)])


def fold_scores(oof: DataFrame) -> DataFrame:
    """M16 on real fits: (target, model, fold, n, accuracy, mae, r2) of the out-of-fold table; accuracy for 0/1 targets, mae and
    R2 for the others, NULL otherwise."""
    err = F.col("y") - F.col("p")
    s = oof.groupBy("target", "model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double")).alias("__acc"),
        F.avg(F.abs(err)).alias("__mae"), F.avg(err * err).alias("__mse"), F.var_pop("y").alias("__var"))
    flag = F.col("target").startswith("over_")
    return s.select("target", "model", "fold", "n", F.when(flag, F.col("__acc")).alias("accuracy"),
                    F.when(~flag, F.col("__mae")).alias("mae"),
                    F.when(~flag & (F.col("__var") > 0), 1 - F.col("__mse") / F.col("__var")).alias("r2"))


def cv_summary(oof: DataFrame) -> DataFrame:
    """Mean and twice the population deviation of the folds' scores, per target and model."""
    return fold_scores(oof).groupBy("target", "model").agg(*[x for c in ("accuracy", "mae", "r2") for x in (
        F.avg(c).alias(f"{c}_mean"), (2 * F.stddev_pop(c)).alias(f"{c}_two_std"))], F.count(F.lit(1)).alias("n_folds"))


def ensemble_weights(oof: DataFrame) -> DataFrame:
    """(target, model, accuracy, weight): a member's mean fold accuracy over the sum of those of its target's members."""
    own = fold_scores(oof).where(F.col("accuracy").isNotNull()).groupBy("target", "model").agg(
        F.avg("accuracy").alias("accuracy"))
    total = own.groupBy("target").agg(F.sum("accuracy").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    weight = F.when(F.col("__sum") > 0, F.col("accuracy") / F.col("__sum")).otherwise(1 / F.col("__n"))
    # one row for each target and member
    return own.join(F.broadcast(total), "target").select("target", "model", "accuracy", weight.alias("weight"))


MANIFEST = ("target STRING, model STRING, regression BOOLEAN, features ARRAY<STRING>, all_features ARRAY<STRING>, "
            "trees INT, max_depth INT, weight DOUBLE, importances ARRAY<DOUBLE>, path STRING")


def model_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex}"


def save_models(table: DataFrame, specs: list[Spec], all_features: list[str], weights: dict[tuple[str, str], float],
                root: str, pool: int | None = None) -> DataFrame:
    """Fit every spec on the training rows, save the models below `root`, and write their manifest, one row a model."""
    spark, (_, train) = table.sparkSession, parts(table, [s.target for s in specs])

    def work(spec: Spec) -> tuple:
        path = f"{root}/{spec.target}/{spec.model}"
        model = fit(spec, train, all_features)
        model.save(spark, path)
        return (spec.target, spec.model, spec.regression, list(spec.features), list(all_features), spec.sizes["trees"],
                spec.sizes["max_depth"], weights.get((spec.target, spec.model), 1.0),
                model.importances, path)

    jobs = sorted(specs, key=lambda s: -s.sizes["trees"] * s.sizes["max_depth"])
    spark.createDataFrame(in_pool(work, jobs, _fits_at_once(spark, pool, train.n)), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return load_manifest(spark, root)


def load_manifest(spark: SparkSession, *roots: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(MANIFEST).parquet(f"{r}/manifest") for r in roots] or [
        spark.createDataFrame([], MANIFEST)])


def weighted_manifest(manifest: DataFrame, weights: DataFrame) -> DataFrame:
    """The manifest with the weights of `ensemble_weights`; models without one there keep theirs."""
    own = weights.select("target", "model", F.col("weight").alias("__own"))  # one row for each target and member
    return manifest.join(F.broadcast(own), ["target", "model"], "left").withColumn("weight", F.coalesce("__own", "weight")).select(
        manifest.columns)


def importances(manifest: DataFrame) -> DataFrame:
    """(target, model, feature, importance) of every saved model."""
    return manifest.select("target", "model", F.explode(F.arrays_zip("features", "importances")).alias("f")).select(
        "target", "model", F.col("f.features").alias("feature"), F.col("f.importances").alias("importance"))


def score(manifest: DataFrame, rows: DataFrame, keep: list[str]) -> tuple[DataFrame, list[tuple[str, str, float, str]]]:
    """`rows` of the vector table (or any with such a `features` column) with one column for each saved model: the probability of
    a classifier, the prediction of a regressor. Also (target, model, weight, column) of each.

    All models are applied in one pass over the rows, without a join; a task holds one of them at a time. The manifest has one row a model."""
    spark, models, added = rows.sparkSession, [], []
    for k, m in enumerate(sorted(manifest.collect(), key=lambda r: (r["target"], r["model"]))):
        models.append((B.Model.load(spark, m["path"]).sent(spark), [m["all_features"].index(f) for f in m["features"]]))
        added.append((m["target"], m["model"], float(m["weight"]), f"__m{k}"))
    return B.with_predictions(rows.select(*keep, vector_to_array("features").alias("__x")), models, [c for *_, c in added]), added


# The order of a hard line's members.
MEMBER_ORDER = ("xgb_optimized", "xgb_conservative", "recent_focus")


def member_scores(scored: DataFrame, added: list[tuple[str, str, float, str]], lines: dict[str, float]) -> DataFrame:
    """(match_id, line, p1..p3, w1..w3) from the scored rows: the members of each line in their order, with their weights; a
    line of one model has p1 with weight 1; a member that a line lacks is NULL."""
    by_line: dict[str, list[tuple[float, str]]] = {}
    for target, model, weight, column in sorted(added, key=lambda a: (a[0], MEMBER_ORDER.index(a[1]) if a[1] in MEMBER_ORDER else 0)):
        if target in lines:
            by_line.setdefault(target, []).append((weight, column))
    structs = []
    for target, members in by_line.items():
        p = [F.col(c) for _, c in members] + [F.lit(None).cast("double")] * (3 - len(members))
        w = [F.lit(x) for x, _ in members] + [F.lit(None).cast("double")] * (3 - len(members))
        structs.append(F.struct(F.lit(float(lines[target])).alias("line"), *[c.alias(f"p{k + 1}") for k, c in enumerate(p)],
                                *[c.alias(f"w{k + 1}") for k, c in enumerate(w)]))
    return scored.select("match_id", F.inline(F.array(*structs)))


def param_search(table: DataFrame, all_features: list[str], features: list[str], label: str, mode: str = "classification",
                 n_trials: int | None = None, n_splits: int = 5, tree_share: float = 1.0, max_depth: int | None = None,
                 pool: int | None = None, seed: int = 42) -> DataFrame:
    """M15 (re-aimed): seeded random draws, each scored by its mean fold accuracy or R2; `best` marks the best one.

    Trials and folds are fitted concurrently on the training rows of the vector table, classifiers class-weighted. Defaults are the
    reference's ranges and numbers of trials; a fit has `tree_share` of the drawn trees (one at least) and a depth of
    `max_depth` at most, so that draws stay apart where the full size can't be run."""
    draws = [M.draw_params(mode, t, seed) for t in range(n_trials or M.TRIALS[mode])]
    fitted = [{"trees": max(1, round(p["maxIter"] * tree_share)), "max_depth": min(p["maxDepth"], max_depth or p["maxDepth"]),
               "step": p["stepSize"], "subsample": p["subsamplingRate"], "min_rows": p["minInstancesPerNode"]} for p in draws]

    folds, _ = parts(table, [label], n_splits)

    def work(job: tuple[int, int]) -> float:
        trial, fold = job
        train, test = folds[fold]
        spec = Spec(label, f"trial_{trial}", tuple(features), tuple(sorted(fitted[trial].items())), mode == "regression")
        with closing(fit(spec, train, all_features, seed)) as model:
            pred = model.transform(sliced(test.few_tasks, all_features, features))
            if mode == "classification":
                score_ = pred.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
            else:
                score_ = M.regression_metrics(pred, y=label).first()["r2"]
        return 0.0 if score_ is None else float(score_)

    jobs = sorted([(t, k) for t in range(len(draws)) for k in range(n_splits)],
                  key=lambda j: -fitted[j[0]]["trees"] * fitted[j[0]]["max_depth"] * (j[1] + 1))
    by_job = dict(zip(jobs, in_pool(work, jobs, _fits_at_once(table.sparkSession, pool, folds[-1][0].n))))
    scores = [by_job[t, k] for t in range(len(draws)) for k in range(n_splits)]
    means = [sum(scores[t * n_splits:(t + 1) * n_splits]) / n_splits for t in range(len(draws))]
    best = max(range(len(draws)), key=lambda t: (means[t], -t))
    return table.sparkSession.createDataFrame(
        [(t, p["maxDepth"], p["maxIter"], f["max_depth"], f["step"], f["trees"], f["subsample"], f["min_rows"], means[t], int(t == best))
         for t, (p, f) in enumerate(zip(draws, fitted))],
        "trial INT, drawn_depth INT, drawn_trees INT, max_depth INT, step_size DOUBLE, trees INT, subsampling_rate DOUBLE, "
        "min_instances INT, mean_score DOUBLE, best INT")
