"""Boosted trees against MLlib's regression trees, and one task against blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from touchline.operators import boost as B

N = 600


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 20, (N, 5)).astype(float)
    x[:, 3] = r.integers(0, 3, N)
    x[:, 4] = 7.0  # one value
    y = x[:, 0] * .5 + (x[:, 1] > 9) * 4 + x[:, 3] + r.normal(size=N)
    made = spark.createDataFrame([(i, float(v), int(v > 9), [float(a) for a in q]) for i, (v, q) in enumerate(zip(y, x))],
                                 "match_id LONG, y DOUBLE, c INT, a ARRAY<DOUBLE>")
    return made.withColumn("x", array_to_vector("a")).cache()


def _largest(a, b, column):
    return a.select("match_id", F.col(column).alias("q")).join(b, "match_id").agg(F.max(F.abs(F.col("q") - F.col(column)))).first()[0]


def test_trees_are_those_of_mllib(rows):
    """Without draws each tree is MLlib's tree on what the trees before leave, from the mean on, and all count the same."""
    mean = rows.agg(F.avg("y")).first()[0]
    now = rows.withColumn("margin", F.lit(mean))
    importance = np.zeros(5)
    for _ in range(3):
        left = now.withColumn("left", F.col("y") - F.col("margin")).cache()
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="left", maxDepth=4, minInstancesPerNode=4, seed=1).fit(left)
        now = tree.setPredictionCol("own").transform(left).withColumn("margin", F.col("margin") + .3 * F.col("own")).drop("own", "left").cache()
    model = B.fit(rows, "y", N, B.Size(3, 4, .3, 1.0, 4, 42, None, mean))
    assert _largest(model.transform(rows), now.select("match_id", F.col("margin").alias("prediction")), "prediction") < 1e-5
    assert sum(model.importances) == pytest.approx(1) and model.importances[4] == 0


def test_weighted_classes_are_those_of_mllib(rows):
    share = rows.agg(F.avg("c")).first()[0]
    weight = (1 - share) / share
    now = rows.withColumn("w", F.when(F.col("c") == 1, weight).otherwise(1.0)).withColumn("margin", F.lit(0.0))
    for _ in range(2):
        s = 2 * F.col("c") - 1
        left = now.withColumn("left", 2 * s / (1 + F.exp(2 * s * F.col("margin")))).cache()
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="left", weightCol="w", maxDepth=3, minInstancesPerNode=5, seed=1).fit(left)
        now = tree.setPredictionCol("own").transform(left).withColumn("margin", F.col("margin") + .2 * F.col("own")).drop("own", "left").cache()
    model = B.fit(rows, "c", N, B.Size(2, 3, .2, 1.0, 5, 42, weight))
    want = now.select("match_id", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("probability"))
    assert _largest(model.transform(rows), want, "probability") < 1e-6


def test_blocks_give_the_trees_of_one_task(spark, rows, monkeypatch):
    """With draws, rows in any order and many nodes; the blocks' lineage is cut and its files go."""
    monkeypatch.setattr(B, "CUT_EVERY", 2)
    monkeypatch.setattr(B, "NODES_A_JOB", 8)
    monkeypatch.setattr(B, "CELLS", 1000)
    for label, positive, column in (("y", None, "prediction"), ("c", .7, "probability")):
        size = B.Size(5, 6, .2, .8, 3, 42, positive, 0.5)
        one, far = B.fit(rows, label, N, size), B.fit(rows.repartition(5, "y"), label, N, size, one_task=10)
        a, b = one.transform(rows), far.transform(rows.repartition(3))
        assert _largest(a, b, column) < 1e-9 and a.select(column).distinct().count() > 20
        assert far.importances == pytest.approx(one.importances)


def test_draws_follow_the_keys():
    key = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    size = B.Size(1, 1, .1, .8, 1, 42, None)
    own = B.Rows(np.zeros((20_000, 1), np.uint8), np.zeros(20_000), key, np.zeros(20_000))
    first, second = own.drawn(0, size), own.drawn(1, size)
    assert abs(len(first) / 20_000 - .8) < .02 and abs(len(np.intersect1d(first, second)) / 20_000 - .64) < .02
    turned = B.Rows(own.bins, own.y, key[::-1].copy(), own.margin)
    assert set(key[::-1][turned.drawn(0, size)]) == set(key[first])


def test_thresholds_part_the_rows_evenly():
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(size=50_000), r.integers(0, 4, 50_000), np.full(50_000, np.nan)])
    cuts = B.thresholds(B.merged(B.sketch(x[:30_000]), B.sketch(x[30_000:])))
    assert cuts[1].tolist() == [.5, 1.5, 2.5] and not len(cuts[2]) and len(cuts[0]) == B.BINS - 1
    n = np.bincount(B.binned(x, cuts)[:, 0], minlength=B.BINS)
    assert abs(n - 50_000 / B.BINS).max() < 200


def test_odd_labels(spark, rows):
    size = B.Size(3, 3, .2, .8, 2, 42, 1.0)
    with pytest.raises(ValueError):
        B.fit(rows.limit(0), "c", 0, size)
    with pytest.raises(Exception, match="labels must be known"):
        B.fit(rows.withColumn("c", F.when(F.col("match_id") > 3, F.col("c"))), "c", N, size)
    one = B.fit(rows.withColumn("c", F.lit(1)), "c", N, B.Size(3, 3, .2, .8, 2, 42, 0.0)).transform(rows)  # positives weigh nothing
    assert {r["probability"] for r in one.collect()} == {.5}
    single = B.fit(rows.limit(1), "y", 1, B.Size(3, 3, .2, 1.0, 1, 42, None, 2.0)).transform(rows)
    assert single.select("prediction").distinct().count() == 1


def test_a_saved_model_is_the_fitted_one(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 500)
    model = B.fit(rows, "y", N, B.Size(4, 5, .2, .8, 2, 42, None, 9.0))
    model.save(spark, f"file://{tmp_path}/m")
    assert B.Model.load(spark, f"file://{tmp_path}/m").blob == model.blob
