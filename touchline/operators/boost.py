"""Gradient-boosted trees over binned features, for squared error and for the logistic loss.

As in the reference's library, a fit starts from one value (the mean label; even odds of weighted classes) and every tree counts `step`: one
of depth 12 that counts whole, as MLlib's first tree does, would be most of the prediction. A tree is MLlib's regression tree on the loss's negative
gradient: a split is the one of greatest weighted decrease of the squared error among at most BINS - 1 thresholds a feature, a leaf the weighted
mean. Every tree draws its rows by a hash of their key, so that a draw does not depend on how the rows lie.

Rows are held as one byte a feature. Up to ONE_TASK rows are fitted inside one Spark task, without a job for each level of each
tree, so that many fits run beside each other; more rows stay in blocks all over the cluster, with a job a level that
adds up the blocks' sums by node, and only the chosen splits come to the driver. Both follow `boosted`, with the same sums. A tree
is kept in about two bytes a node and four a leaf, in breadth-first order: the k-th inner node has the children 2k + 1 and 2k + 2.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir

BINS = 32  # MLlib's default
ONE_TASK = 500_000  # rows of a fit that one task holds: 40 bytes a row for 40 features, and 40 more
LADDER = 1024  # points of a feature's sketch
TINY = 1e-300  # added to weights, so that nothing is divided by 0
CELLS = 1 << 15  # sums of nodes x features x bins at once, for the processor's cache
ROWS_AT_ONCE = 8192
NODES_A_JOB = 1024
BLOCK_ROWS = 200_000  # each block adds to the sums of all open nodes, so that small ones cost more
CUT_EVERY = 25  # trees between two cuts of the blocks' lineage
PIECE = 1 << 26  # bytes of a saved model in one row


@dataclass(frozen=True)
class Size:
    """Settings of a fit. `positive`: the weight of rows of class 1, None for a regression; `start`: the margin before the first tree."""

    trees: int
    max_depth: int
    step: float
    subsample: float
    min_rows: int
    seed: int
    positive: float | None
    start: float = 0.0


# -- thresholds ------------------------------------------------------------------------

def sketch(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each column its values with their counts, in order; of over LADDER values as many that part the rows evenly."""
    return [_thinned(*np.unique(x[:, j][np.isfinite(x[:, j])], return_counts=True)) for j in range(x.shape[1])]


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= LADDER:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, LADDER + 1) * (upto[-1] / LADDER)).clip(1, upto[-1])))
    return values[at], np.diff(upto[at], prepend=0)


def merged(a: list, b: list) -> list:
    out = []
    for (v, n), (w, m) in zip(a, b):
        values, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        out.append(_thinned(values, np.bincount(at, np.concatenate([n, m])).astype(np.int64)))
    return out


def thresholds(found: list) -> list[np.ndarray]:
    """At most BINS - 1 thresholds a feature, midway between neighbouring values: all of them, or those that part the rows evenly. A row goes
    left if its value is at most the threshold."""
    out = []
    for values, counts in found:
        at = np.arange(len(values))
        if len(values) > BINS:
            upto = np.cumsum(counts)
            at = np.unique(np.searchsorted(upto, np.arange(1, BINS) * (upto[-1] / BINS)))
        at = at[at < len(values) - 1]
        out.append((values[at] + values[at + 1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


# -- trees ------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in breadth-first order: feature (-1 of a leaf), last bin that goes left, value (0 of an inner node)."""

    feature: np.ndarray  # int16
    bin: np.ndarray  # uint8
    value: np.ndarray  # float32

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row, after `levels` steps at most."""
        inner = self.feature >= 0
        own = np.arange(len(self.feature), dtype=np.int32)
        left = np.where(inner, 2 * np.cumsum(inner) - 1, own).astype(np.int32)
        feature, last = np.where(inner, self.feature, 0), np.where(inner, self.bin, 255).astype(np.uint8)
        n, f = bins.shape
        flat, first = bins.reshape(-1), np.arange(n) * f
        node = np.zeros(n, np.int32)
        steps, k = 0, 1  # the tree's depth: nodes of a level hold twice as many as the inner ones above
        start = 0
        while levels is None or steps < levels:
            below = 2 * int(inner[start:start + k].sum())
            if not below:
                break
            node = left[node] + (flat[first + feature[node]] > last[node])
            start, k, steps = start + k, below, steps + 1
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)].astype(np.float64)


def sums(bins: np.ndarray, at: np.ndarray, k: int, w: np.ndarray | None, g: np.ndarray) -> np.ndarray:
    """(3, k, features, BINS): number, weight and weighted residual of the rows of each node, feature and bin; without weights (2, ...)."""
    f = bins.shape[1]
    size = k * f * BINS
    out = np.zeros((2 if w is None else 3, size))
    column = np.arange(f) * BINS
    for a in range(0, len(at), ROWS_AT_ONCE):
        b = slice(a, a + ROWS_AT_ONCE)
        cell = (bins[b] + (at[b, None] * (f * BINS) + column)).reshape(-1)
        out[0] += np.bincount(cell, minlength=size)
        for one, value in zip(out[1:], (g,) if w is None else (w, g)):
            one += np.bincount(cell, np.repeat(value[b], f), size)
    return out.reshape(-1, k, f, BINS)


def best(s: np.ndarray, min_rows: int) -> np.ndarray:
    """(9, k): decrease (0: no split), feature, bin, then number, weight and residual of the rows to the left, and of all the node's rows."""
    k, f = s.shape[1:3]
    whole, left = s[:, :, 0].sum(axis=-1), np.cumsum(s, axis=-1)[..., :-1]
    (n, w, g), (all_n, all_w, all_g) = ((x[0], x[-2], x[-1]) for x in (left, whole[:, :, None, None]))
    score, other, weight = g * g, all_g - g, all_w - w
    score /= w + TINY
    other *= other
    weight += TINY
    other /= weight
    score += other
    score[(n < min_rows) | (n > all_n - min_rows)] = -np.inf
    flat = score.reshape(k, -1)
    at, each = flat.argmax(axis=1), np.arange(k)
    top, base = flat[each, at], whole[-1] * whole[-1] / (whole[-2] + TINY)
    possible = np.isfinite(top)
    top[~possible] = 0.0
    gain = np.where(possible & (top - base > 1e-12 * np.abs(top)), top - base, 0.0)  # what rounding leaves of a pure node is none
    chosen = left.reshape(len(s), k, -1)[:, each, at]
    return np.stack([gain, at // (BINS - 1), at % (BINS - 1), *(x[i] for x in (chosen, whole) for i in (0, -2, -1))])


def grown(search: Callable, size: Size, importance: np.ndarray) -> Tree:
    """A tree level by level. `search(tree so far, its depth, open nodes)` gives `best` of the open nodes, numbered within the last level."""
    features, lasts, values = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.float32)]
    open_ = np.zeros(1, np.int64)
    for depth in range(size.max_depth):
        if not len(open_):
            break
        found = search(Tree(np.concatenate(features), np.concatenate(lasts), np.concatenate(values)), depth, open_)
        if not depth:
            values[0][:] = found[8] / found[7] if found[7, 0] > 0 else 0.0
        found, own = found[:, found[0] > 0], open_[found[0] > 0]
        feature = found[1].astype(np.int16)
        features[-1][own], lasts[-1][own], values[-1][own] = feature, found[2], 0.0
        np.add.at(importance, feature, found[0])
        left, whole = found[3:6], found[6:9]
        n, w, g = np.stack([left, whole - left], axis=-1).reshape(3, -1)
        if not len(own):
            break
        features.append(np.full(len(n), -1, np.int16))
        lasts.append(np.zeros(len(n), np.uint8))
        values.append(np.divide(g, w, out=np.zeros(len(n)), where=w > 0).astype(np.float32))
        open_ = np.flatnonzero(n >= 2 * size.min_rows)
    return Tree(np.concatenate(features), np.concatenate(lasts), np.concatenate(values))


# -- rows -------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's last step."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Rows:
    """Training rows in one process. `y` is -1 or 1 for classes; `margin`, half the logarithm of the odds for these, is the sum of the trees so far."""

    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray  # uint64
    margin: np.ndarray

    def weights(self, size: Size) -> np.ndarray | None:
        return None if size.positive is None else np.where(self.y > 0, size.positive, 1.0)

    def drawn(self, tree: int, size: Size) -> np.ndarray:
        if size.subsample >= 1:
            return np.arange(len(self.y))
        with np.errstate(over="ignore"):
            salt = _mixed(np.array([size.seed, tree], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            u = _mixed(self.key + salt[0] * np.uint64(3) + salt[1])
        return np.flatnonzero((u >> np.uint64(11)) < np.uint64(int(size.subsample * (1 << 53))))

    def residual(self, size: Size) -> np.ndarray:
        if size.positive is None:
            return self.y - self.margin
        return 2 * self.y / (1 + np.exp(np.clip(2 * self.y * self.margin, -700, 700)))

    def plus(self, tree: Tree, weight: float) -> Rows:
        return Rows(self.bins, self.y, self.key, self.margin + weight * tree.predict(self.bins))


class Here:
    """The rows of a fit in this process."""

    def __init__(self, rows: Rows, size: Size):
        self.rows, self.size = rows, size

    def begin(self, tree: int) -> None:
        self.own = self.rows.drawn(tree, self.size)
        w = self.rows.weights(self.size)
        self.w = None if w is None else w[self.own]
        g = self.rows.residual(self.size)[self.own]
        self.g = g if w is None else g * self.w
        self.node = np.zeros(len(self.own), np.int64)  # within the last level

    def search(self, tree: Tree, depth: int, open_: np.ndarray) -> np.ndarray:
        if depth:  # one step down from the level before, whose rows at leaves are left behind
            inner = tree.feature[self.start:self.start + self.k] >= 0
            self._keep(inner[self.node])
            at = self.start + self.node
            right = self.rows.bins[self.own, tree.feature[at]] > tree.bin[at]
            self.node = 2 * (np.cumsum(inner)[self.node] - 1) + right
            self.start, self.k = self.start + self.k, 2 * int(inner.sum())
        else:
            self.start, self.k = 0, 1
        place = np.full(self.k, -1, np.int64)
        place[open_] = np.arange(len(open_))
        at = place[self.node]
        if (at < 0).any():
            self._keep(at >= 0)
            at = at[at >= 0]
        each = max(1, CELLS // (self.rows.bins.shape[1] * BINS))  # nodes at once
        if len(open_) <= each:
            return best(sums(self.rows.bins[self.own], at, len(open_), self.w, self.g), self.size.min_rows)
        order = np.argsort(at.astype(np.uint16) if len(open_) <= 1 << 16 else at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, len(open_) + each, each))
        out = []
        for i, k in enumerate(range(0, len(open_), each)):
            o = order[ends[i]:ends[i + 1]]
            out.append(best(sums(self.rows.bins[self.own[o]], at[o] - k, min(each, len(open_) - k),
                                 None if self.w is None else self.w[o], self.g[o]), self.size.min_rows))
        return np.concatenate(out, axis=1)

    def _keep(self, which: np.ndarray) -> None:
        self.own, self.g, self.node = self.own[which], self.g[which], self.node[which]
        self.w = None if self.w is None else self.w[which]

    def add(self, tree: Tree, weight: float) -> None:
        self.rows = self.rows.plus(tree, weight)

    def end(self) -> None:
        pass


class Spread:
    """The rows of a fit in blocks all over the cluster."""

    def __init__(self, blocks: RDD, size: Size, partitions: int):
        self.blocks, self.size, self.partitions, self.saved, self.t = blocks, size, partitions, None, 0

    def begin(self, tree: int) -> None:
        self.t = tree

    def search(self, tree: Tree, depth: int, open_: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(open_), NODES_A_JOB):
            nodes, size, t = open_[a:a + NODES_A_JOB], self.size, self.t
            found = dict(self.blocks.mapPartitions(lambda blocks: _block_sums(blocks, tree, depth, nodes, size, t))
                         .reduceByKey(np.add, self.partitions).mapValues(lambda s: best(s, size.min_rows)).collect())
            out += [found[k] for k in sorted(found)]
        return np.concatenate(out, axis=1)

    def add(self, tree: Tree, weight: float) -> None:
        before, saved = self.blocks, None
        self.blocks = before.map(lambda rows: rows.plus(tree, weight)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.t % CUT_EVERY == CUT_EVERY - 1:
            self.blocks.checkpoint()
        self.blocks.count()
        before.unpersist()
        if self.blocks.isCheckpointed():
            saved, self.saved = self.saved, self.blocks.getCheckpointFile()
            self._delete(saved)

    def _delete(self, path: str | None) -> None:
        if path:
            where = self.blocks.ctx._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.blocks.ctx._jsc.hadoopConfiguration()).delete(where, True)

    def end(self) -> None:
        self.blocks.unpersist()
        self._delete(self.saved)


def _block_sums(blocks: Iterable[Rows], tree: Tree, depth: int, nodes: np.ndarray, size: Size, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first of 64 nodes, sums) of a partition's rows at `nodes` of the tree's last level."""
    levels, start = tree, 0
    k = 1
    for _ in range(depth):
        start, k = start + k, 2 * int((levels.feature[start:start + k] >= 0).sum())
    place = np.full(len(tree.feature), -1, np.int64)
    place[start + nodes] = np.arange(len(nodes))
    total: dict[int, np.ndarray] = {}
    for rows in blocks:
        own = rows.drawn(t, size)
        at = place[tree.nodes(rows.bins[own], depth)]
        own, at = own[at >= 0], at[at >= 0]
        w = rows.weights(size)
        g = rows.residual(size)[own] * (1.0 if w is None else w[own])
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, len(nodes) + 64, 64))
        for i, a in enumerate(range(0, len(nodes), 64)):
            o = order[ends[i]:ends[i + 1]]
            s = sums(rows.bins[own[o]], at[o] - a, min(64, len(nodes) - a), None if w is None else w[own[o]], g[o])
            total[a] = total[a] + s if a in total else s
    yield from total.items()


def boosted(rows: Here | Spread, size: Size, n_features: int) -> tuple[list[Tree], np.ndarray]:
    """All trees, and the decrease by feature."""
    trees, importance = [], np.zeros(n_features)
    for t in range(size.trees):
        rows.begin(t)
        trees.append(grown(rows.search, size, importance))
        rows.add(trees[-1], size.step)
    rows.end()
    return trees, importance


# -- models -----------------------------------------------------------------------------

class Model:
    """A fitted model. `blob` is what is saved and sent to tasks."""

    def __init__(self, blob: bytes):
        self.blob, self._sent = blob, []

    @staticmethod
    def of(trees: list[Tree], importance: np.ndarray, cuts: list[np.ndarray], size: Size) -> bytes:
        total = importance.sum()
        return pickle.dumps({
            "cuts": cuts, "regression": size.positive is None, "step": size.step, "start": size.start,
            "importances": (importance / total if total > 0 else importance).tolist(),
            "sizes": np.array([len(t.feature) for t in trees], np.int32), "feature": np.concatenate([t.feature for t in trees]),
            "bin": np.concatenate([t.bin for t in trees]), "leaf": np.concatenate([t.value[t.feature < 0] for t in trees])}, protocol=5)

    @property
    def importances(self) -> list[float]:
        return pickle.loads(self.blob)["importances"]

    @property
    def regression(self) -> bool:
        return pickle.loads(self.blob)["regression"]

    def save(self, spark: SparkSession, path: str) -> None:
        pieces = [(k, self.blob[a:a + PIECE]) for k, a in enumerate(range(0, len(self.blob), PIECE))]
        spark.createDataFrame(pieces, "piece INT, blob BINARY").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = spark.read.schema("piece INT, blob BINARY").parquet(path).collect()
        return Model(b"".join(r["blob"] for r in sorted(rows, key=lambda r: r["piece"])))

    def sent(self, spark: SparkSession):
        """The model as a broadcast, which the driver's Python does not keep."""
        out = spark.sparkContext.broadcast(self.blob)
        vars(out).pop("_value", None)
        self._sent.append(out)
        return out

    def transform(self, rows: DataFrame, column: str = "x") -> DataFrame:
        """`rows`, without their vectors, with `prediction` and, of a classifier, `probability` of class 1; features are the vector `column`."""
        plain = rows.select(*[c for c, kind in rows.dtypes if kind != "vector"], vector_to_array(column).alias("__x"))
        models = [(self.sent(rows.sparkSession), None)]
        if self.regression:
            return with_predictions(plain, models, ["prediction"])
        return with_predictions(plain, models, ["probability"]).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))

    def close(self) -> None:
        """Frees what `transform` has sent; its tables can't be read any more."""
        while self._sent:
            self._sent.pop().destroy()


def predictions(blob: bytes, x: np.ndarray) -> np.ndarray:
    """The prediction of a regression, the probability of class 1 of a classifier."""
    m = pickle.loads(blob)
    bins, out = binned(x, m["cuts"]), np.full(len(x), m["start"])
    value = np.zeros(len(m["feature"]), np.float32)
    value[m["feature"] < 0] = m["leaf"]
    ends = np.cumsum(m["sizes"])
    for a, b in zip(ends - m["sizes"], ends):
        out += m["step"] * Tree(m["feature"][a:b], m["bin"][a:b], value[a:b]).predict(bins)
    return out if m["regression"] else 1 / (1 + np.exp(np.clip(-2 * out, -700, 700)))


def with_predictions(rows: DataFrame, models: list[tuple], columns: list[str]) -> DataFrame:
    """`rows` with a column for each of `models` in place of the array `__x`; a model is (broadcast, its features' places in `__x`
    or None for all). A task holds one model at a time and reads the others again for each batch of rows."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__x"), *(f"`{c}` DOUBLE" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("__x"))
            keep = [(n, b.column(n)) for n in b.schema.names if n != "__x"]
            found = []
            for sent, places in models:
                found.append(pa.array(predictions(sent.value, x if places is None else x[:, places])))
                vars(sent).pop("_value", None)
            yield pa.RecordBatch.from_arrays([a for _, a in keep] + found, names=[n for n, _ in keep] + columns)

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


# -- fits -------------------------------------------------------------------------------

def _block(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)


def _rows(x: np.ndarray, y: np.ndarray, key: np.ndarray, cuts: list[np.ndarray], size: Size) -> Rows:
    if not np.isfinite(y).all() or (size.positive is not None and not np.isin(y, (0.0, 1.0)).all()):
        raise ValueError("labels must be known, and 0 or 1 for classes")
    return Rows(binned(x, cuts), y if size.positive is None else 2 * y - 1, key, np.full(len(y), size.start))


def _in_one_task(size: Size) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_block(b) for b in batches if b.num_rows]
        if parts:
            x, y, key = (np.concatenate(p) for p in zip(*parts))
            parts.clear()
            cuts = thresholds(sketch(x))
            rows = _rows(x, y, key, cuts, size)
            del x
            order = np.lexsort((y, key))  # sums, and so the trees, do not depend on the order in which rows arrive
            rows = Rows(rows.bins[order], rows.y[order], rows.key[order], rows.margin)
            blob = Model.of(*boosted(Here(rows, size), size, len(cuts)), cuts, size)
            for k, a in enumerate(range(0, len(blob), PIECE)):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "blob": pa.array([blob[a:a + PIECE]], pa.binary())})

    return run


def fit(rows: DataFrame, label: str, n: int, size: Size, key: str = "match_id", column: str = "x", one_task: int = ONE_TASK) -> Model:
    """The model of `n` rows with the vector `column`; rows are drawn by `key`."""
    if not n:
        raise ValueError("a fit needs rows")
    own = rows.select(F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("y"), vector_to_array(column).alias("x"))
    if n <= one_task:
        found = own.coalesce(1).mapInArrow(_in_one_task(size), "piece INT, blob BINARY").collect()
        return Model(b"".join(r["blob"] for r in sorted(found, key=lambda r: r["piece"])))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = sketch(_block(b)[0])
                total = one if total is None else merged(total, one)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([pickle.dumps(total)], pa.binary())})

    checkpoint_dir(rows.sparkSession)
    own = own.coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # each partition sends the sums of all open nodes
    cuts = thresholds(own.mapInArrow(sketched, "blob BINARY").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(merged))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(_rows(*_block(b), cuts, size))
            if held and (b is None or sum(len(r.y) for r in held) >= BLOCK_ROWS):
                one = Rows(*(np.concatenate(p) for p in zip(*((r.bins, r.y, r.key, r.margin) for r in held))))
                held.clear()
                yield pa.RecordBatch.from_pydict({"blob": pa.array([pickle.dumps(one, protocol=5)], pa.binary())})

    held = own.mapInArrow(blocks, "blob BINARY").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    partitions = max(1, min(held.getNumPartitions(), math.ceil(NODES_A_JOB / 64)))
    return Model(Model.of(*boosted(Spread(held, size, partitions), size, len(cuts)), cuts, size))
