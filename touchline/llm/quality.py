"""Quality classifier: naive Bayes features in a linear support vector machine.

Indicators of n-grams are scaled by the log ratio of their rates in the two
classes; a linear hinge-loss model over the scaled vectors (unit length) is
fitted by dual coordinate descent, and a logistic curve over its margins gives the score.

N-grams: hashed byte n-grams of the whole text, and n-grams of the sequence
"word equals the one before / does not". Fitted on a bounded sample of labelled
rows (about `per_class` of each class, chosen by a hash of doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import held_out, small_batches
from touchline.llm.linear import fit_hinge, fit_sigmoid, ngram_ids, sigmoid

BITS = 16
ORDERS = range(1, 5)
PATTERN = 5  # words in a window of the equal / different sequence
DIMS = (1 << BITS) + (1 << PATTERN)


def indicators(text: str | None) -> np.ndarray:
    """Ascending ids of the n-grams present in the whole text (none for an empty one)."""
    if not text:
        return np.zeros(0, np.int64)
    data = text.encode()
    present = np.zeros(DIMS, bool)
    for k in range(0, len(data), 1 << 20):  # bounded working memory for very long texts
        present[ngram_ids(data[max(0, k - ORDERS.stop + 2): k + (1 << 20)], ORDERS, BITS)] = True
    words = data.split()
    if len(words) > 1:
        same = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), np.int64, len(words) - 1)
        code = np.convolve(same, 1 << np.arange(PATTERN))[: len(same)] & ((1 << PATTERN) - 1)
        present[(1 << BITS) + code] = True
    return np.nonzero(present)[0]


@dataclass
class Model:
    ratio: np.ndarray   # log-count ratio of every n-gram
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scaled(self, ids: np.ndarray) -> np.ndarray:
        v = self.ratio[ids]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def score(self, text: str | None) -> float:
        ids = indicators(text)
        return sigmoid(self.slope * (float(self.weight[ids] @ self.scaled(ids)) + self.bias) + self.shift)


def fit(rows: list[np.ndarray], good: np.ndarray, rates: tuple[float, float], c: float = 10.0,
        smoothing: float = 1.0) -> Model | None:
    """rows: indicator ids; good: label of each; rates: the share of all labelled rows of a class
    that the sample holds (good, bad), so that scores follow the classes' true frequencies."""
    n1, n0 = int(good.sum()), int((~good).sum())
    if not n1 or not n0:
        return None
    hits = {True: np.full(DIMS, smoothing), False: np.full(DIMS, smoothing)}
    for ids, g in zip(rows, good):
        hits[bool(g)][ids] += 1
    ratio = np.log((hits[True] / (n1 + 2 * smoothing)) / (hits[False] / (n0 + 2 * smoothing)))
    model = Model(ratio, np.zeros(DIMS), 0.0, 1.0, 0.0)
    scaled = [(ids, model.scaled(ids)) for ids in rows]
    n = n1 + n0
    model.weight, model.bias = fit_hinge(scaled, np.where(good, 1.0, -1.0), DIMS, c,
                                         weights=np.where(good, n / (2 * n1), n / (2 * n0)))
    margins = np.array([model.weight[ids] @ v for ids, v in scaled]) + model.bias
    model.slope, model.shift = fit_sigmoid(margins, good)
    model.shift += float(np.log(rates[1] / rates[0]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model | None:
    """Labels of repeated ids: all their rows count. Null ids and labels are not learned from."""
    small_batches(docs.sparkSession)
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    rate = {q: min(1.0, per_class / n) for q, n in counts.items()}
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(spot < F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0])).limit(4 * per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [indicators(t).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["quality", "ids"])

    # at most 4 * per_class small rows, whatever the input
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = picked.limit(8 * per_class).mapInArrow(run, "quality int, ids array<int>").toArrow()
    rows = [(got["quality"][i].as_py() == 1, got["ids"][i].values.to_numpy()) for i in range(got.num_rows)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit([ids.astype(np.int64) for _, ids in rows], np.array([g for g, _ in rows], bool), (rate[1], rate[0]))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs(doc_id, text, ...)`, from the text alone.

    A null text scores like an empty one. Without labels of both classes every
    score is 0.5. A null doc_id is not held out; repeated rows stay repeated."""
    model = train(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.score(t) if model else 0.5 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
