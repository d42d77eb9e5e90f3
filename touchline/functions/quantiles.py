"""Exact interpolated quantiles of many columns in two scans, without a task that holds a column's values.

The first scan is one aggregate for each block of columns: for each column its count and a mergeable sketch of fixed size
(`percentile_approx`), from which a ladder of brackets is read around each wanted rank. The second counts, column by
column in arrays, the values below each bracket and those inside it by value; partial counts are made per partition
and only they are shuffled. A bracket that may hold more than `room` values is refined by another sketch of the
values inside it first, so the ranking at the end works on a fixed number of values whatever the table's
size. The answer is that of an exact `percentile`: linear interpolation between the two neighbouring ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import in_pool

LADDER = 5      # widths of brackets asked of a sketch, each eight times the one before
BLOCK = 16      # columns whose sketches one task merges
GRID = 129      # points asked of a sketch of the values inside a bracket


@dataclass
class Bracket:
    """Values between `lo` and `hi` among which ranks `r0` and `r1` (0-based) of a column lie."""

    column: str
    k: int          # which probability
    r0: int
    r1: int
    lo: float
    hi: float
    most: float     # of the rows inside


def _number(c: str) -> str:
    """The column as double; NaN counts as missing, like NULL."""
    return f"nullif(CAST(`{c}` AS DOUBLE), double('NaN'))"


def _brackets(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int) -> tuple[dict[str, int], list[Bracket]]:
    """Counts of the columns, and a bracket for each column with values and each probability. One scan of every column.

    Sketches are merged by one task for each BLOCK of columns, and made in a few partitions for each core, so that what a task
    merges grows with the cores and not with the table's partitions."""
    steps = [2.5 / accuracy * 8 ** s for s in range(LADDER)]
    points = [min(max(p + d, 0.0), 1.0) for p in probabilities for s in steps for d in (-s, s)]
    asked = ", ".join(f"{x!r}D" for x in points)
    few = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)

    def sketch(block: list[str]) -> list[tuple[int, list[float]]]:
        row = few.selectExpr(*[f"{_number(c)} AS `{c}`" for c in block]).selectExpr(*[x for k, c in enumerate(block) for x in (
            f"count(`{c}`) AS n{k}", f"percentile_approx(`{c}`, array({asked}), {accuracy}) AS q{k}")]).first()
        return [(row[f"n{k}"], row[f"q{k}"]) for k in range(len(block))]

    blocks = in_pool(sketch, [columns[k:k + BLOCK] for k in range(0, len(columns), BLOCK)], session=df.sparkSession)
    found = dict(zip(columns, (x for block in blocks for x in block)))
    size = {c: n for c, (n, _) in found.items()}
    out = []
    for c in columns:
        n, values = found[c]
        if not n:
            continue
        for k, p in enumerate(probabilities):
            # the sketch's error in ranks, and two whole ranks for the rounding of few rows
            fit = next((s for s, step in enumerate(steps) if step >= 2.0 / accuracy + 2.0 / n), None)
            lo, hi, most = -math.inf, math.inf, float(n)
            if fit is not None:
                at = 2 * (k * LADDER + fit)
                lo = values[at] if p - steps[fit] > 0 else lo
                hi = values[at + 1] if p + steps[fit] < 1 else hi
                most = min(most, n * (2 * steps[fit] + 4.0 / accuracy) + 4)
            out.append(Bracket(c, k, math.floor(p * (n - 1)), math.ceil(p * (n - 1)), lo, hi, most))
    return size, out


def _refine(df: DataFrame, brackets: list[Bracket], accuracy: int) -> None:
    """Narrow the brackets by a sketch of the values inside each. One scan."""
    grid = [g / (GRID - 1) for g in range(GRID)]
    asked = ", ".join(f"{x!r}D" for x in grid)
    exprs = []
    for k, b in enumerate(brackets):
        x = _number(b.column)
        inside = f"CASE WHEN {x} >= {literal(b.lo)} AND {x} <= {literal(b.hi)} THEN {x} END"
        exprs += [f"count_if({x} < {literal(b.lo)}) AS u{k}", f"count({inside}) AS n{k}",
                  f"percentile_approx({inside}, array({asked}), {accuracy}) AS q{k}"]
    row = df.selectExpr(*exprs).first()
    for k, b in enumerate(brackets):
        n, under, values = row[f"n{k}"], row[f"u{k}"], row[f"q{k}"]
        slack = 2.0 / accuracy + 2.0 / n
        low, high = (b.r0 - under) / n - slack, (b.r1 - under + 1) / n + slack
        first = max((g for g in range(GRID) if grid[g] <= low), default=None)
        last = min((g for g in range(GRID) if grid[g] >= high), default=None)
        b.lo = b.lo if first is None else values[first]
        b.hi = b.hi if last is None else values[last]
        b.most = n * (high - low + 2.0 / (GRID - 1) + 4.0 / accuracy) + 4


def _counted(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(b, value, n): how often each value stands inside bracket b; a NULL value: the values below the bracket. One scan."""
    columns = sorted({b.column for b in brackets})
    own = {c: [k for k, b in enumerate(brackets) if b.column == c] for c in columns}
    lows, highs = np.array([b.lo for b in brackets]), np.array([b.hi for b in brackets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under = np.zeros(len(lows), np.int64)
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in lows]
        for batch in batches:
            for j, c in enumerate(columns):
                x = batch.column(j).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)])
                ks = own[c]
                first, last = np.searchsorted(x, lows[ks], "left"), np.searchsorted(x, highs[ks], "right")
                under[ks] += first
                for k, a, z in zip(ks, first, last):
                    if z > a:
                        held[k].append(np.unique(x[a:z], return_counts=True))
                        if len(held[k]) > 64:
                            held[k] = [_merged(held[k])]
        parts = [(k, *_merged(h)) for k, h in enumerate(held) if h]
        b = np.concatenate([np.arange(len(lows)), *[np.full(len(v), k) for k, v, _ in parts]])
        value = np.concatenate([np.full(len(lows), np.nan), *[v for _, v, _ in parts]])
        n = np.concatenate([under, *[c for *_, c in parts]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int32()), pa.array(value, from_pandas=True), pa.array(n, pa.int64())], ["b", "value", "n"])

    wide = df.selectExpr(*[f"{_number(c)} AS `{c}`" for c in columns])
    return wide.mapInArrow(run, "b int, value double, n long").groupBy("b", "value").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000,
                    room: int = 100_000) -> dict[str, list[float | None]]:
    """{column: quantiles in the order of `probabilities`}; None where a column has no value. NULL and NaN are left out.

    Two scans of `df`, and one more for each time that some bracket may hold over `room` rows (beyond about 2 x 10^8
    rows). Only a few numbers per column and probability reach the driver."""
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if not columns:
        return out
    size, brackets = _brackets(df, columns, probabilities, accuracy)
    if not brackets:
        return out
    while wide := [b for b in brackets if b.most > room and b.lo < b.hi]:
        before = [b.most for b in wide]
        _refine(df, wide, accuracy)
        if all(b.most >= m for b, m in zip(wide, before)):
            break  # as narrow as the sketch can tell; what is left is counted by value
    # the values of a bracket are ranked in one window of at most `room` rows
    facts = df.sparkSession.createDataFrame([(k, b.r0, b.r1) for k, b in enumerate(brackets)], "b INT, r0 BIGINT, r1 BIGINT")
    upto = F.sum("n").over(Window.partitionBy("b").orderBy(F.col("value").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0))
    # one row for each column and probability
    ranked = _counted(df, brackets).withColumn("upto", upto).join(F.broadcast(facts), "b")

    def at(r: str):
        return F.max(F.when((F.col("upto") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("upto")), F.col("value")))

    for row in ranked.groupBy("b").agg(at("r0").alias("v0"), at("r1").alias("v1")).collect():
        b, v0, v1 = brackets[row["b"]], row["v0"], row["v1"]
        if v0 is None or v1 is None:
            raise RuntimeError(f"a bracket of {b.column} missed its rank; did the input change between two scans?")
        position = probabilities[b.k] * (size[b.column] - 1)
        low, high = math.floor(position), math.ceil(position)
        out[b.column][b.k] = v0 if low == high or v0 == v1 else (high - position) * v0 + (position - low) * v1
    return out


def literal(x: float) -> str:
    return f"double('{'Infinity' if x > 0 else '-Infinity'}')" if math.isinf(x) else f"{x!r}D"
