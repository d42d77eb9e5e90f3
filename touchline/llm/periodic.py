"""Periodic runs of words: an enhanced suffix array with the branching-tandem test.

All texts of a slice share one suffix array over (document, word); suffixes of different
documents never compare equal, so every LCP interval lies in one document. There are no tree nodes:
an interval of depth d is a stretch of the array bounded by smaller LCP values, its children are the stretches
between the LCP values equal to d. For each suffix of all children but the largest, ISA[i + d] and ISA[i - d] are looked up: a suffix of
the same interval but of another child means a square of period d that cannot be rotated to the right (a
branching tandem repeat). It is rotated to the left as far as it goes; the squares of one stretch merge into
its run, whose period is the least that is found for it.

The ranks of every doubling round are kept (one int32 a word and round) and answer the LCP and the rotations. A
slice holds about SLICE_WORDS words, or one longer text, so memory grows with the longest text alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import small_batches

SLICE_WORDS = 300_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _suffix_array(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, of each doubling round, the ranks by the first 2^round words (the last are the inverse).

    end: of each word, where its document ends. Ranks have one more place at the end, of a value like no other."""
    n = len(ids)
    key = doc * (int(ids.max()) + 1) + ids
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.repeat(first, size)
    levels = [rank]
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places of the array whose suffix is not alone in its group
    k = 1
    while len(open_):
        i = sa[open_]
        to = i + k
        second = np.where(to < end[i], rank[np.minimum(to, n)], -1).astype(np.int64)
        key = rank[i].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        sa[open_] = i
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        rank = rank.copy()
        rank[i] = np.repeat(open_[first], size)
        levels.append(rank)
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    return sa, levels


def _common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], back: bool = False) -> np.ndarray:
    """Number of equal words of the suffixes at a and b (not the same), or before a and b."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, rank = 1 << k, levels[k]
        if back:
            x, y = a - got - step, b - got - step
            fits = (x >= 0) & (y >= 0)
            same = fits & (rank[np.where(fits, x, -1)] == rank[np.where(fits, y, -1)])
        else:
            same = rank[a + got] == rank[b + got]
        got[same] += step
    return got


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every place p with an LCP value d > 0 to the place before: (p, the last place before with a value
    of d at most, with less than d, the next place with less than d)."""
    at = np.flatnonzero(lcp)
    le, less, after = {}, {}, {}
    held: list[tuple[int, int]] = []  # (value, place), values ascending
    last = -2
    for p, d in zip(at.tolist(), lcp[at].tolist()):
        if p != last + 1:
            for _, q in held:
                after[q] = last + 1
            held = [(0, p - 1)]
        while held[-1][0] > d:
            after[held.pop()[1]] = p
        value, q = held[-1]
        le[p] = q
        less[p] = less[q] if value == d else q
        held.append((d, p))
        last = p
    for _, q in held:
        after[q] = last + 1
    n = len(at)
    out = [np.fromiter(map(m.__getitem__, at.tolist()), np.int64, n) for m in (le, less, after)]
    return at, *out


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def find(sequences: list[list], min_length: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of hashable words, by start, then period.

    A run is a stretch with least period q, of `min_length` and 2q words at least, that neither neighbour extends. An
    empty sequence has none."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    n = int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not n:
        return out
    number: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(sequences)), np.int64, n)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sa, levels = _suffix_array(ids, doc, ends[doc])
    isa = levels[-1]
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    if not len(near):
        return out
    lcp[near] = _common(sa[near - 1], sa[near], levels)
    at, le, less, after = _bounds(lcp)
    depth = lcp[at]
    # children: the stretch before each place of an interval, and the one after its last place
    nxt = np.full(n + 1, -1, np.int64)
    same = lcp[le] == depth
    nxt[le[same]] = at[same]
    last = np.flatnonzero(nxt[at] < 0)
    lo, hi = np.r_[le, at[last]], np.r_[at, after[last]]
    left, right, d = np.r_[less, less[last]], np.r_[after, after[last]], np.r_[depth, depth[last]]
    order = np.lexsort((hi - lo, right, left))
    lo, hi, left, right, d = (x[order] for x in (lo, hi, left, right, d))
    smaller = np.r_[(left[1:] == left[:-1]) & (right[1:] == right[:-1]), False]  # all but the largest of an interval
    lo, hi, left, right, d = (x[smaller] for x in (lo, hi, left, right, d))
    size = hi - lo
    place = _ranges(lo, size)
    lo, hi, left, right, d = (np.repeat(x, size) for x in (lo, hi, left, right, d))
    i = sa[place]
    squares = []
    for first, other in ((i, i + d), (i - d, i - d)):
        there = isa[np.where((other >= 0) & (other < n), other, n)]
        hit = (there >= left) & (there < right) & ((there < lo) | (there >= hi))
        squares.append(np.stack((first[hit], d[hit]), axis=1))
    found = np.unique(np.concatenate(squares), axis=0)
    if not len(found):
        return out
    i, d = found.T
    start, stop = i - _common(i, i + d, levels, back=True), i + 2 * d
    keep = stop - start >= min_length
    start, stop, d = start[keep], stop[keep], d[keep]
    order = np.lexsort((d, stop, start))
    start, stop, d = start[order], stop[order], d[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][:len(start)]
    start, stop, d = start[least], stop[least], d[least]
    order = np.lexsort((d, start))
    for a, z, q in zip(start[order].tolist(), stop[order].tolist(), d[order].tolist()):
        k = int(doc[a])
        out[k].append((a - int(starts[k]), z - a, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for a, length, q in runs:
            step[a + q] += 1
            step[a + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of `docs(doc_id, text, ...)`: the runs of the whole text's words
    as structs of start, length and period, by start, then period, and the text with each run cut to its first period, as words joined by one space.

    Words are stretches of anything but ASCII white space. A null or empty text has no words, no runs (an empty list) and an empty
    collapsed text. Overlapping runs are all listed; of runs over the same stretch there is but one, of the least period. Repeated rows and
    null ids stay; an empty table gives none; other columns are ignored. Rows are independent: no shuffle."""
    small_batches(docs.sparkSession)

    def rows(held: list[list[bytes]]) -> list[tuple]:
        return [(len(w), r, collapse(w, r)) for w, r in zip(held, find(held, min_length))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[bytes]] = []
            size, done = 0, []
            for t in b.column(1):
                w = (t.as_py() or "").encode().split()
                if held and size + len(w) > SLICE_WORDS:
                    done += rows(held)
                    held, size = [], 0
                held.append(w)
                size += len(w)
            done += rows(held)
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for _, own, _ in done], pa.list_(RUN))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k for k, *_ in done], pa.int64()), runs,
                 pa.array([c for *_, c in done], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
