"""Substring dedup: repeats of `length` words or more go wherever a document with a smaller id has them.

Seed. Winnowing picks from every `length` consecutive words the k-grams of least hash, so two documents that share such a
stretch share an anchor at the same place in it. Documents are joined on their anchors; an anchor that one document
alone has ends there.

Extend. A shared anchor is extended both ways, to each stretch of `length` words of which it is the anchor: one
extension for each split of the missing words between left and right. Extending pair by pair would list all pairs of an
anchor's documents; here the documents in which an anchor extends alike meet under the hash of the stretch, and each learns whether
one with a smaller id is among them. Overlapping stretches that do merge into maximal repeats.

Hot groups. Before either shuffle a task settles what its own batch of texts can tell: an anchor that two of its documents have is known to
be shared, and a stretch that a smaller document of the batch has is known to go. So a batch sends one row for each key,
however many documents have it, and no key gathers more rows than there are batches. What is asked and answered is (key, document), so nothing depends on
the order of rows or on the attempt of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import columns_in_chunks, small_batches

GRAM = 5  # words of an anchor
WORDS_KNOWN = 500_000  # hashes of words that a worker remembers
ANCHOR, STRETCH, CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93  # odd multipliers, one for each use
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
ASKS, TELLS, ANSWERED = 0, 1, 2


class _Hashes(dict):
    """Hashes of the words met before, up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _stretches(h: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Hash of the n words from each place; zero at the last n - 1 places. Polynomials modulo 2^64 over word hashes, mixed."""
    out = np.zeros(len(h), np.uint64)
    if len(h) < n:
        return out
    up = np.full(len(h), multiplier, np.uint64).cumprod()
    down = np.full(len(h), pow(multiplier, -1, 1 << 64), np.uint64).cumprod()
    total = np.r_[np.uint64(0), (h * up).cumsum()]
    x = (total[n:] - total[:-n]) * down[:len(h) - n + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out[:len(x)] = x ^ (x >> np.uint64(29))
    return out


def _slide(x: np.ndarray, width: int, pick: Callable, fill: np.uint64) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width], with `fill` beyond the end."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = pick(x, np.r_[x[step:], np.full(min(step, len(x)), fill, x.dtype)])
        reach += step
    return x


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Texts:
    """The words of several texts in one array: hashes, text numbers, words left to the end of the text."""

    def __init__(self, texts: list[str | None], known: dict[bytes, int]):
        # the words of one text at a time: only their hashes stay
        parts = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in map(split, texts)]
        size = np.array([len(h) for h in parts], np.int64)
        ends = np.cumsum(size)
        self.size, self.starts = size, ends - size
        self.h = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.doc = np.repeat(np.arange(len(size)), size)
        self.left = ends[self.doc] - np.arange(len(self.h))

    def anchor_keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(key of the k-gram at each place, least key of the stretch of `length` words from each place, or 0)."""
        gram = min(GRAM, length)
        key = _stretches(self.h, gram, ANCHOR)
        return key, np.where(self.left >= length, _slide(key, length - gram + 1, np.minimum, _MAX), np.uint64(0))

    def anchors(self, length: int) -> np.ndarray:
        """Places whose k-gram has the least key of some stretch around it (equal least keys: all of them)."""
        key, least = self.anchor_keys(length)
        width = length - min(GRAM, length) + 1  # the stretches that begin at a place or just before it
        most = _slide(least[::-1], width, np.maximum, np.uint64(0))[::-1]
        return np.flatnonzero((key == most) & (most > 0))


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_QUESTION = "key long, mark int, doc long, kind int"


def _asked(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, smaller: bool) -> pa.RecordBatch:
    """What a batch sends for its (key, mark, document): does another document - or a smaller one - have the key?"""
    order = np.lexsort((doc, mark, key))
    key, mark, doc = key[order], mark[order], doc[order]
    once = _groups(key, mark, doc)
    key, mark, doc = key[once], mark[once], doc[once]
    at = _groups(key, mark)
    size = np.diff(np.r_[at, len(key)])
    rank = np.arange(len(key)) - np.repeat(at, size)  # 0: the smallest document of the key
    if smaller:
        columns = [key, mark, doc, np.where(rank > 0, ANSWERED, ASKS)]
    else:
        shared = np.repeat(size > 1, size)
        speaks = shared & (rank == 0)
        columns = [np.r_[key, key[speaks]], np.r_[mark, mark[speaks]], np.r_[doc, doc[speaks]],
                   np.r_[np.where(shared, ANSWERED, ASKS), np.full(speaks.sum(), TELLS)]]
    # neighbours of one document and kind: all but the key then repeats in the shuffle's blocks, which compress it away
    order = np.lexsort((columns[3], columns[2]))
    key, mark, doc, kind = (c[order] for c in columns)
    return _batch([key, mark, doc, kind.astype(np.int32)], _QUESTION)


def _answers(questions: DataFrame, smaller: bool) -> DataFrame:
    """(doc, keys): of each document the keys for which the answer is yes."""
    out = "key long, doc long"

    def settle(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        known = kind == ANSWERED
        first = [key[known], doc[known]]
        key, mark, doc, kind = key[~known], mark[~known], doc[~known], kind[~known]
        yes = np.zeros(len(key), bool)
        if len(key):
            order = np.lexsort((doc, mark, key))
            key, mark, doc, kind = key[order], mark[order], doc[order], kind[order]
            at = _groups(key, mark)
            size = np.diff(np.r_[at, len(key)])
            low = np.repeat(doc[at], size)
            several = np.repeat((doc[at] < doc[at + size - 1]) | (np.maximum.reduceat(kind, at) == TELLS), size)
            yes = (doc > low) if smaller else several & (kind == ASKS)
        return _batch([np.r_[first[0], key[yes]], np.r_[first[1], doc[yes]]], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in columns_in_chunks(batches):
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield settle(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield settle(*held)

    # what is answered already need not meet its key, which may be hot
    to = F.when(F.col("kind") == ANSWERED, F.xxhash64("key", "doc")).otherwise(F.col("key"))
    dealt = questions.repartition(to).sortWithinPartitions("key")
    return dealt.mapInArrow(run, out).groupBy("doc").agg(F.collect_set("key").alias("keys"))


def _holds(texts: Texts, value: np.ndarray, keys: pa.ListArray) -> np.ndarray:
    """Whether each place's value is among the keys of its own text."""
    out = np.zeros(len(value), bool)
    offsets, flat = keys.offsets.to_numpy(), keys.values.to_numpy().view(np.uint64)
    ends = np.r_[texts.starts[1:], len(value)]
    for k in np.flatnonzero(np.diff(offsets)).tolist():
        a, z = texts.starts[k], ends[k]
        out[a:z] = np.isin(value[a:z], flat[offsets[k]:offsets[k + 1]])
    return out


def _with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Every row with its document's keys (none: an empty list). Both joins with the texts share one exchange of them."""
    joined = docs.join(keys.hint("merge"), "doc", "left")
    return joined.select("doc", "text", F.coalesce("keys", F.array().cast("array<long>")).alias("keys"))


def repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_words, spans, kept) per row of `docs(doc_id, text, ...)`.

    spans: the maximal stretches (start, length) of words covered by `length` consecutive words whose sequence also stands in
    a document with a smaller doc_id, by start; kept: the other words joined by one space. Stretches are judged on the texts
    as given, not on what is left of them.

    Words are stretches of anything but ASCII white space, unchanged. A null or empty text has no words; a text of fewer than `length`
    words loses none. Repeated rows stay repeated and do not count against each other, nor do different
    texts of one doc_id. A row with a null doc_id has no place in the order: it loses nothing and takes nothing from
    others. An empty table gives none; other columns are ignored. Nothing is capped; identity is by 96-bit hashes of a stretch's words."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")

    def numbers(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = b.column(0)
        return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            ids, valid = numbers(b)
            t = Texts(b.column(1).to_pylist(), known)
            at = t.anchors(length)
            at = at[valid[t.doc[at]]]
            key = t.anchor_keys(length)[0][at].view(np.int64)
            yield _asked(key, np.zeros(len(at), np.int32), ids[t.doc[at]], smaller=False)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            ids, _ = numbers(b)
            t = Texts(b.column(1).to_pylist(), known)
            key, least = t.anchor_keys(length)
            shared = np.where(_holds(t, key, b.column(2)), key, _MAX)
            # the least of the shared keys is the stretch's own anchor
            at = np.flatnonzero((least > 0) & (_slide(shared, length - min(GRAM, length) + 1, np.minimum, _MAX) == least))
            stretch = _stretches(t.h, length, STRETCH)[at].view(np.int64)
            check = (_stretches(t.h, length, CHECK)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield _asked(stretch, check, ids[t.doc[at]], smaller=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
        for b in batches:
            texts = b.column(1).to_pylist()
            t = Texts(texts, known)
            at = np.flatnonzero(_holds(t, _stretches(t.h, length, STRETCH), b.column(2)) & (t.left >= length))
            step = np.zeros(len(t.h) + 1, np.int64)
            step[at] += 1
            step[at + length] -= 1
            gone = np.cumsum(step)[:-1] > 0
            new = gone & np.r_[True, ~gone[:-1] | (t.doc[1:] != t.doc[:-1])][:len(gone)]
            begin = np.flatnonzero(new)
            of = t.doc[begin]
            size = np.add.reduceat(gone, begin, dtype=np.int64) if len(begin) else begin
            lists = np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))]
            spans = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(begin - t.starts[of]), pa.array(size)], fields=list(span)))
            touched = set(of.tolist())
            kept = []
            for k, w in enumerate(map(split, texts)):
                if k in touched:
                    a = t.starts[k]
                    w = [w[i] for i in np.flatnonzero(~gone[a:a + len(w)]).tolist()]
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(t.size), spans, pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "spans", "kept"])

    shared = _answers(own.mapInArrow(seeds, _QUESTION), smaller=False)
    gone = _answers(_with_keys(own, shared).mapInArrow(extended, _QUESTION), smaller=True)
    return _with_keys(own, gone).mapInArrow(
        cut, "doc_id long, n_words long, spans array<struct<start: long, length: long>>, kept string")
