"""BM25 inverted index of benchmark items, searched by block-max WAND.

Items are the indexed documents, training passages the queries. Impacts are
divided by the item's score against itself, so a passage that holds all of an
item's words scores 1 and one threshold serves items of every length.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import regex

_SPACE = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SPACE, b" " * len(_SPACE))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？｡।])\s*|\n+")
CELLS = 1_000_000  # of an index's table of block bounds (float32)
MIN_WORDS = 5  # items of fewer are looked for as exact runs
SEPARATES, JOINS, ALONE, IGNORED = range(4)  # what a character does to words
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}ー]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]")
_IGNORED = "\u00ad\u200c\u200d\u2060\ufeff"  # soft hyphen, joiners


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point does to words."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for found, kind in ((_WORD, JOINS), (_UNSPACED, ALONE)):
        out[np.frombuffer("".join(found.findall(every)).encode("utf-32-le"), np.uint32)] = kind
    marks = "".join(regex.findall(r"\p{M}", every))  # they stay with the character before
    out[np.frombuffer(marks.encode("utf-32-le"), np.uint32)] = JOINS
    out[[ord(c) for c in _IGNORED]] = IGNORED
    return out


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in compatibility form; every character but letters, marks and digits separates.
    In scripts written without spaces each character with its marks is a word."""
    low = (text or "").lower()
    if low.isascii():
        return low.encode().translate(_TABLE).split()
    points = np.frombuffer(unicodedata.normalize("NFKC", low).encode("utf-32-le", "replace"), np.uint32)
    kinds = _kinds()[points]
    out = np.where(kinds == SEPARATES, np.uint32(32), points)
    alone = kinds == ALONE
    if alone.any():
        # a space before each, and before a letter (not a mark) after one
        before = np.r_[False, alone[:-1]]
        marks = np.fromiter((unicodedata.category(chr(p))[0] == "M" for p in points[before]), bool, before.sum())
        after = np.zeros(len(points), bool)
        after[before] = ~marks
        held = np.flatnonzero(before)[marks]  # marks carry their character on
        for k in held.tolist():
            while k + 1 < len(points) and kinds[k + 1] == JOINS and unicodedata.category(chr(points[k + 1]))[0] == "M":
                k += 1
            if k + 1 < len(points):
                after[k + 1] = True
        at = np.flatnonzero(alone | after)
        out, kinds = np.insert(out, at, 32), np.insert(kinds, at, SEPARATES)
    out = out[kinds != IGNORED]
    return out.astype("<u4").tobytes().decode("utf-32-le").encode().split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words up to its last sentence, and that sentence's; the last third where there is one sentence
    only or the last has fewer than three words."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) > 1 and len(parts[-1]) >= 3:
        return [w for p in parts[:-1] for w in p], parts[-1]
    flat = [w for p in parts for w in p]
    cut = max(1, len(flat) - max(1, len(flat) // 3))
    return flat[:cut], flat[cut:]


def _grams(w: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def span(n_words: int) -> int:
    """Words among which all of an item of `n_words` words must stand, edits included."""
    return 2 * max(n_words, 8)


class Index:
    """items: (item_id, text). Items of fewer than `min_words` words are looked for word by word, as exact runs.

    stats: (items, mean number of words, items that hold a term) of the whole benchmark, of which `items` may be a
    part; taken from `items` if not given. Scores are then the same whichever items share an index."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, block: int = 4,
                 min_words: int = MIN_WORDS, stats: tuple[int, float, dict[bytes, int]] | None = None):
        bags = sorted(((i, t, Counter(words(t))) for i, t in items), key=lambda x: (sum(x[2].values()), x[0]))
        self.short: dict[bytes, dict[tuple[bytes, ...], list[int]]] = {}  # first word -> run -> items
        for i, t, c in bags:
            if 0 < sum(c.values()) < min_words:
                run = tuple(words(t))
                self.short.setdefault(run[0], {}).setdefault(run, []).append(i)
        bags = [x for x in bags if sum(x[2].values()) >= min_words]
        self.items = [(i, *question_and_answer(t)) for i, t, _ in bags]
        sizes = [sum(c.values()) for *_, c in bags]
        self.longest = max(sizes, default=0)
        df = Counter(t for *_, c in bags for t in c)
        total, mean, every = stats or (len(bags), sum(sizes) / len(sizes) if sizes else 1.0, df)
        idf = {t: math.log(1 + (total - every[t] + 0.5) / (every[t] + 0.5)) for t in df}
        self.vocab = {t: k for k, t in enumerate(sorted(df))}
        # the table of block bounds is dense, so it is held to a fixed size
        self.block = block = max(block, -(-len(bags) * len(df) // CELLS))
        self.n_blocks = -(-len(bags) // block)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for d, ((*_, c), size) in enumerate(zip(bags, sizes)):
            impact = {t: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)) for t, tf in c.items()}
            own = sum(impact.values())
            for t, v in impact.items():
                postings[self.vocab[t]].append((d, v / own))
        self.postings = postings  # by term: (item, impact), items ascending (shortest items first)
        self.most = [max(v for _, v in p) for p in postings]
        self._essential(len(bags))
        self.block_most = np.zeros((len(postings), self.n_blocks), np.float32)  # a bound for each block of items
        for k, p in enumerate(postings):
            for d, v in p:
                self.block_most[k, d // block] = max(self.block_most[k, d // block], v)

    def term_ids(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int64, len(w))

    def search(self, terms: list[int], threshold: float, only: list[int] | None = None) -> list[tuple[int, float]]:
        """All items scoring at least `threshold` against the distinct `terms`: (item, score); of the items `only` (ascending)
        where given, which the cursors then jump between.

        Document-at-a-time with pivots: cursors are kept by their next item; the
        pivot is the first item that the terms' greatest impacts could lift over
        the threshold. If the bounds of the pivot's block can't, all items of the
        block are jumped over; otherwise the pivot is scored."""
        eps = 1e-6  # bounds are float32
        out = []
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for item, _, t in cursors:
                bound += self.most[t]
                if bound >= threshold - eps:
                    pivot = item
                    break
            if pivot is None:
                return out
            if only is not None:
                k = bisect_left(only, pivot)
                if k == len(only):
                    return out
                if only[k] > pivot:
                    for c in cursors:
                        if c[0] < only[k]:
                            self._seek(c, only[k])
                    cursors = [c for c in cursors if c[0] < math.inf]
                    continue
            blk = pivot // self.block
            target = (blk + 1) * self.block
            if sum(self.block_most.item(t, blk) for item, _, t in cursors if item < target) >= threshold - eps:
                score = 0.0
                for c in cursors:
                    if c[0] > pivot:
                        break
                    self._seek(c, pivot)
                    if c[0] == pivot:
                        score += self.postings[c[2]][c[1]][1]
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
                target = pivot + 1
            for c in cursors:
                if c[0] < target:
                    self._seek(c, target)
            cursors = [c for c in cursors if c[0] < math.inf]
        return out

    def _seek(self, cursor: list, item: int) -> None:
        p = self.postings[cursor[2]]
        lo, hi = cursor[1], len(p)
        while lo < hi:
            mid = (lo + hi) // 2
            if p[mid][0] < item:
                lo = mid + 1
            else:
                hi = mid
        cursor[0], cursor[1] = (p[lo][0], lo) if lo < len(p) else (math.inf, lo)

    def passages(self, n_words: int) -> list[tuple[int, int]]:
        """Windows of four times the longest item, half overlapping: every item's span lies in one."""
        step = span(self.longest)
        return [(a, min(a + 2 * step, n_words)) for a in range(0, max(n_words - step, 1), step)]

    def best_span(self, d: int, w: list[bytes], ids: np.ndarray, threshold: float, question: float,
                  answer: float) -> tuple[float, float, float] | None:
        """The best (score, question overlap, answer overlap) that reaches the limits within a span of twice the
        item's own length, overlaps as shares of the part's word trigrams (shorter parts: the whole part)."""
        _, *parts = self.items[d]
        size = span(sum(map(len, parts)))
        impact = {}
        for t in sorted({self.vocab[x] for part in parts for x in part}):
            cursor = [0, 0, t]
            self._seek(cursor, d)
            impact[t] = self.postings[t][cursor[1]][1]
        at = np.flatnonzero(np.isin(ids, list(impact))).tolist()
        grams = [_grams(part) for part in parts]
        runs = []  # of each part: where its grams stand, as (start, end, gram)
        for part, own in zip(parts, grams):
            n = min(3, len(part))
            runs.append([(k, k + n, g) for k in at if (g := tuple(w[k:k + n])) in own])
        held: Counter = Counter()
        seen: list[Counter] = [Counter(), Counter()]
        to, first, last = 0, [0, 0], [0, 0]
        score, best = 0.0, None
        for k in at:
            while to < len(at) and at[to] < k + size:
                t = int(ids[at[to]])
                score += 0.0 if held[t] else impact[t]
                held[t] += 1
                to += 1
            for p, run in enumerate(runs):
                while last[p] < len(run) and run[last[p]][1] <= k + size:
                    seen[p][run[last[p]][2]] += 1
                    last[p] += 1
                while first[p] < last[p] and run[first[p]][0] < k:
                    g = run[first[p]][2]
                    seen[p][g] -= 1
                    if not seen[p][g]:
                        del seen[p][g]
                    first[p] += 1
            if score >= threshold - 1e-9:
                q, a = (len(s) / len(g) for s, g in zip(seen, grams))
                if q >= question and a >= answer:
                    now = (math.fsum(impact[t] for t, n in held.items() if n), q, a)
                    best = max(best, now) if best else now
            t = int(ids[k])
            held[t] -= 1
            score -= 0.0 if held[t] else impact[t]
        return best

    def _essential(self, n_items: int, share: float = 0.7) -> None:
        """Essential lists: of each item the fewest terms of greatest impact that hold `share` of its score, as postings
        by term in flat arrays. A passage scores no more than what it has of these, and all of the rest."""
        own: list[list[tuple[float, int]]] = [[] for _ in range(n_items)]
        for t, p in enumerate(self.postings):
            for d, v in p:
                own[d].append((v, t))
        self.rest = np.zeros(n_items)
        self.terms_of: list[np.ndarray] = []
        rows, others = [], []
        for d, terms in enumerate(own):
            self.terms_of.append(np.array(sorted(t for _, t in terms), np.int64))
            terms.sort(key=lambda x: (-x[0], x[1]))
            held = 0.0
            for k, (v, t) in enumerate(terms):
                if held >= share:
                    self.rest[d] = math.fsum(x for x, _ in terms[k:])
                    others += [(d, t, v) for v, t in terms[k:]]
                    break
                held += v
                rows.append((t, d, v))
        rows.sort()
        self.essential_at = np.searchsorted(np.array([t for t, *_ in rows], np.int64), np.arange(len(self.postings) + 1))
        self.essential_item = np.array([d for _, d, _ in rows], np.int64)
        self.essential_impact = np.array([v for *_, v in rows], np.float64)
        # the rest by item
        self.rest_at = np.searchsorted(np.array([d for d, *_ in others], np.int64), np.arange(n_items + 1))
        self.rest_term = np.array([t for _, t, _ in others], np.int64)
        self.rest_impact = np.array([v for *_, v in others], np.float64)

    def hopeful(self, ids: np.ndarray, windows: list[tuple[int, int]], threshold: float) -> list[tuple[int, list[int]]]:
        """(window, items that can reach the threshold in it): first by the essential lists of their terms, then, for the items
        that are left, with the rest of the item's terms. No other item reaches it.

        The work follows the entries of rare terms that the windows meet, not the size of the index."""
        at = np.nonzero(ids >= 0)[0]
        if not len(at):
            return []
        starts = np.array([a for a, _ in windows])
        ends = np.array([z for _, z in windows])
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
        n = hi - lo
        window = np.repeat(np.arange(len(windows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(window * len(self.vocab) + ids[at[np.repeat(lo, n) + within]])
        if not len(pair):
            return []
        window, term = pair // len(self.vocab), pair % len(self.vocab)
        size = self.essential_at[term + 1] - self.essential_at[term]
        entry = np.repeat(self.essential_at[term] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        items = len(self.items)
        cell = np.repeat(window, size) * items + self.essential_item[entry]
        score = np.bincount(cell, self.essential_impact[entry], len(windows) * items).reshape(-1, items)
        w, d = np.nonzero((score + self.rest >= threshold - 1e-6) & (score > 0))
        size = self.rest_at[d + 1] - self.rest_at[d]
        of = np.repeat(np.arange(len(d)), size)
        entry = np.repeat(self.rest_at[d] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        wanted = w[of] * len(self.vocab) + self.rest_term[entry]
        there = pair[np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)] == wanted
        total = score[w, d] + np.bincount(of, self.rest_impact[entry] * there, len(d))
        reach = total >= threshold - 1e-6
        w, d = w[reach], d[reach]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]][:len(w)]).tolist()
        return [(int(w[a]), d[a:z].tolist()) for a, z in zip(first, [*first[1:], len(w)])]

    def leaks(self, text: str | None, threshold: float, question: float, answer: float,
              chunk: int = 1 << 18) -> dict[int, tuple[float, float, float]]:
        """item_id -> best (score, question overlap, answer overlap) of the verified passages of a whole text."""
        return self.leaks_in(words(text), threshold, question, answer, chunk)

    def leaks_in(self, w: list[bytes], threshold: float, question: float, answer: float,
                 chunk: int = 1 << 18) -> dict[int, tuple[float, float, float]]:
        found: dict[int, tuple[float, float, float]] = {}
        if self.short:
            for k in [k for k, t in enumerate(w) if t in self.short]:
                runs = self.short[w[k]]
                for n in {len(r) for r in runs}:
                    found.update((i, (1.0, 1.0, 1.0)) for i in runs.get(tuple(w[k:k + n]), ()))
        if not w or not self.items:
            return found
        ids = self.term_ids(w)
        every = self.passages(len(w))
        # the scores of a chunk's windows are one table, of 8 MB or one window
        per = max(1, min(chunk // span(self.longest), (1 << 20) // len(self.items)))
        for k in range(0, len(every), per):
            part = every[k:k + per]
            base, end = part[0][0], part[-1][1]
            local = [(a - base, z - base) for a, z in part]
            for i, items in self.hopeful(ids[base:end], local, threshold):
                a, z = part[i]
                terms = np.intersect1d(ids[a:z], np.concatenate([self.terms_of[d] for d in items]))
                for d, _ in self.search(terms.tolist(), threshold, items):
                    best = self.best_span(d, w[a:z], ids[a:z], threshold, question, answer)
                    if best:
                        item = self.items[d][0]
                        found[item] = max(found.get(item, (0.0, 0.0, 0.0)), best)
        return found
