"""Quality rules by tokeniser fertility, with rejection bands per language or script.

A public vocabulary with byte fallback tokenises every word. Measures of a text:
characters per token, share of byte-fallback tokens, and token entropy (over its
possible maximum). The bands are the quartiles of a group's texts, widened
by `reach` interquartile ranges and at least by a fixed margin; the group is the language
where it is given, else the text's most frequent script.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import small_batches, stage

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 512  # tokens of an entropy window; the last one takes the rest
MEASURES = {"chars_per_token": 0.25, "byte_share": 0.02, "entropy": 0.05}  # with the least half-width of a band

# First code points of blocks and their scripts ("" for blocks without letters of one script).
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
           (0x600, "arabic"), (0x700, ""), (0x900, "indic"), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"),
           (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"),
           (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"),
           (0xFB00, ""), (0x20000, "han"), (0x30000, ""))
_STARTS = np.array([a for a, _ in SCRIPTS])


def script(text: str) -> str:
    """The script of most letters of the whole text, `none` without any."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    points = points[(points > 0xAA) | ((points | 32) - 97 < 26)]
    hits = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1, minlength=len(SCRIPTS))
    counts = Counter()
    for n, (_, name) in zip(hits.tolist(), SCRIPTS):
        if name and n:
            counts[name] += n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "none"


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if windows:
        times = Counter(windows)
        if len(times) < len(windows):
            twice = np.zeros(n + 2, bool)
            again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
            for k in range(3):
                twice[k:k + len(windows)] |= again
            covered = int(twice.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), covered


class Fertility:
    """Tokenises words by a SentencePiece model, each distinct word once while it is remembered."""

    def __init__(self, path: str, memo: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.memo = memo
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.memo:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            self.known[w] = np.array(ids, np.uint32).tobytes()

    def measures(self, words: list[bytes], chars: int) -> tuple[int, float | None, float | None, float | None]:
        """(tokens, characters per token, byte share, entropy) of a text's words; None without tokens."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)
        n = len(ids)
        if not n:
            return 0, None, None, None
        # entropy of each window of tokens over its own possible maximum, so that it doesn't fall with length
        last = max(n // WINDOW, 1) - 1
        window = np.minimum(np.arange(n) // WINDOW, last)
        keys, counts = np.unique(window * self.model.vocab_size() + ids, return_counts=True)
        sizes = np.bincount(window).astype(float)
        inner = np.bincount(keys // self.model.vocab_size(), counts * np.log2(counts), last + 1) / sizes
        h = float((sizes * (1 - inner / np.log2(np.maximum(sizes, 2)))).sum() / n)
        return n, round(chars / n, 2), round(float(self.is_byte[ids].mean()), 3), round(h, 3)


@lru_cache(maxsize=2)
def _fertility(path: str) -> Fertility:
    return Fertility(path)


def measure(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Base counts and fertility measures per row of `docs(doc_id, text, lang, ...)`; a null text is an empty one."""
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _fertility(vocabulary)
        for b in batches:
            base, found, groups = [], [], []
            texts = b.column(2).to_pylist()
            for k in range(0, len(texts), 100):
                split = [t.encode().split() for t in texts[k:k + 100]]
                tokens.learn(set().union(*split))
                for t, w in zip(texts[k:k + 100], split):
                    base.append(base_counts(t, w))
                    found.append(tokens.measures(w, base[-1][1]))
            for t, lang in zip(texts, b.column(1).to_pylist()):
                groups.append(lang if lang is not None else f"script:{script(t)}")
            cols = [pa.array([r[k] for r in base], pa.int64()) for k in range(5)]
            cols.append(pa.array([r[0] for r in found], pa.int64()))
            cols += [pa.array([r[k] for r in found], pa.float64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.string()), *cols],
                                             ["doc_id", "grp", *names, *MEASURES])

    schema = "doc_id long, grp string, " + ", ".join(f"{n} long" for n in names) + \
        ", " + ", ".join(f"{m} double" for m in MEASURES)
    return docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def bands(measured: DataFrame, reach: float = 3.0, least_docs: int = 30) -> DataFrame:
    """(grp, low, high and width of each measure): exact quartiles of the texts that pass the base rules, from
    counts of the rounded values. Groups of fewer than `least_docs` such texts get no band."""
    values = measured.where("not base_failed and n_tokens > 0").select(
        "grp", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
    counts = values.groupBy("grp", "measure", "value").agg(F.count("*").alias("n"))
    q = counts.groupBy("grp", "measure").agg(
        F.sum("n").alias("docs"), F.expr("percentile(value, array(0.25, 0.75), n)").alias("q")).where(
        F.col("docs") >= least_docs)
    margin = F.lit(0.0)
    for m, least in MEASURES.items():
        margin = F.when(F.col("measure") == m, least).otherwise(margin)
    wide = F.greatest(reach * (F.col("q")[1] - F.col("q")[0]), margin)
    q = q.select("grp", "measure", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), wide.alias("wide"))
    return q.groupBy("grp").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
        for m in MEASURES for side in ("low", "high", "wide")])


def judge(docs: DataFrame, vocabulary: str = VOCABULARY, reach: float = 3.0, least_docs: int = 30,
          steady_words: int = 200) -> DataFrame:
    """One row per row of `docs(doc_id, text, lang, ...)`: base counts, base_failed, the measures and kept.

    kept: not base_failed, and every measure within its group's band. Null texts are empty ones (they fail the
    base rules). Repeated rows stay repeated; an empty table gives none."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = stage(measure(docs, vocabulary).withColumn("base_failed", failed), "fertility")
    out = measured.join(bands(measured, reach, least_docs), "grp", "left")
    # few words give noisy measures: below `steady_words` the band widens with the standard error
    slack = F.greatest(F.lit(1.0), F.sqrt(steady_words / F.greatest(F.col("n_words"), F.lit(1))))
    inside = F.lit(True)
    for m in MEASURES:
        reached = slack * F.col(f"{m}_wide")
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low") - reached, F.col(f"{m}_high") + reached),
                                     F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "n_tokens", *MEASURES, (~F.col("base_failed") & inside).alias("kept"))
