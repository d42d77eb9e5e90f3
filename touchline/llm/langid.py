"""Language identification by hierarchical discrimination.

First the language family is predicted (one linear SVM for each family against
the rest), then, within the family, one-versus-one linear SVMs vote between its
languages. Features: square roots of the relative frequencies of hashed byte
n-grams of the lower-cased letters of the whole text.

The models are fitted on a bounded sample of labelled rows (about
`per_language` rows of each language, chosen by a hash of doc_id).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import held_out, small_batches
from touchline.llm.linear import fit_hinge, ngram_ids, sigmoid

# Families of common language codes (ISO 639-1). Codes not listed form the family "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-iranian": ("hi", "ur", "bn", "pa", "mr", "ne", "gu", "fa", "ps", "ku"),
    "semitic": ("ar", "he", "mt", "am"),
    "east-asian": ("zh", "ja", "ko"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
BITS = 15
ORDERS = range(1, 4)
SHARPNESS = 4.0  # slope of the margins' logistic curve in the score
LEAST_SCORE = 0.5  # a text scoring less is in no learned language, unless learned rows score as low
LEAST_ROWS = 50   # a limit for rejection is not taken from fewer rows

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def profile(text: str | None) -> np.ndarray | None:
    """Feature vector of unit length for each order; None without any letter."""
    if not text or _LETTER.search(text) is None:
        return None
    clean = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    counts = np.bincount(ngram_ids(clean.encode(), ORDERS, BITS), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum(), dtype=np.float64).astype(np.float32)


@dataclass
class Model:
    families: list[tuple[str, list[str]]]
    family_w: np.ndarray            # dims x families
    family_b: np.ndarray
    pairs: dict[str, list[tuple[int, int, int]]]  # family -> (first, second, column of pair_w)
    pair_w: np.ndarray
    pair_b: np.ndarray
    limit: float = 0.0              # texts that score less are rejected

    def predict(self, text: str | None) -> tuple[str, float]:
        x = profile(text)
        return (UNKNOWN, 0.0) if x is None or not self.families else self.decide(x)

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        score, pick = 1.0, 0
        if len(self.families) > 1:
            m = x @ self.family_w + self.family_b
            pick = int(m.argmax())
            score = sigmoid(SHARPNESS * m[pick])
        family, langs = self.families[pick]
        if len(langs) == 1:
            return langs[0], score
        m = x @ self.pair_w + self.pair_b
        votes, total, least = np.zeros(len(langs)), np.zeros(len(langs)), np.full(len(langs), np.inf)
        for a, b, k in self.pairs[family]:
            votes[a if m[k] >= 0 else b] += 1
            total[a] += m[k]
            total[b] -= m[k]
            least[a], least[b] = min(least[a], m[k]), min(least[b], -m[k])
        best = max(range(len(langs)), key=lambda i: (votes[i], total[i]))
        return langs[best], score * sigmoid(SHARPNESS * least[best])


def fit(langs: list[str], profiles: list[tuple[np.ndarray, np.ndarray]], c: float = 20.0) -> Model:
    """Fit on (lang, sparse profile) examples."""
    dims = 1 << BITS
    names = sorted(set(langs))
    label = np.array(langs, dtype=object)
    family_of = {n: FAMILY_OF.get(n, "other") for n in names}
    families = [(f, [n for n in names if family_of[n] == f]) for f in sorted(set(family_of.values()))]

    def svm(rows: np.ndarray, positive: np.ndarray):
        y = np.where(positive, 1.0, -1.0)
        weights = np.where(positive, len(y) / (2 * positive.sum()), len(y) / (2 * (~positive).sum()))
        return fit_hinge([profiles[i] for i in rows], y, dims, c, weights=weights)

    own = np.array([family_of[n] for n in langs], dtype=object)
    every = np.arange(len(langs))
    fam = [svm(every, own == f) for f, _ in families] if len(families) > 1 else []
    pairs, cols = {}, []
    for f, members in families:
        pairs[f] = []
        for a, b in itertools.combinations(range(len(members)), 2):
            rows = np.nonzero((label == members[a]) | (label == members[b]))[0]
            pairs[f].append((a, b, len(cols)))
            cols.append(svm(rows, label[rows] == members[a]))

    def pack(models):
        w = np.stack([m[0] for m in models], axis=1) if models else np.zeros((dims, 0))
        return w.astype(np.float32), np.array([m[1] for m in models], np.float32)

    return Model(families, *pack(fam), pairs, *pack(cols))


def reject_limit(model: Model, langs: list[str], profiles: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The score under which a text is in no learned language, from the learned rows' scores by models of the other half.

    LEAST_SCORE, or a quarter of the way from the score of no evidence (the biases alone) to the rows' lowest
    hundredth if that is more; never less below the lowest hundredth than that lies below the median, so clean rows stay."""
    if len(langs) < LEAST_ROWS:
        return 0.0
    scores = []
    for k in (0, 1):
        other = fit(langs[1 - k::2], profiles[1 - k::2])
        for ids, values in profiles[k::2]:
            x = np.zeros(1 << BITS, np.float32)
            x[ids] = values
            scores.append(other.decide(x)[1])
    low, middle = np.quantile(scores, 0.01), np.median(scores)
    none = model.decide(np.zeros(1 << BITS, np.float32))[1]
    return float(max(0.0, min(2 * low - middle, max(LEAST_SCORE, none + (low - none) / 4))))


def sample_profiles(docs: DataFrame, per_language: int = 300, max_languages: int = 200) -> DataFrame:
    """(lang, ids, values): sparse profiles of a bounded sample of the rows to learn from.

    Of each of the `max_languages` most frequent languages, about `per_language`
    rows: those whose hash of doc_id lies under that language's threshold."""
    rows = docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    out = "lang string, ids array<int>, vals array<float>"
    if not counts:
        return docs.sparkSession.createDataFrame([], out)
    limits = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(spot < limits[F.col("lang")]).select("lang", "text").limit(4 * per_language * len(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, ids, values = [], [], []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = profile(t)
                if x is not None:
                    on = np.nonzero(x)[0]
                    langs.append(lang)
                    ids.append(on.astype(np.int32))
                    values.append(x[on])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(values, pa.list_(pa.float32()))], ["lang", "ids", "vals"])

    return chosen.mapInArrow(run, out)


def train(docs: DataFrame, per_language: int = 300, max_languages: int = 200, rejecting: bool = False) -> Model:
    """Models of the sample; with `rejecting`, their limit for rejection as well."""
    small_batches(docs.sparkSession)
    got = sample_profiles(docs, per_language, max_languages).toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), str(got["ids"][i])))
    langs = [got["lang"][i].as_py() for i in order]
    rows = [(got["ids"][i].values.to_numpy().astype(np.int64), got["vals"][i].values.to_numpy().astype(np.float64))
            for i in order]
    model = fit(langs, rows)
    if rejecting:
        model.limit = reject_limit(model, langs, rows)
    return model


def identify(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """`row` (a struct of the columns of `docs` but its text), `text` if wanted, lang_pred and score; from the
    text alone. A null text or one without a letter is `und` with score 0."""
    small_batches(docs.sparkSession)
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != "text"]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            out = {"row": b.column(0)} | ({"text": b.column(1)} if with_text else {})
            out["lang_pred"] = pa.array([p for p, _ in found], pa.string())
            out["score"] = pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = own.schema["row"].dataType.simpleString()
    return own.mapInArrow(run, f"row {kind}, " + "text string, " * with_text + "lang_pred string, score double")


def predictions(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs(doc_id, text, lang, ...)`.

    A null doc_id is neither held out nor learned from. Without any labelled row
    every prediction is `und`. Repeated rows stay repeated; an empty table gives none."""
    found = identify(docs.select("doc_id", "text"), train(docs, per_language), with_text=False)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
