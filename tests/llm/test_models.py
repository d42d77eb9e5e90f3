import zlib

import numpy as np

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import langid, linear, quality
from touchline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def is_held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1.0, -1.0)
    w, b = linear.fit_hinge([(np.arange(5), r) for r in x], y, 5, c=10.0, epochs=300)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97
    # optimality: the duality gap of the bias-augmented problem is small
    primal = 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    assert primal < 0.5 * (w @ w + b * b) * 40 + 50


def test_sigmoid_orders_and_calibrates():
    m = np.linspace(-2, 2, 400)
    good = np.random.default_rng(1).random(400) < 1 / (1 + np.exp(-(3 * m + 1)))
    a, b = linear.fit_sigmoid(m, good)
    assert 1.5 < a < 5 and 0 < b < 2.2


def test_language_query_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).collect()
    lang = dict(sf_rows(SF, "documents", "doc_id, lang"))
    assert len(got) == len(lang)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.98


def test_language_families_and_votes():
    words = {"en": "the and that with from", "de": "der und nicht ist eine", "nl": "het een niet van wordt",
             "fr": "les une dans pour avec", "es": "los una para como pero", "xx": "qqq zzz kkk www vvv"}
    rng = np.random.default_rng(2)
    langs, rows = [], []
    for lang, w in words.items():
        for _ in range(40):
            x = langid.profile(" ".join(rng.choice(w.split(), 8)))
            langs.append(lang)
            rows.append((np.nonzero(x)[0], x[np.nonzero(x)[0]].astype(float)))
    model = langid.fit(langs, rows)
    assert [f for f, _ in model.families] == ["germanic", "other", "romance"]
    assert len(model.pairs["germanic"]) == 3
    for lang, w in words.items():
        assert model.predict(w.upper() + " 123 ###")[0] == lang
    assert model.predict(None) == model.predict("12 !? ½") == ("und", 0.0)


def test_language_edges(spark):
    got = {}
    for r in langid.predictions(documents(spark, EDGE)).collect():
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert sum(map(len, got.values())) == len(EDGE)
    assert got[3] == got[4] == got[5] == got[8] == got[10] == ["und"]
    assert all(r["lang_pred"] in ("en", "de", "fr", "es", "und")
               for r in langid.predictions(documents(spark, EDGE)).collect())
    assert langid.predictions(documents(spark, [])).count() == 0
    one = [(i, "some words here", None, "s") for i in range(3)]
    assert {r["lang_pred"] for r in langid.predictions(documents(spark, one)).collect()} == {"und"}


def test_language_ignores_lang_of_held_out(spark):
    rows = [(i, "the and that with from" if i % 2 else "der und nicht ist eine", "en" if i % 2 else "de", "s")
            for i in range(200)]
    wrong = [(d, t, "zz" if is_held_out(d) else g, s) for d, t, g, s in rows]
    got = langid.predictions(documents(spark, wrong)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {d: g for d, _, g, _ in rows}


def test_quality_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    labels = dict(sf_rows(sf, "labels", "doc_id, quality"))
    assert len(got) == 10_000
    assert all(r["held_out"] == is_held_out(d) and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    out = [(got[d]["score"], q) for d, q in labels.items() if is_held_out(d)]
    good, bad = ([s for s, q in out if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.99 and np.mean([s >= 0.3 for s in good]) > 0.99


def test_quality_edges(spark):
    docs = documents(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, 0), (2, 1, 0), (None, 1, 0), (9, None, 0), (5, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[3] == by[4] and all(len(v) == 1 for d, v in by.items() if d is not None)
    assert quality.scores(documents(spark, []), labels).count() == 0
