import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.cases import CLASH, COLUMNS, EDGE, documents, sf_rows
from tests.llm.test_neardup import slow_classes, slow_fingerprint
from tests.llm.test_pii import slow_spans
from touchline.llm import bpe, pii, wand

ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))


def brute_force(rows, items):
    """doc_id -> text after the filters and before redaction, over rows with ids and texts."""
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    fps = {d: slow_fingerprint(t) for d, t in rows}
    root = slow_classes(list(fps.values()))
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    rows = [(d, t) for d, t in rows if least[root[fps[d]]] == d]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    bench = [grams(wand.words(t)) for _, t in items]
    return {d: t for d, t in rows if not any(
        len(g & own) >= 0.6 * len(g) for own in [grams(wand.words(t))] for g in bench)}


def test_run_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = sf_rows(sf, "documents", "doc_id, text")
    want = brute_force(docs, sf_rows(sf, "benchmark", "item_id, text"))
    assert got.keys() == want.keys()
    for d, t in want.items():
        r = got[d]
        base = slow_spans(t)
        plain = pii.redact(t, base)
        if r["text"] != plain:  # the field may have added spans
            kept = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r["text"])
            assert all(k in t for k in kept) and len(kept) > len(base)
        ids = ENCODING.encode_ordinary(r["text"])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["n_chars"] == len(r["text"])


def test_stages_keep_the_columns_of_documents(spark):
    df = documents(spark, EDGE)
    sf = "/root/testdata/sf0.001"
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, df, sf)
        empty = step(spark, spark.createDataFrame([], COLUMNS), sf)
        assert empty.count() == 0 and empty.columns == out.columns, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
            assert all(r["row"] == CLASH[0] and r["fp"] == CLASH[1] and r["own_id"] == CLASH[8]
                       for r in out.collect()), name
        df = out
    got = df.collect()
    # of the equal texts 1, 1, 2 the first stays; texts without a letter go
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["1", "None", "6", "7", "9", "-11"])
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_neardup", "decontamination", "pii_redaction", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and np.array(corpus_pipeline.STAGES, dtype=object).shape == (5, 2)


def test_language_verdict_decides(spark):
    """Wrong and missing languages are set right, texts in no learned language go, clean ones all stay."""
    rng = np.random.default_rng(3)
    words = {"en": "the and that with from where there have been", "de": "der und nicht ist eine wird auch durch",
             "fr": "les une dans pour avec plus cette sont"}
    kinds = list(words)
    rows, right = [], {}
    for i in range(300):
        right[i] = kinds[i % 3]
        given = right[i] if i % 20 else None if i % 40 else kinds[(i + 1) % 3]
        rows.append((i, " ".join(rng.choice(words[right[i]].split(), 30)), given, "s"))
    strange = ["日本語 の 文章 です", "Все люди рождаются свободными и равными"]
    rows += [(1000 + i, t, None, "s") for i, t in enumerate(strange)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, documents(spark, rows), "").collect()}
    assert got == right


def test_rejection_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    strange = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
               "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
               "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
               "Все люди рождаются свободными и равными в своем достоинстве и правах.",
               "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
               "Minden emberi lény szabadon születik és egyenlő méltósága és joga van."]
    more = spark.createDataFrame([(-1 - k, t, None, "s") for k, t in enumerate(strange)],
                                 "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(more), "")
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
