import hashlib
import itertools
import random
import re

import numpy as np

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import crf, pii
from touchline.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(
                    sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_match_plain_regexes():
    rng = random.Random(0)
    parts = ["a", "b@", "@", "x.y", ".", "1", "22", "255", "256", " ", "-", "(", ")", "+", "4111111111111111", "%", "é",
             "@c.d", "+1 (", "0", "000255", "+4 999-999-9999"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert crf.base_spans(text) == slow_spans(text), text


def test_patterns_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "1." * 100_000, "+1" * 100_000, "a@b." * 50_000):
        crf.base_spans(text)
        crf.graph(text)


def test_messages_are_exact_on_a_chain():
    """Against all labelings of a small chain without loops."""
    rng = np.random.default_rng(0)
    model = crf.Model(rng.normal(size=(crf.DIMS, crf.LABELS)), rng.normal(size=(2, crf.LABELS, crf.LABELS)))
    g = crf.Graph(feats=[[1], [2, 3], [4], [5]], edges=[(0, 1, crf.CHAIN), (1, 2, crf.CHAIN), (1, 3, crf.SKIP)])
    got = model.settled(model.scores(*crf.join([g])[:2], 4), crf.join([g])[2], np.zeros(4, int))
    want = np.zeros((4, crf.LABELS))
    for y in itertools.product(range(crf.LABELS), repeat=4):
        s = sum(model.unary[f, y[k]] for k, fs in enumerate(g.feats) for f in fs)
        s += sum(model.pair[t, y[a], y[b]] for a, b, t in g.edges)
        for k in range(4):
            want[k, y[k]] += np.exp(s)
    assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_skip_edges_join_repeats():
    g = crf.graph("call +1 (523) 555-1055 or 555-1055, then 555-1055. a@b.cd and A@B.cd")
    skips = {(g.core[a], g.core[b]) for a, b, t in g.edges if t == crf.SKIP}
    assert ("555-1055", "555-1055") in skips and ("a@b.cd", "A@B.cd") in skips


def trained():
    rng = random.Random(4)
    graphs, labels, hidden = [], [], []
    for _ in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        text = rng.choice([f"the {phone} word", f"word {ip} the", f"x.{rng.randint(10, 99)}@mail.example.com then",
                           f"case {rng.randint(100, 999)}-{rng.randint(1000, 9999)} word", f"or {rng.randint(10**6, 10**7)} then",
                           "version 2.0. the", f"id {rng.randint(10**15, 10**16 - 1)} word"])
        g = crf.graph(text)
        graphs.append(g)
        labels.append(crf.known_labels(g, crf.base_spans(text)))
        hidden += crf.masked(text, crf.base_spans(text))
    return crf.fit(graphs, labels, hidden)


def test_field_adds_what_patterns_lose():
    model = trained()
    text = "the +1 (310) 555-4510 152.143.123.131 word. Then (310) 555-4510 word 12 and version 2.0."
    (base, more), = pii.spans_of([text], model)
    assert [text[a:z] for a, _, z in base] == ["152.143.123.131"]
    assert "+1 (310) 555-4510" in [text[a:z] for a, _, z in more]
    assert all(text[a:z] not in ("12", "2.0.", "2.0") for a, _, z in more)
    assert pii.redact(text, base + more).startswith("the [PHONE] [IP] word.")


FORMS = ("555-1055", "523-555-1055", "5551055", "5235551055")


def added(text, model):
    (base, more), = pii.spans_of([text], model)
    return [text[a:z] for a, _, z in more]


def test_repeats_in_other_forms_follow_the_full_number():
    model = trained()
    for form in FORMS:
        for n in (1, 5, 31, 200):
            after = "call +1 (523) 555-1055 now" + f" or {form} then" * n
            before = f"so {form} or" * n + " call +1 (523) 555-1055 now"
            assert added(after, model) == [form] * n and added(before, model) == [form] * n, (form, n)
        # nobody's number stays outside, however often it stands there
        assert added(f"or {form} then " * 40, model) == []
    # also where the full number is one that the patterns lost
    text = "the +1 (310) 555-4510 152.143.123.131 word" + " and 555-4510 then" * 20
    assert added(text, model).count("555-4510") == 20


def test_without_skip_edges_repeats_are_lost():
    model = trained()
    model.pair[crf.SKIP] = 0.0
    assert all(added(f"call +1 (523) 555-1055 or {form} then", model) == [] for form in FORMS)


def test_a_document_is_alone_in_its_batch():
    model = trained()
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["call", "+1 (523) 555-1055", "555-1055", "4.5.6.7", "12", "a@b.cd", "x", "99-99", "5235551055"])
                      for _ in range(rng.randint(1, 80))) for _ in range(60)]
    assert pii.spans_of(texts, model) == [pii.spans_of([t], model)[0] for t in texts]
    graphs = [crf.graph(t) for t in texts if crf.graph(t).core]
    given = [crf.labels(g, []) for g in graphs]
    together = model.marginals(graphs, given)
    assert np.array_equal(together, np.concatenate([model.marginals([g], [y]) for g, y in zip(graphs, given)]))


def test_long_tokens_keep_their_digits():
    g = crf.graph("x" * 100 + "1 " + "0" * 70)
    h = crf.graph("x" * 100 + "1 " + "0" * 71)
    assert g.feats[1] != h.feats[1]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op10_pii_skip_chain"](spark, sf).collect()}
    rows = sf_rows(sf, "documents", "doc_id, coalesce(text, '')")
    assert len(got) == len(rows)
    extra = 0
    for d, t in rows:
        base, r = slow_spans(t), got[d]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.listing(base).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(pii.listing(base).split(",")) - {""} <= set(every)
        extra += len(every) - len(base)
    assert extra <= 0.05 * sum(len(slow_spans(t)) for _, t in rows)


def test_edges(spark):
    got = pii.find(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[6]["n_email"] == by[6]["n_phone"] == 1 and by[3]["spans"] == by[4]["spans"] == by[10]["spans"] == ""
    out = pii.redacted(documents(spark, EDGE))
    assert out.columns == documents(spark, EDGE).columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[3]["text"] is None and texts[6]["text"].endswith("mail [EMAIL] and [PHONE]")
    assert texts[6]["n_chars"] == len(texts[6]["text"]) and texts[7]["text"] == "x" * 300_000
    assert pii.find(documents(spark, [])).count() == 0 and pii.redacted(documents(spark, [])).count() == 0


def test_redaction_joins_overlaps():
    assert pii.redact("ab 12345 c", [(3, 2, 6), (5, 3, 8)]) == "ab [CARD] c"
    assert pii.redact("abc", []) == "abc"
