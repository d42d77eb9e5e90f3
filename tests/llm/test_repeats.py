"""Operators 11 to 13 against brute force: periodic runs, the prefix trie, substring dedup."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import periodic, queries, substring, trie


def slow_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            a = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k > a and k + q - a >= max(least, 2 * q):
                found.setdefault((a, k + q), q)
            k += 1
    return sorted(((a, z - a, q) for (a, z), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least", [1, 4, 12])
def test_runs_of_random_sequences(least):
    rng = random.Random(least)
    for _ in range(150):
        seqs = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(60))] for _ in range(3)]
        assert periodic.find(seqs, least) == [slow_runs(s, least) for s in seqs]


def test_runs_of_known_words():
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 90:
        fib = fib[1], fib[1] + fib[0]
    assert periodic.find([fib[1], [], ["a"] * 40], 1) == [slow_runs(fib[1], 1), [], [(0, 40, 1)]]


def looped_words(doc_id, text):
    words = (text or "").split() if (text or "").isascii() else (text or "").encode().split()
    words = [w if isinstance(w, str) else w.decode() for w in words]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_periodic_runs_edge_rows(spark):
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
            for r in periodic.periodic_runs(documents(spark, EDGE), 12).collect()]
    assert len(rows) == len(EDGE)
    for doc_id, text, *_ in EDGE:
        if text is None or len(text) < 100_000:
            words = [w.decode() for w in (text or "").encode().split()]
            runs = slow_runs(words)
            assert (doc_id, len(words), runs, slow_collapse(words, runs)) in rows
    assert periodic.periodic_runs(documents(spark, []), 12).count() == 0


def test_op11_query(spark, sf):
    docs = sf_rows(sf, "documents", "doc_id, text")
    want = []
    for doc_id, text in docs:
        words = looped_words(doc_id, text)
        runs = slow_runs(words)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        want.append((doc_id, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else [None] * 4),
                     hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(slow_collapse(words, runs).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in got) > 10


def slow_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(own)] for c, own in convs.items()}
    nodes, paths = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = convs.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    children = {k: [] for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items())


def test_trie_against_brute_force(spark, monkeypatch):
    # short stretches, few buckets and a small base, so that every split is crossed
    for name, value in (("STRETCH", 3), ("BUCKETS", 4), ("ENDS", 4)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(5)
    rows = [(None, 1, "a", "b")]
    for c in rng.sample(range(60), 40):
        rows += [(c, rng.choice([t, t, t, None]), rng.choice(["u", None]), rng.choice(["x", "y", "é", None]) if t > 1 else "z")
                 for t in range(rng.randrange(1, 14))]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                  "conv_id long, turn int, role string, text string, part string, depth int").repartition(5)
    got = sorted(tuple(r) for r in trie.prefix_trie(*queries.rebuilt(turns), base=60).collect())
    assert got == slow_trie(rows)


def test_trie_of_nothing_and_of_silence(spark):
    turns = "conv_id long, turn int, role string, text string"
    assert trie.prefix_trie(*queries.rebuilt(spark.createDataFrame([], turns))).count() == 0
    silent = trie.prefix_trie(trie.ordered(spark.createDataFrame([], turns)), spark.createDataFrame([(7,), (4,)], "conv_id long"))
    (row,) = silent.collect()
    assert tuple(row) == (4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,7").hexdigest())


def test_hot_conversation_is_cut(spark):
    """No window over turns is partitioned by the conversation alone."""
    turns = spark.createDataFrame([(1, i, "u", f"t{i}") for i in range(5000)], "conv_id long, turn int, role string, text string")
    found = trie.prefixes(trie.ordered(turns).where("place > 0"))
    assert found.select("k1", "k2").distinct().count() == 5000
    plan = trie.ordered(turns)._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(conv_id" in plan and ", part#" in plan


def slow_repeats(rows, length):
    first = {}
    texts = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1 if d is not None else 0):
            k = tuple(w[i:i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i:i + length])] < d:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def removed(found):
    return sorted((tuple(r) for r in found.select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)"), "kept").collect()), key=str)


@pytest.mark.parametrize("length,split", [(13, 7), (6, 3), (4, 1)])
def test_substring_dedup_against_brute_force(spark, length, split):
    rng = random.Random(length)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    # one passage in a third of all documents, a null id, a repeated row, two texts under one id
    rows = [(None, passages[0]), (3, None), (4, ""), (5, passages[0]), (5, passages[1]), (5, passages[0])]
    for d in range(10, 160):
        parts = [rng.choice(passages) if rng.random() < .4 else " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))
                 for _ in range(rng.randrange(8))]
        rows.append((d, " ".join(parts + [passages[2]] * (d % 3 == 0))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(split)
    assert removed(substring.repeats(docs, length)) == slow_repeats(rows, length)


def test_substring_dedup_spans_are_maximal(spark):
    a = [f"a{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(["x", *a[5:30], "y", *a[:13], "z", *a[20:32]]))],
                                 "doc_id long, text string")
    (row,) = substring.repeats(docs, 13).where("doc_id = 2").collect()
    assert [tuple(s) for s in row.spans] == [(1, 25), (27, 13)]
    assert row.kept.split() == ["x", "y", "z", *a[20:32]]


def test_substring_dedup_edge_rows(spark):
    rows = [(d, t) for d, t, *_ in EDGE] + [(20, EDGE[8][1]), (21, "new " + EDGE[8][1])]
    got = removed(substring.repeats(documents(spark, [(d, t, None, None) for d, t in rows])))
    assert got == slow_repeats(rows, 13)
    assert substring.repeats(documents(spark, [])).count() == 0
