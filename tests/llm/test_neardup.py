import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import neardup, simhash
from touchline.llm.common import BATCH_ROWS


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, max_bits=4):
    u = np.unique(np.array(fps, np.uint64))
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.nonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= max_bits)[0] + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(x): int(u[find(i)]) for i, x in enumerate(u)}


def test_fingerprint_matches_definition():
    for _, text, *_ in EDGE:
        if text is None or len(text) < 100_000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("a B\x0bc") == slow_fingerprint("A b\x0cC".replace("\x0c", "\x0b"))


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(-2 ** 63, 2 ** 63 - 1, size=2000, dtype=np.int64)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for k in rng.choice(64, size=rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    sets = []
    for v in (a, b.view(np.int64)):
        rows, keys = simhash.keys(v)
        found = [set() for _ in v]
        for r, k in zip(rows, keys):
            found[r].add(int(k))
        sets.append(found)
    assert all(x & y for x, y in zip(*sets))


def cluster_rows():
    """Random words, copies, near copies, and a crowd of fingerprints around one."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=60)), "en", "s")
            for i in range(60)]
    base = rng.choices("one two three four five six seven eight nine ten".split(), k=400)
    for i in range(60, 160):
        words = list(base)
        words[rng.randrange(400)] = f"w{rng.randrange(9)}"
        rows.append((i, " ".join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("cap", [128, 2])
def test_classes_match_brute_force(spark, cap):
    rows = [(d + 1000, *r) for d, *r in cluster_rows()] + [r for r in EDGE if r[0] is not None]
    got = neardup.near_duplicates(documents(spark, rows), bucket_cap=cap).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) if t is None or len(t) < 100_000 else simhash.fingerprint(t) for _, t, *_ in rows]
    root = slow_classes(fps)
    least = {}
    for (d, *_), f in zip(rows, fps):
        least[root[f]] = min(least.get(root[f], d), d)
    want = {d: least[root[f]] for (d, *_), f in zip(rows, fps)}
    assert all(want[r["doc_id"]] == r["component_id"] for r in got)


def test_query_matches_brute_force(spark, sf):
    from touchline.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op1_simhash_neardup"](spark, sf).collect()}
    rows = sf_rows(sf, "documents", "doc_id, text")
    fps = {d: slow_fingerprint(t) for d, t in rows}
    root = slow_classes(list(fps.values()))
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    assert len(got) == len(rows)
    for d, f in fps.items():
        assert got[d]["fingerprint"] == f"{f:016x}" and got[d]["component_id"] == least[root[f]]


def test_keep_one_of_each_class(spark):
    df = documents(spark, EDGE)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1, 1 and 2 are one class; 3, 4, 5 and the row without id or text are another
    assert got == sorted([(False, 1), (False, 3), (True, 0), (False, 6), (False, 7), (False, 8), (False, 9),
                          (False, 10), (False, -11)])
    assert all(r["row"] == "r" and r["fp"] == 1 for r in kept.collect())


def test_empty_table(spark):
    df = documents(spark, [])
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.keep_one(df).count() == 0


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_batches_stay_small_and_whole():
    """What the JVM reads at once is bounded, whatever a group of words spreads to."""
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(-2**63, 2**63 - 1, 300))
    masks = neardup._ball_masks(4)
    given = pa.RecordBatch.from_arrays([pa.array(words)], ["fp"])
    got = list(neardup._ball_rows([given], masks, 128))
    assert max(b.num_rows for b in got) <= BATCH_ROWS < 128 * len(masks)
    seen = [(c, f) for b in got for c, f, link in zip(*(x.to_pylist() for x in b.columns)) if not link]
    assert len(seen) == len(set(seen)) and {c for c, _ in seen} == {int(w ^ m) for w in words for m in masks}
    many = pa.RecordBatch.from_arrays([pa.array(rng.integers(-2**63, 2**63 - 1, 5000))], ["fp"])
    keyed = list(neardup._key_rows([many]))
    assert max(b.num_rows for b in keyed) <= BATCH_ROWS < sum(b.num_rows for b in keyed)
    rows, keys = simhash.keys(many.column(0).to_numpy())
    assert [k for b in keyed for k in b.column(0).to_pylist()] == keys.tolist()
