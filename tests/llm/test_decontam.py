import random

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import decontam, wand
from touchline.llm.queries import QUERIES


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def exhaustive(index, terms, threshold):
    scores = {}
    for t in terms:
        for d, v in index.postings[t]:
            scores[d] = scores.get(d, 0.0) + v
    return {d: s for d, s in scores.items() if s >= threshold - 1e-9}


def test_wand_finds_all_above_threshold():
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab[: rng.randint(8, 60)], k=rng.randint(5, 40)))) for i in range(150)]
    for block in (1, 4, 16):
        index = wand.Index(items, block=block)
        for _ in range(60):
            terms = sorted({index.vocab[w.encode()] for w in rng.choices(vocab, k=25) if w.encode() in index.vocab})
            for threshold in (0.2, 0.5, 0.8):
                want = exhaustive(index, terms, threshold)
                got = dict(index.search(terms, threshold))
                assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_bounds_hide_no_passage():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=30))) for i in range(40)]
    index = wand.Index(items)
    for _ in range(40):
        w = [f"w{k}".encode() for k in rng.choices(range(400), k=200)]
        w[50:80] = wand.words(rng.choice(items)[1])
        ids = index.term_ids(w)
        windows = index.passages(len(w))
        hopeful = dict(index.hopeful(ids, windows, 0.5))
        for k, (a, z) in enumerate(windows):
            terms = sorted({int(t) for t in ids[a:z] if t >= 0})
            want = exhaustive(index, terms, 0.5)
            # the lists give exactly the items that reach the threshold, and the search between them all scores
            assert sorted(want) == hopeful.get(k, [])
            got = dict(index.search(terms, 0.5, hopeful.get(k, [])))
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_scored_items_follow_hits_not_index_size():
    """The same passages against 50 and 800 items: only the item that is there is left to the search."""
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(20_000)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(800)]
    w = [x.encode() for _ in range(20) for x in (*rng.choices(vocab, k=300), *items[7][1].split())]
    for n in (50, 800):
        index = wand.Index(items[:n])
        ids, windows = index.term_ids(w), index.passages(len(w))
        found = index.hopeful(ids, windows, 0.6)
        assert {index.items[d][0] for _, held in found for d in held} == {7}


def test_query_matches_containment(spark):
    """Against all items and whole texts by brute force: share of the item's word 5-grams in the document."""
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    items = [(i, grams(wand.words(t))) for i, t in sf_rows(sf, "benchmark", "item_id, text")]
    want = set()
    for d, t in sf_rows(sf, "documents", "doc_id, text"):
        own = grams(wand.words(t))
        want |= {(d, i) for i, g in items if len(g & own) / len(g) >= 0.6}
    assert got == want and want


QUESTION = "Which river runs through the old town of Bremen and into the northern sea? The river Weser it is."


def test_both_parts_are_verified(spark):
    items = items_of(spark, [(1, QUESTION), (2, None), (3, "too short"), (None, QUESTION), (4, "")])
    q, a = QUESTION.split("? ")
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, f"{filler} {QUESTION.upper()} {filler}", "en", "s"), (2, f"{filler} {q}? {filler}", "en", "s"),
            (3, f"{a} {filler}", "en", "s"), (4, QUESTION, "en", "s"), (4, QUESTION, "en", "s"),
            (None, QUESTION, "en", "s"), (5, filler, "en", "s")]
    got = decontam.leaks(documents(spark, rows), items).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "4", "None"] and {r["item_id"] for r in got} == {1}
    kept = decontam.without_leaks(documents(spark, rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


def test_edges(spark):
    df = documents(spark, EDGE)
    items = items_of(spark, [(1, QUESTION), (2, EDGE[0][1])])
    assert sorted(r["doc_id"] for r in decontam.leaks(df, items).collect()) == [1, 1, 2]
    kept = decontam.without_leaks(df, items)
    assert kept.columns == df.columns and kept.count() == len(EDGE) - 3
    empty = items_of(spark, [])
    assert decontam.leaks(df, empty).count() == 0 and decontam.without_leaks(df, empty).count() == len(EDGE)
    assert decontam.leaks(documents(spark, []), items).count() == 0


def test_passes_and_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(25))) for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(500)}" for _ in range(100)]) + " " + items[i][1], "en", "s")
            for i in range(20)]
    want = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(documents(spark, rows), items_of(spark, items)).collect()}
    monkeypatch.setattr(decontam, "PASS_BYTES", 3000)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 1000)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(documents(spark, rows), items_of(spark, items)).collect()}
    assert got == want and {(i, i) for i in range(20)} <= got


def test_scripts_without_spaces_typography_and_short_items(spark):
    items = [(1, "长江流经哪座古老的城市并最终注入东海？答案是上海这座城市。"),
             (2, "日本で一番高い山はどこにありますか。それは富士山で静岡県と山梨県にあります。"),
             (3, "แม่น้ำสายใดไหลผ่านกรุงเทพมหานครก่อนลงสู่อ่าวไทย คือแม่น้ำเจ้าพระยา"),
             (4, "Who said \"don't look back\" - the singer or the well-known writer? It's the singer's own line."),
             (5, "Zwölf Boxkämpfer jagen Viktor"), (6, "")]
    typed = "Who said “don’t look back” — the singer or the well‐known writer？ It’s the singer’s own line…"
    filler = " ".join(f"f{i}" for i in range(100))
    rows = [(1, f"今天的新闻报道说{items[0][1]}然后我们继续讨论别的话题", "zh", "s"),
            (2, f"昨日の話では{items[1][1]}と書いてあった", "ja", "s"),
            (3, f"เมื่อวานนี้เขาถามว่า{items[2][1]}และทุกคนตอบได้", "th", "s"),
            (4, f"{filler} {typed} {filler}", "en", "s"),
            (5, f"{filler} zwölf Boxkämpfer, jagen VIKTOR {filler}", "de", "s"),
            (6, f"{filler} Zwölf jagen Boxkämpfer Viktor {filler}", "de", "s"),
            (7, "今天的新闻报道说我们继续讨论别的话题，城市里的天气很好。", "zh", "s")]
    got = decontam.leaks(documents(spark, rows), items_of(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(1, 6)]


def test_words():
    assert wand.words("Ｆｕｌｌ－ｗｉｄｔｈ“x”") == [b"full", b"width", b"x"]
    assert [w.decode() for w in wand.words("ab中文cd น้ำ हिन्दी co­op")] == \
        ["ab", "中", "文", "cd", *[w.decode() for w in wand.words("น้ำ")], "हिन्दी", "coop"]
    assert wand.words("été") == wand.words("été") and wand.words(None) == wand.words(" —…") == []


def test_long_items_do_not_widen_the_span_of_short_ones(spark):
    rng = random.Random(6)
    short = "how is the word of a day in the year when they go to it"
    items = [(1, short), (2, " ".join(f"v{rng.randrange(9000)}" for _ in range(3000)))]
    w = short.split()
    scattered = []  # all of its trigrams, each far from the next
    for k in range(len(w) - 2):
        scattered += [*w[k:k + 3], *(f"f{rng.randrange(500)}" for _ in range(60))]
    filler = " ".join(f"f{i}" for i in range(200))
    edited = " ".join(w[:6] + ["extra", "words"] + w[6:])
    rows = [(1, " ".join(scattered), "en", "s"), (2, f"{filler} {short} {filler}", "en", "s"),
            (3, f"{filler} {edited} {filler}", "en", "s"), (4, f"{filler} {items[1][1]} {filler}", "en", "s")]
    got = decontam.leaks(documents(spark, rows), items_of(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(2, 1), (3, 1), (4, 2)]


def test_scores_do_not_depend_on_the_slices(spark, monkeypatch):
    """Edited copies around the threshold: the same are found, with the same scores, in one index and in many."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    items = [(i, " ".join(rng.choices(vocab, weights, k=30))) for i in range(80)]
    rows = []
    for i in range(60):
        w = items[i][1].split()
        for k in rng.sample(range(30), rng.randint(3, 14)):
            w[k] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(w + [f"f{rng.randrange(500)}" for _ in range(80)]), "en", "s"))

    def found():
        got = decontam.leaks(documents(spark, rows), items_of(spark, items), question=0.1, answer=0.1).collect()
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got)

    want = found()
    assert 10 < len(want) and any(s < 0.7 for *_, s in want)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 400)
    assert found() == want
    monkeypatch.setattr(decontam, "PASS_BYTES", 1)
    assert found() == want


def test_indexes_are_built_in_tasks_and_bounded(spark, monkeypatch):
    """No item reaches the driver, and no index holds more than its bounds."""
    import pickle

    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(20))) for i in range(400)]
    monkeypatch.setattr(decontam, "SHARD_BYTES", 5000)
    frame, brought = items_of(spark, items), []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: brought.extend(rows := collect(self)) or rows)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: 1 / 0)
    files = decontam._write_indexes(frame)
    assert len(brought) < 10 and not any("text" in r.asDict() for r in brought)
    indexes = [pickle.loads(d) for f in files for d in decontam._read(f)]
    assert len(indexes) > 5 and sorted(i for ix in indexes for i, *_ in ix.items) == list(range(400))
    texts = dict(items)
    assert all(sum(len(texts[i]) for i, *_ in ix.items) <= 5000 for ix in indexes)
    big = wand.Index([(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(10))) for i in range(2500)])
    assert big.block_most.size <= wand.CELLS + len(big.vocab) and not hasattr(big, "_bounds")
