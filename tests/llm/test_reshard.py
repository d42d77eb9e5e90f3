import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import reshard
from touchline.llm.queries import QUERIES


def test_flow_is_least():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        supply = rng.integers(0, 3, n).tolist()
        capacity = rng.integers(0, 3, m).tolist()
        while sum(capacity) < sum(supply):
            capacity[rng.integers(m)] += 1
        cost = rng.integers(0, 5, (n, m)).tolist()
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units))
                    if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == best


def test_plan_moves_the_surplus_only():
    blocks = {0: 500, 1: 300, 2: 200, 4: 100, 5: 100, 8: 0}
    plan = reshard.plan_transfers(blocks, 4, 3, 3)
    assert sum(plan.flow[i][j] for i in range(3) for j in range(3) if i != j) == 1000 - 400
    assert set(plan.whole) | set(plan.split) | {8} >= set(blocks)
    for b, parts in plan.split.items():
        assert sum(p for p, _ in parts) == blocks[b]


def check_law(rows, got, slack):
    """rows: (doc_id, text)."""
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = [0] * 8
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r["size"] for r in mine)
    assert all(0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert max(sizes) - min(sizes) <= slack


def test_query_holds_its_law(spark):
    sf = "/root/testdata/sf0.01"
    rows = sf_rows(sf, "documents", "doc_id, text")
    check_law(rows, QUERIES["op2_resharding"](spark, sf).collect(), 2 * max(len(t.encode()) for _, t in rows))


def test_edges(spark):
    check_law([r[:2] for r in EDGE], reshard.by_bytes(documents(spark, EDGE)).collect(), 1 << 20)
    assert reshard.by_bytes(documents(spark, [])).count() == 0


def test_only_affected_files_are_rewritten(spark, tmp_path):
    rows = [(i, f"text {i} " + "x" * (i % 90), "en", "big" if i % 3 else f"s{i % 5}") for i in range(2000)]
    df = documents(spark, rows).select("doc_id", "text", "source")
    path = f"file://{tmp_path}/layout"
    reshard.write_layout(df, F.when(F.col("source") == "big", 0).otherwise(1), 16, path)
    out, plan = reshard.reshard(spark, path, 16, 2, 4)
    total = df.agg(F.sum(reshard.size_of(F.col("text")))).first()[0]
    assert sum(plan.flow[i][j] for i in range(2) for j in range(4) if i == j) == sum(
        min(total // 4 + (i < total % 4), sum(plan.flow[i])) for i in range(2))
    stays = [b for b, j in plan.whole.items() if j == b // 16]
    files = {f.split("block=")[1].split("/")[0] for f in out.inputFiles() if "-moved" not in f}
    assert stays and {int(b) for b in files} <= set(plan.whole) | set(plan.split)
    assert out.count() == 2000 and out.select("doc_id").distinct().count() == 2000
    per = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum(reshard.size_of(F.col("text"))).alias("b")).collect()}
    assert max(per.values()) - min(per.values()) < 400
