"""Resharding by minimum-cost flow.

Documents lie in old shards, each cut into blocks (one file each). New capacities are
equal bytes. A minimum-cost flow from old to new shards says how many bytes go
from each to each (staying costs nothing), so that the fewest bytes move. The
flow is carried out in whole blocks; a block in which a flow ends is split by
documents. Only files of moved or split blocks are read and written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import scratch

FINE = 4096  # parts in which a block is split


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that moves every supply within the capacities.

    Successive shortest paths (Bellman-Ford) from a source over old shards and new shards to a sink.
    Costs are not negative. The capacities must hold the supplies."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supplies")
    n, m = len(supply), len(capacity)
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    to, room, price, out = [], [], [], [[] for _ in range(nodes)]

    def arc(a: int, b: int, c: int, p: int) -> None:
        for x, y, r, q in ((a, b, c, p), (b, a, 0, -p)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(q)

    for i in range(n):
        arc(source, i, supply[i], 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost[i][j])
    for j in range(m):
        arc(n + j, sink, capacity[j], 0)
    left = sum(supply)
    while left:
        dist: list[float] = [float("inf")] * nodes
        via = [-1] * nodes
        dist[source], queue = 0, [source]
        while queue:
            nxt = []
            for x in queue:
                for e in out[x]:
                    if room[e] and dist[x] + price[e] < dist[to[e]]:
                        dist[to[e]], via[to[e]] = dist[x] + price[e], e
                        nxt.append(to[e])
            queue = list(dict.fromkeys(nxt))
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
        left -= amount
    return [[room[(first + 2 * (i * m + j)) ^ 1] for j in range(m)] for i in range(n)]


@dataclass
class Plan:
    flow: list[list[int]]
    whole: dict[int, int]                       # block id -> new shard
    split: dict[int, list[tuple[int, int]]]     # block id -> (bytes, new shard) in order


def plan_transfers(blocks: dict[int, int], per_shard: int, old: int, new: int) -> Plan:
    """Which blocks go where. blocks: id -> bytes; block id // per_shard is the old shard.

    An old shard's blocks lie on a line in the order of their ids; what stays
    takes the first bytes, then each destination its run."""
    supply = [0] * old
    for b, size in blocks.items():
        supply[b // per_shard] += size
    total = sum(supply)
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(new)] for i in range(old)])
    whole: dict[int, int] = {}
    split: dict[int, list[tuple[int, int]]] = {}
    for i in range(old):
        order = [j for j in [i] + [j for j in range(new) if j != i] if j < new and flow[i][j]]
        runs = [[flow[i][j], j] for j in order]
        for b in sorted(b for b in blocks if b // per_shard == i):
            left, parts = blocks[b], []
            while left and runs:
                take = min(left, runs[0][0])
                parts.append((take, runs[0][1]))
                left -= take
                runs[0][0] -= take
                if not runs[0][0]:
                    runs.pop(0)
            if len(parts) == 1:
                whole[b] = parts[0][1]
            else:
                split[b] = parts
    return Plan(flow, whole, split)


def _fine(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id, "text", F.lit("fine")), F.lit(FINE)).cast("int")


def write_layout(docs: DataFrame, old_shard: Column, per_shard: int, path: str) -> None:
    """Write `docs` as an old layout: a folder and file for each block of each shard."""
    block = (old_shard * per_shard + F.pmod(F.xxhash64("doc_id", "text"), F.lit(per_shard))).cast("int")
    docs.withColumn("block", block).repartition("block").write.option("compression", "zstd").partitionBy(
        "block").parquet(path)


def _among(ids: list[int]) -> Column:
    """Whether `block` is one of `ids`, as a few ranges: a plan keeps and moves blocks of a shard in runs, at most two more
    than it has flows, so the condition does not grow with the number of blocks."""
    out, ids = F.lit(False), sorted(ids)
    first = [k for k, b in enumerate(ids) if not k or ids[k - 1] != b - 1]
    for a, z in zip(first, [*first[1:], len(ids)]):
        out = out | F.col("block").between(ids[a], ids[z - 1])
    return out


def reshard(spark: SparkSession, path: str, per_shard: int, old: int, new: int) -> tuple[DataFrame, Plan]:
    """Reshard the layout at `path` to `new` shards of equal bytes.

    Returns the documents of the new layout with `shard` and `block`: files of blocks that stay
    are read where they are; moved and split blocks are read from new files below `path`'s sibling folder."""
    layout = spark.read.parquet(path)
    # at most old * per_shard rows, and FINE rows for each split block (fewer of these than old + new)
    blocks = {r["block"]: r["bytes"] for r in
              layout.groupBy("block").agg(F.sum(size_of(F.col("text"))).alias("bytes")).collect()}
    plan = plan_transfers(blocks, per_shard, old, new)
    stays = [b for b, j in plan.whole.items() if j == b // per_shard]
    target = [(b, -1, j) for b, j in plan.whole.items() if j != b // per_shard]
    if plan.split:
        parts = layout.where(_among(list(plan.split))).groupBy("block", _fine().alias("fine")).agg(
            F.sum(size_of(F.col("text"))).alias("bytes")).collect()
        by_block: dict[int, list[tuple[int, int]]] = {}
        for r in parts:
            by_block.setdefault(r["block"], []).append((r["fine"], r["bytes"]))
        for b, found in by_block.items():
            runs, at, k = plan.split[b], 0, 0
            edge = runs[0][0]
            for fine, size in sorted(found):
                while at + size / 2 > edge and k + 1 < len(runs):  # a part goes where its middle lies
                    k += 1
                    edge += runs[k][0]
                target.append((b, fine, runs[k][1]))
                at += size
    kept = layout.where(_among(stays)).withColumn(
        "shard", F.floor(F.col("block") / per_shard).cast("int"))
    if not target:
        return kept, plan
    moved_ids = sorted({b for b, _, _ in target})
    goes = spark.createDataFrame(target, "block int, _fine int, shard int")
    split_ids = sorted(plan.split)
    fine = F.when(_among(split_ids), _fine()).otherwise(F.lit(-1))
    moved = layout.where(_among(moved_ids)).withColumn("_fine", fine).join(
        F.broadcast(goes), ["block", "_fine"]).drop("_fine")  # bounded as above
    moved = moved.select(*[c for c in layout.columns if c != "block"], "shard", "block")
    folder = f"{path}-moved"
    moved.write.option("compression", "zstd").partitionBy("shard", "block").parquet(folder)
    again = spark.read.schema(moved.schema).parquet(folder)
    return kept.unionByName(again), plan


def slots(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """`rows(shard, doc_id, text_crc32, ...)` with `slot`: gapless from 0 in each shard.

    Rows are numbered within hash buckets of a shard; a small table of bucket counts gives the offsets, so no
    shard passes through one task. Repeated rows get slots of their own."""
    own = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = own.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    return own.withColumn("_k", F.row_number().over(within)).join(offsets, ["shard", "_bucket"]).withColumn(
        "slot", F.col("_first") + F.col("_k") - 1).drop("_bucket", "_k", "_first")


def by_bytes(docs: DataFrame, old: int = 8, new: int = 8, block_bytes: int = 64 << 20,
             least_blocks: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, block) per row of `docs(doc_id, text, source, ...)`.

    Old shards: by the hash of `source` (a null source is one of its own), each cut into as many
    blocks: at least `least_blocks`, and so many that the largest shard's are of about `block_bytes`. New shards: equal bytes, to about one document.
    The law is `bytes`; rows of equal text are not kept together. A null text has size 1 and the
    crc32 of an empty one. Repeated rows stay repeated; an empty table gives none."""
    spark = docs.sparkSession
    source = F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(old))
    sizes = docs.groupBy(source.alias("shard")).agg(F.sum(size_of(F.col("text"))).alias("bytes")).collect()
    total = sum(r["bytes"] for r in sizes)
    per_shard = max(least_blocks, -(-max((r["bytes"] for r in sizes), default=0) // block_bytes))
    path = scratch(spark, "layout")
    write_layout(docs.select("doc_id", "text", "source"), source, per_shard, path)
    if not total:
        placed = docs.select("doc_id", "text", F.lit(0).alias("shard"), F.lit(0).alias("block"))
    else:
        placed, _ = reshard(spark, path, per_shard, old, new)
    rows = placed.select("doc_id", size_of(F.col("text")).alias("size"),
                         F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "block")
    return slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                              F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                              "block")
