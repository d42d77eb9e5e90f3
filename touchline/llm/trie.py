"""Prefix trie of conversations: subtree figures by the Euler-tour technique.

Nodes. A prefix is known by the exclusive-or of the hashes of its (place, turn) pairs, 128 bits, which a running window gives
over short stretches of a conversation; so no conversation is held whole. A node is named (smallest member, depth).

Tour. Every node has an enter and an exit arc, each with one successor: enter leads to the first child's enter or, in a
leaf, to the own exit; exit leads to the next sibling's enter or to the parent's exit. Children are dealt into buckets by a hash and ordered by
(bucket, smallest member), so a parent's children are never in one window: within a bucket by a window, from bucket to bucket by a window over
the buckets.

Ranking. The tour is a linked list; `list_rank` contracts it by random mates - an arc with coin 1 after an arc with coin 0 is spliced out,
about a quarter of the list a round - down to `base` arcs, ranks those, and gives the removed ones their rank round by round
backwards. Each round shuffles what is left once, so all rounds together move a few times the list.
Ranks are sums of weights before an arc: places, leaves, savings; a subtree's figure is the difference of its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stage

STRETCH = 1024   # turns of one window over a conversation
BUCKETS = 1024   # of the children of one node
ENDS = 512       # conversation ids (by value) listed at once
BASE = 1 << 14   # arcs that one task ranks
WEIGHTS = ("pos", "leaves", "saved")


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of `turns(conv_id, turn, role, text, ...)`: places from 1 by turn, null first.

    Null roles and texts become empty; turns of one number are ordered by role, then text. Rows without a conv_id belong to no
    conversation. A conversation is cut into stretches of turn numbers; a window sees one stretch."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "part", F.expr(f"turn div {STRETCH} - IF(turn < 0, 1, 0)"))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first())
    upto = F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    counts = own.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(upto, F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = own.withColumn("k", F.row_number().over(inside))
    placed = ranked.join(counts.hint("merge"), (F.col("conv_id") == F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    return placed.select("conv_id", (F.col("before") + F.col("k")).alias("place"), "role", "text")


def _running_xor(rows: DataFrame, by: str, place: str, columns: dict[str, Column]) -> DataFrame:
    """`rows` with running exclusive-ors along `place` (from 1, gapless, unique within `by`)."""
    rows = rows.withColumn("_part", F.expr(f"({place} - 1) div {STRETCH}")).withColumns(columns)
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_part").agg(*[F.bit_xor(c).alias(c) for c in columns])
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), *[
        F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(by, "_part").orderBy(place)
    own = rows.withColumns({c: F.expr(f"bit_xor({c})").over(inside) for c in columns})
    joined = own.join(sums.hint("merge"), (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.withColumns({c: F.col(c).bitwiseXOR(F.col(f"_{c}")) for c in columns}).drop(
        "_part", "_by", "_p", *[f"_{c}" for c in columns])


def prefixes(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, up1, up2, bytes): the node of every prefix of `paths(conv_id, place, role, text)`."""
    turn = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    own = paths.select("conv_id", F.col("place").alias("depth"), F.octet_length("text").cast("long").alias("bytes"),
                       turn.alias("turn"))
    own = own.withColumns({"h1": F.xxhash64("depth", "turn"), "h2": F.xxhash64(F.reverse("turn"), "depth")}).drop("turn")
    run = _running_xor(own, "conv_id", "depth", {"k1": F.col("h1"), "k2": F.col("h2")})
    return run.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("up1"),
                      F.col("k2").bitwiseXOR(F.col("h2")).alias("up2"), "bytes")


def nodes_of(found: DataFrame, every: DataFrame) -> DataFrame:
    """(depth, k1, k2, up1, up2, conv_id, n_convs, bytes) of every node; the root (depth 0, keys 0) if there is a
    conversation in `every(conv_id)`."""
    own = found.groupBy("depth", "k1", "k2").agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("up1"), zero.alias("up2"),
        "conv_id", "n_convs", zero.alias("bytes"))
    return own.unionByName(root)


def linked(nodes: DataFrame) -> DataFrame:
    """Of every node: conv_id, depth, n_convs, bytes, parent_conv_id, n_children, first_child, next_sibling (smallest
    members; null where there is none)."""
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS))
    children = nodes.where("depth > 0").select(
        "conv_id", "depth", (F.col("depth") - 1).alias("pd"), F.col("up1").alias("p1"), F.col("up2").alias("p2"),
        bucket.alias("bucket"))
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("pd"), F.col("k1").alias("p1"),
                           F.col("k2").alias("p2"))
    buckets = children.groupBy("pd", "p1", "p2", "bucket").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    along = Window.partitionBy("pd", "p1", "p2").orderBy("bucket")
    buckets = buckets.withColumns({"then": F.lead("first").over(along), "lead": F.row_number().over(along) == 1})
    buckets = stage(buckets.join(parents.hint("merge"), ["pd", "p1", "p2"]), "trie-buckets")
    own = children.withColumn("after", F.lead("conv_id").over(
        Window.partitionBy("pd", "p1", "p2", "bucket").orderBy("conv_id")))
    links = own.join(buckets.drop("first", "n", "lead").hint("merge"), ["pd", "p1", "p2", "bucket"]).select(
        "conv_id", "depth", "parent_conv_id", F.coalesce("after", "then").alias("next_sibling"))
    below = buckets.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("pd").alias("depth")).agg(
        F.sum("n").alias("n_children"), F.min(F.when(F.col("lead"), F.col("first"))).alias("first_child"))
    return (nodes.select("conv_id", "depth", "n_convs", "bytes").join(links.hint("merge"), ["conv_id", "depth"], "left")
            .join(below.hint("merge"), ["conv_id", "depth"], "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))


def arcs_of(nodes: DataFrame) -> DataFrame:
    """(c, e, to_c, to_e, pos, leaves, saved): the Euler tour as a linked list. Arc (c, e) enters node (c, depth) for
    e = 2 * depth and leaves it for e + 1; the weights count from an arc on; the root's exit leads nowhere."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    e = F.col("depth") * 2
    leaf = F.col("first_child").isNull()
    enter = nodes.select(
        F.col("conv_id").alias("c"), e.alias("e"), F.coalesce("first_child", "conv_id").alias("to_c"),
        F.when(leaf, e + 1).otherwise(e + 2).alias("to_e"), one.alias("pos"), leaf.cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    leave = nodes.select(
        F.col("conv_id").alias("c"), (e + 1).alias("e"), F.coalesce("next_sibling", "parent_conv_id").alias("to_c"),
        F.when(F.col("next_sibling").isNotNull(), e).when(F.col("depth") > 0, e - 1).alias("to_e"),
        one.alias("pos"), none.alias("leaves"), none.alias("saved"))
    return enter.unionByName(leave)


def _walk(arcs: DataFrame) -> DataFrame:
    """Ranks of a list of bounded size, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        at = {r[:2]: r for r in rows}
        heads = at.keys() - {r[2:4] for r in rows}
        out = []
        for here in sorted(heads):
            total = [0] * len(WEIGHTS)
            while here in at:
                out.append((*here, *total))
                total = [a + b for a, b in zip(total, at[here][4:])]
                here = at[here][2:4]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else
                                         [pa.array([], pa.int64())] * (2 + len(WEIGHTS)), ["c", "e", *WEIGHTS])

    return arcs.coalesce(1).mapInArrow(run, ", ".join(f"{x} long" for x in ("c", "e", *WEIGHTS)))


def list_rank(arcs: DataFrame, base: int = BASE) -> DataFrame:
    """(c, e, pos, leaves, saved): of each arc of the lists `arcs(c, e, to_c, to_e, pos, leaves, saved)` the sums of the weights of
    the arcs before it. Several lists are ranked each from its own head; an empty table gives none; a ring is an error.

    The coin of an arc is a hash of its name and the round, so a task that runs again tosses the same."""
    left = stage(arcs, "trie-arcs")
    n, removed = left.count(), []
    while n > base:
        if len(removed) > 400:
            raise ValueError("the arcs do not form lists")
        coin = F.pmod(F.xxhash64("c", "e", F.lit(len(removed))), F.lit(2))
        mates = left.where(coin == 1).select([F.col(x).alias(f"b_{x}") for x in left.columns])
        joined = left.where(coin == 0).join(mates.hint("merge"), (F.col("to_c") == F.col("b_c")) & (F.col("to_e") == F.col("b_e")), "full")
        both = F.col("c").isNotNull() & F.col("b_c").isNotNull()
        joined = stage(joined.withColumn("both", both), "trie-mates")
        removed.append(joined.where("both").select(
            F.col("b_c").alias("c"), F.col("b_e").alias("e"), F.col("c").alias("a_c"), F.col("e").alias("a_e"),
            *WEIGHTS))
        kept = [F.coalesce("c", "b_c").alias("c"), F.coalesce("e", "b_e").alias("e")]
        # an arc that took its mate goes on where the mate did, with both weights
        kept += [F.when(F.col("both") | F.col("c").isNull(), F.col(f"b_{x}")).otherwise(F.col(x)).alias(x)
                 for x in ("to_c", "to_e")]
        kept += [(F.coalesce(x, F.lit(0)) + F.coalesce(f"b_{x}", F.lit(0))).alias(x) for x in WEIGHTS]
        left = joined.select(*kept)
        n = left.count()
    ranks = stage(_walk(left), "trie-ranks")
    for gone in reversed(removed):
        before = ranks.select(F.col("c").alias("a_c"), F.col("e").alias("a_e"), *[F.col(w).alias(f"r_{w}") for w in WEIGHTS])
        back = gone.join(before.hint("merge"), ["a_c", "a_e"]).select(
            "c", "e", *[(F.col(w) + F.col(f"r_{w}")).alias(w) for w in WEIGHTS])
        ranks = stage(ranks.unionByName(back), "trie-ranks")
    return ranks


def ends_of(last: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of `last(conv_id, depth, k1, k2)`: SHA-256 of the ids, ascending, comma-joined. Ids are
    joined in stretches of ENDS values first; a digest reads its stretches in order and holds one batch of them."""
    parts = last.withColumn("part", F.expr(f"conv_id div {ENDS} - IF(conv_id < 0, 1, 0)")).groupBy(
        "depth", "k1", "k2", "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("depth", "k1", "k2", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())],
                                              ["depth", "k1", "k2", "ends_sha256"])

        for b in batches:
            rows = []
            for *key, ids in zip(*(b[k].to_pylist() for k in ("depth", "k1", "k2", "ids"))):
                if key != at:
                    if at is not None:
                        rows.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield done(rows)
        if at is not None:
            yield done([(*at, digest.hexdigest())])

    dealt = parts.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "part")
    return dealt.select("depth", "k1", "k2", "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame, convs: DataFrame, base: int = BASE) -> DataFrame:
    """One row per distinct prefix of the conversations `paths(conv_id, place, role, text)` (places from 1, gapless),
    the empty one included: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the UTF-8 bytes of the last text), ends_sha256.

    convs(conv_id): all conversations, those without a turn too; they end at the root. Equal conversations share
    all nodes. Roles and texts must not be null (`ordered` makes them so); without conversations there is no node."""
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    found = stage(prefixes(paths), "trie-prefixes")
    nodes = stage(nodes_of(found, every), "trie-nodes")
    tree = stage(linked(nodes), "trie-links")
    ranks = list_rank(arcs_of(tree), base)
    # a node's enter and exit arcs: what lies between is its subtree
    spans = ranks.groupBy("c", F.expr("e div 2").alias("depth")).agg(
        *[(F.max(w) - F.min(w)).alias(f"n_{w}") for w in ("leaves", "saved")])
    longest = found.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("end"))
    zero = F.lit(0).cast("long")
    last = every.join(longest.hint("merge"), "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"end.{k}", zero).alias(k) for k in ("depth", "k1", "k2")])
    ends = nodes.select("conv_id", "depth", "k1", "k2").join(ends_of(last).hint("merge"), ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return (tree.join(spans.withColumnRenamed("c", "conv_id").hint("merge"), ["conv_id", "depth"])
            .join(ends.hint("merge"), ["conv_id", "depth"])
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves"),
                    F.col("n_saved").alias("saved_tokens"), "ends_sha256"))
