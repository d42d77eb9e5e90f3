"""SimHash near-duplicates: fingerprints, Golay keys, links, classes.

No pair of documents is ever listed as such: documents are first reduced to
distinct fingerprints, and every bucket of a key gives a spanning forest of its
links only. Buckets above `bucket_cap` fingerprints are not compared pairwise:
their members go through `_ball_links`, which is exact and linear. All joins are
shuffle joins by hint: no side has a size that is known not to grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import simhash
from touchline.llm.common import columns_in_chunks, in_slices, small_batches, stage


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) per row of `docs`; fp is the 64-bit pattern as long.

    A null or empty text has fingerprint zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash.fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (v,) in columns_in_chunks(batches, 20_000):
        rows, keys = simhash.keys(v)
        yield from in_slices(pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(v[rows])], ["key", "fp"]))


def _keyed(fps: DataFrame) -> DataFrame:
    return fps.select("fp").mapInArrow(_key_rows, "key int, fp long")


def _forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph "at most max_bits apart" over a small bucket."""
    links = []
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count((left ^ x).view(np.uint64)) <= max_bits
            links += [(x, y) for y in left[close]]
            queue += list(left[close])
            left = left[~close]
    return links


def _run_links(keys: np.ndarray, fps: np.ndarray, max_bits: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys: all pairs of short runs, a spanning forest of the others."""
    at = np.nonzero(np.r_[True, keys[1:] != keys[:-1], True])[0]
    size = np.diff(at)
    us, vs = [], []
    short = np.repeat(size <= small, size)
    for d in range(1, small):
        if len(keys) <= d:
            break
        i = np.nonzero(short[:-d] & (keys[d:] == keys[:-d]))[0]
        i = i[np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= max_bits]
        us.append(fps[i])
        vs.append(fps[i + d])
    for k in np.nonzero(size > small)[0]:
        got = np.array(_forest(fps[at[k]:at[k + 1]], max_bits), np.int64).reshape(-1, 2)
        us.append(got[:, 0])
        vs.append(got[:, 1])
    return np.concatenate(us or [fps[:0]]), np.concatenate(vs or [fps[:0]])


def _bucket_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links within the buckets of `members(key, fp)`, read as runs of a partition sorted by key."""

    def run(batches):
        keys, fps = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def found(k, v):
            a, b = _run_links(k, v, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

        for k, v in columns_in_chunks(batches):
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, v))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if cut:
                yield from in_slices(found(keys[:cut], fps[:cut]))
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield from in_slices(found(keys, fps))

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, each node linked to the least of its tree: at most one link a node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for a, b in set(zip(u.tolist(), v.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    got = [(x, find(x)) for x in list(root)]
    return tuple(np.array(got, np.int64).reshape(-1, 2).T)


def _ball_masks(max_bits: int) -> np.ndarray:
    """All words of at most max_bits / 2 bits."""
    if max_bits % 2:
        raise ValueError("crowded buckets need an even max_bits")
    masks = [0]
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    shell = np.array([0], np.uint64)
    for _ in range(max_bits // 2):
        shell = np.unique((shell[:, None] ^ bits[None, :]).ravel())
        masks = np.union1d(np.array(masks, np.uint64), shell)
    return np.asarray(masks, np.uint64).view(np.int64)


def _centre_runs(centre: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(centres, their least words, links of the other words to these) of rows sorted by centre, then word."""
    at = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
    least = np.repeat(fp[at], np.diff(np.r_[at, len(fp)]))
    more = fp > least
    return centre[at], fp[at], *_spanning(fp[more], least[more])


def _ball_rows(batches: Iterator[pa.RecordBatch], masks: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
    """(centre, word, link) of `group` words at a time: each centre with its least word, and the group's forest, whose
    links travel under their own word as rows that say so."""
    for (v,) in columns_in_chunks(batches, group):
        for k in range(0, len(v), group):
            part = v[k:k + group]
            centre, fp = (part[:, None] ^ masks[None, :]).ravel(), np.repeat(part, len(masks))
            order = np.lexsort((fp, centre))
            centre, least, a, b = _centre_runs(centre[order], fp[order])
            yield from in_slices(pa.RecordBatch.from_arrays(
                [pa.array(np.r_[centre, a]), pa.array(np.r_[least, b]), pa.array(np.arange(len(centre) + len(a)) >= len(centre))],
                ["centre", "fp", "link"]))


def _ball_links(fps: DataFrame, max_bits: int, group: int = 1024) -> DataFrame:
    """Links of crowded buckets, exactly and without comparing pairs.

    Two words at most 2r apart have a word within r of both, and all words
    within r of one word are at most 2r apart: so each word names the centres
    of its ball (2,081 for r = 2), and the words of a centre are linked to the least of them.
    A task links the words of `group` at a time itself and sends each centre once, with its least word;
    what meets at a centre is at most one word a group. Either step keeps a forest only, so
    a word has at most one link from its group and one from each partition of centres.
    For an odd max_bits the ball takes the next smaller radius and one-sided
    neighbours; only even values are accepted here."""
    masks = _ball_masks(max_bits)

    def balls(batches):
        return _ball_rows(batches, masks, group)

    def meet(batches):
        held = None

        def found(centre, fp, link):
            own = ~link
            centre, fp, u, v = centre[own], fp[own], centre[link], fp[link]
            if len(centre):
                order = np.lexsort((fp, centre))
                *_, a, b = _centre_runs(centre[order], fp[order])
                u, v = np.r_[u, a], np.r_[v, b]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _spanning(u, v)], ["u", "v"])

        for part in columns_in_chunks(batches):
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last centre may go on
            if cut:
                yield from in_slices(found(*[x[:cut] for x in held]))
                held = [x[cut:] for x in held]
        if held is not None:
            yield from in_slices(found(*held))

    dealt = fps.mapInArrow(balls, "centre long, fp long, link boolean").repartition("centre").sortWithinPartitions("centre")
    return dealt.mapInArrow(meet, "u long, v long")


def links(fps: DataFrame, max_bits: int = 4, bucket_cap: int = 128) -> DataFrame:
    """Links (u > v) of distinct fingerprints `fps(fp)` that join all classes of the
    relation "at most max_bits apart"; not every linked pair is listed."""
    if max_bits > 4:
        raise ValueError("the key pairs guarantee up to 4 differing bits")
    keyed = stage(_keyed(fps), "simhash-keys")
    crowded = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_cap).select("key"),
                    "simhash-crowded")
    out = _bucket_links(keyed.join(crowded.hint("merge"), "key", "left_anti"), max_bits)
    members = keyed.join(crowded.hint("merge"), "key", "left_semi").select("fp").distinct()
    return out.unionByName(_ball_links(members, max_bits)).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges(u, v)`; root is the least node reachable.

    Alternating large-star / small-star contraction: each round is two joins
    and two partial aggregates over the links; state is written to shared storage."""
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
              "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.join(m.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                      "cc-large")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, bucket_cap: int = 128) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: doc_id, text_hash, fp, root, component_id.

    component_id: smallest doc_id reachable over links, itself included (null only where no document of
    the class has an id); root: the class's least fingerprint. Repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored."""
    own = stage(fingerprints(docs, width), "simhash-fps")
    least = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(least.select("fp"), max_bits, bucket_cap))
    # written, so that no task holds the sorts of all joins from the links to the rows, and the first is made once
    linked = stage(least.join(root.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")), "simhash-linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stage(linked.join(named.hint("merge"), "root").select("fp", "root", "component_id"), "simhash-classes")
    return _spread_join(own, by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def _spread_join(rows: DataFrame, facts: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """`rows(doc_id, text_hash, key, ...)` joined with `facts`, one row for each key, of which a few may hold most rows: a
    key's rows are dealt over `salts` places, and its facts go to those of them that have rows."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(salts)))
    there = rows.select(key, "_salt").distinct().join(facts.hint("merge"), key)
    return rows.join(there.hint("merge"), [key, "_salt"]).drop("_salt")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4, bucket_cap: int = 128) -> DataFrame:
    """The rows of `docs` with one row of each near-duplicate class: its smallest doc_id (a null id
    only where the class has no other, then the smallest text hash). Rows equal in id and text count once.

    Null and empty texts are one class. All columns of `docs` are returned, whatever their names."""
    found = stage(near_duplicates(docs, width, max_bits, bucket_cap), "neardup")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    best = found.groupBy("root").agg(F.min(rank).alias("best")).select(
        F.col("best.id").alias("best_id"), F.col("best.h").alias("best_hash"))
    copies = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    best = best.join(copies.hint("merge"), best["best_id"].eqNullSafe(copies["doc_id"]) & (best["best_hash"] == copies["text_hash"])
                     ).select("best_id", "best_hash", "copies")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    kept = own.join(best.hint("merge"), own["own_id"].eqNullSafe(best["best_id"]) & (own["own_hash"] == best["best_hash"]))
    once = kept.where("copies = 1")
    more = kept.where("copies > 1").dropDuplicates(["own_id", "own_hash"])
    return once.unionByName(more).select("row.*")
