"""Benchmark decontamination: every passage of every text is a query against the items' index."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import scratch, small_batches, stage
from touchline.llm.wand import MIN_WORDS, Index, words

SHARD_BYTES = 256 << 10   # text of the items of one index
PASS_BYTES = 16 << 20     # of the written indexes that a worker keeps; the others are read again for each batch


def _grade(n_words: int) -> int:
    """Items of up to 64 words, 512, 4,096 and so on have indexes of their own, with windows to match."""
    k = 0
    while n_words > 64 << 3 * k:
        k += 1
    return k


def _items_with_terms(items: DataFrame) -> DataFrame:
    """(item_id, text, size, grade, terms): the distinct items that have a word."""
    kept = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t, w) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist()) if (w := words(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in found], pa.int64()), pa.array([t for _, t, _ in found], pa.string()),
                 pa.array([len(w) for *_, w in found], pa.int64()),
                 pa.array([_grade(len(w)) for *_, w in found], pa.int32()),
                 pa.array([sorted(set(w)) for *_, w in found], pa.list_(pa.binary()))],
                ["item_id", "text", "size", "grade", "terms"])

    return stage(kept.mapInArrow(run, "item_id long, text string, size long, grade int, terms array<binary>"),
                 "decontam-items")


def _write_indexes(items: DataFrame) -> list[str]:
    """Files of one index each, built in tasks, in the shared checkpoint folder. Each index has items of one grade and
    hash bucket, about SHARD_BYTES of text (a larger item has its own); frequencies are those of all items."""
    spark = items.sparkSession
    own = _items_with_terms(items)
    slices = {r["grade"]: -(-r["n"] // SHARD_BYTES)
              for r in own.groupBy("grade").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not slices:
        return []
    counted = own.where(F.col("size") >= MIN_WORDS)
    total, mean = counted.agg(F.count("*"), F.coalesce(F.sum("size") / F.count("*"), F.lit(1.0))).first()
    n = F.create_map(*[F.lit(v) for kv in slices.items() for v in kv])[F.col("grade")]
    sliced = own.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), n))
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = sliced.where(F.col("size") >= MIN_WORDS).select("grade", "slice", F.explode("terms").alias("term"))
    terms = terms.distinct().join(df, "term")
    rows = terms.select("grade", "slice", "term", "df", F.lit(None).cast("long").alias("item_id"),
                        F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(sliced.select("grade", "slice", "item_id", "text"), allowMissingColumns=True)
    shard_bytes = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, df, held, size = None, {}, [], 0

        def index() -> pa.RecordBatch:
            data = pickle.dumps(Index(held, stats=(total, mean, df)))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["index"])

        for b in batches:
            for grade, part, term, count, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if (grade, part) != at:
                    if held:
                        yield index()
                    at, df, held, size = (grade, part), {}, [], 0
                if term is not None:
                    df[term] = count
                    continue
                own_size = len(t.encode())
                if held and size + own_size > shard_bytes:
                    yield index()
                    held, size = [], 0
                held.append((i, t))
                size += own_size
        if held:
            yield index()

    path = scratch(spark, "decontam-indexes")
    # the frequencies of a slice come before its items
    dealt = rows.repartition("grade", "slice").sortWithinPartitions("grade", "slice", F.col("item_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, "index binary").write.option("maxRecordsPerFile", 1).parquet(path)
    return sorted(spark.read.schema("index binary").parquet(path).inputFiles())


def _read(path: str) -> list[bytes]:
    fs, name = pafs.FileSystem.from_uri(path)
    return pq.read_table(name, filesystem=fs, partitioning=None)["index"].to_pylist()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.5,
          answer: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, item_id, score, question_overlap, answer_overlap), one row for each row of
    `docs(doc_id, text, ...)` and item of `items(item_id, text)` that some passage of the text
    holds: BM25 share of the item's own score at least `threshold`, and that share of the
    word trigrams of the item's question and of its answer in the passage.

    Null and empty texts hold nothing; null items and items without a word are no evidence; items
    under five words are found as exact runs of words. Repeated documents give repeated rows; an empty table on either side gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    out = ("doc_id long, text_hash long, item_id long, score double, question_overlap double, "
           "answer_overlap double")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    files = _write_indexes(items)
    if not files:
        return spark.createDataFrame([], out)
    limits, room = (threshold, question, answer), PASS_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, others, held = [], [], 0
        for k, f in enumerate(files):
            data = _read(f)
            held += sum(map(len, data))
            if kept and held > room:
                others = files[k:]
                break
            kept += map(pickle.loads, data)
        for b in batches:
            found = [{} for _ in range(b.num_rows)]
            texts = b["text"].to_pylist()

            def search(indexes: list[Index]) -> None:
                for best, t in zip(found, texts):
                    w = words(t)
                    for ix in indexes:
                        for item, now in ix.leaks_in(w, *limits).items():
                            best[item] = max(best.get(item, now), now)

            search(kept)
            for f in others:
                search([pickle.loads(d) for d in _read(f)])
            rows = [(d, h, item, *best) for d, h, own in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), found)
                    for item, best in sorted(own.items())]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["doc_id", "text_hash", "item_id", "score", "question_overlap", "answer_overlap"])

    return texts.mapInArrow(run, out)


def without_leaks(docs: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """The rows of `docs` that hold no item; rows are told apart by id and text, so a null id is fine."""
    bad = leaks(docs, items, **limits).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    clean = own.join(bad.distinct(), F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")),
                     "left_anti")
    return clean.select("row.*")
