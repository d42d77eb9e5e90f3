"""The registered queries of the numbered operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (dac, decontam, fertility, hosts, langid, neardup, periodic, pii, quality, reshard, substring,
                           tokens, trie)
from touchline.llm.common import small_batches, table


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.by_bytes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.encode_and_read(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip_digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


# The rules of the contract (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id's crc32 is a multiple of 10 go round a loop from some word on, as the contract of op11
    says; the others, and rows without an id, are as they were."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(1).to_pylist()
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                h = zlib.crc32(str(doc_id).encode())
                words = (out[k] or "").encode().split() if doc_id is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    once = words[a:a + p]
                    words[a:] = (once * (-(-(n - a) // p)))[:n - a]
                    out[k] = b" ".join(words).decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")), min_length=12)
    first = F.expr("array_min(transform(runs, r -> struct(-r.length AS minus, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.minus div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, conversations) by the contract of op12: the first h turns of conversation c - c % 5, then the own turns after
    the first h; h is the crc32 of the id modulo 9.

    Only the first eight turns of a conversation go to others. The own turns meet what they need to know of the other
    conversation by stretches of places, so that no join is on conv_id alone."""
    own = trie.ordered(turns).withColumn("part", F.expr(f"(place - 1) div {trie.STRETCH}"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    parts = own.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = sizes.select("conv_id", base.alias("base"), h.alias("h"))
    starts = own.where("place <= 8").select(F.col("conv_id").alias("base"), "place", "role", "text")
    shared = convs.join(starts.hint("merge"), "base").where("place <= h").select("conv_id", "place", "role", "text")
    taken = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")).hint("merge"), "base", "left").select(
        "conv_id", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    known = parts.select("conv_id", "part").join(taken.hint("merge"), "conv_id")
    rest = own.where(F.col("place") > h).join(known.hint("merge"), ["conv_id", "part"]).select(
        "conv_id", (F.col("taken") + F.col("place") - h).alias("place"), "role", "text")
    return shared.unionByName(rest), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)").alias("n_removed"),
                        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_resharding": op2_resharding,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_binary": op5_token_binary,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_fertility_rules": op8_fertility_rules,
    "op9_host_reputation": op9_host_reputation,
    "op10_pii_skip_chain": op10_pii_skip_chain,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}

# crc32 of the decimal digits of an integer: eight shifts for each byte
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(x="conv_id")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(s.n, 0)), t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN s ON s.conv_id = c.base),
p AS (
  SELECT conv_id, place AS depth, strlen(text) AS bytes, string_agg(
    length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS path,
    place = max(place) OVER (PARTITION BY conv_id) AS ends
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path),
k AS (
  SELECT a.depth, a.path, b.conv_id AS parent_conv_id FROM n a JOIN n b
  ON b.depth = a.depth - 1 AND starts_with(a.path, b.path)),
u AS (SELECT n.*, k.parent_conv_id FROM n LEFT JOIN k USING (depth, path)),
w AS (SELECT conv_id, depth, path, (SELECT count(*) FROM u y WHERE y.depth = u.depth + 1 AND y.parent_conv_id = u.conv_id) AS n_children FROM u),
g AS (
  SELECT a.depth, a.path, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM n a JOIN n b ON b.depth >= a.depth AND starts_with(b.path, a.path) JOIN w ON w.depth = b.depth AND w.path = b.path
  GROUP BY a.depth, a.path)
SELECT u.conv_id, u.depth::BIGINT AS depth, u.parent_conv_id, u.n_convs, w.n_children, g.n_leaves,
  g.saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN w USING (depth, path) JOIN g USING (depth, path)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)),
f AS (SELECT seq, min(doc_id) AS first FROM s GROUP BY seq),
g AS (SELECT DISTINCT s.doc_id, s.i + o.o AS i FROM s JOIN f USING (seq) CROSS JOIN (SELECT unnest(range(13)) AS o) o WHERE f.first < s.doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

ORACLES: dict[str, str] = {"op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL}
