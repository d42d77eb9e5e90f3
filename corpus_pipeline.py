"""The corpus pipeline: stages over `documents`, each written and read again.

Counted as part of touchline.llm. Every stage takes (spark, docs, sf_dir), works on
all rows that its predecessor kept, and returns the columns of `documents`; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontam, langid, neardup, pii, tokens
from touchline.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator's verdict decides. Documents without a language go: null texts, texts without a letter, and
    texts whose score is under the models' limit (`langid.reject_limit`), which are in no learned language.
    The others get the predicted language as `lang`, whatever they had."""
    model = langid.train(docs, rejecting=True)
    found = langid.identify(docs, model).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= model.limit))
    cols = [F.col("lang_pred").alias("lang") if c == "lang"
            else F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*cols)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest doc_id. Null and empty texts are one class;
    equal rows count once; an empty table stays empty."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows go or stay together; without items, or without
    documents, nothing goes."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by its kind, and n_chars follows."""
    return pii.redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of `documents`, the text's token ids and their number. The text is the one decoded from the ids; an empty text has no
    ids, repeated rows stay, an empty table stays empty."""
    return tokens.with_ids(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_neardup", simhash_neardup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None  # trained models, fingerprints and merges are not SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
