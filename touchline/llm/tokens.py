"""Whole texts to ids and back: the exact byte-level BPE over a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import bpe
from touchline.llm.common import small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) per row: `ids` are the text's token ids as an array<int>.

    A null or empty text has no ids. Rows, repeats and order of ids are whole;
    other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, pattern)
        for b in batches:
            found = codec.encode_all([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)],
                                             ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, decoded) per row: the bytes that the ids stand for. No ids, or null, stand for no bytes; repeated rows stay; an empty
    table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, pattern)
        for b in batches:
            texts = [codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())],
                                             ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of `docs(doc_id, text, ...)`: encode, decode, digest, in one pass over
    the texts. A null or empty text has no ids (the digests are those of nothing); repeated rows and null ids stay; equal
    texts have equal digests; an empty table gives none; other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, pattern)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in codec.encode_all([t or "" for t in b.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids),
                                              pa.array(of_bytes)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """All columns of `docs`, with `ids` and `n_tokens` after them; `text` is decoded from the ids again.

    A null text stays null and has no ids. Columns of these names in `docs` are replaced."""
    small_batches(docs.sparkSession)
    names = [n for n in docs.columns if n not in ("ids", "n_tokens")]
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = codec.encode_all([t or "" for t in texts])
            back = [t if t is None else codec.decode(np.frombuffer(x, "<u4").tolist()).decode()
                    for t, x in zip(texts, found)]
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(back, pa.string()), pa.ListArray.from_arrays(pa.array(ends), ids),
                 pa.array(np.diff(ends).astype(np.int64))], ["row", "text", "ids", "n_tokens"])

    kind = own.schema["row"].dataType.simpleString()
    out = own.mapInArrow(run, f"row {kind}, text string, ids array<int>, n_tokens bigint")
    return out.select(*[F.col("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names],
                      "ids", "n_tokens")
