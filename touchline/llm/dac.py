"""Directly addressable codes: a token-id file with random access to any token.

An id is cut into `width`-bit chunks, lowest first. Level k holds the k-th
chunks of all ids that have one, in order; a bitmap says for each chunk whether
the id goes on, and a rank directory counts the ones before each 512-bit block.
Token i is read as: chunk i of level 0; if its bit is set, chunk rank(i) of level
1, and so on. No block is ever decoded.

File (little-endian): magic 8s, width u32, levels u32, documents u64, tokens u64;
document ids i64[documents] and a null bitmap u8[documents]; first tokens
u64[documents + 1]; then per level: length u64, chunks (u8 or u16), bitmap
u64[ceil(n / 512) * 8], directory u64[ceil(n / 512) + 1]."""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import bpe
from touchline.llm.common import scratch, small_batches, stage

MAGIC = b"TLDAC001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_HEAD = struct.Struct("<8sIIQQ")


# -- the code ---------------------------------------------------------------
def _levels(ids: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kind = np.uint8 if width <= 8 else np.uint16
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> np.uint32(width)) > 0
        blocks = -(-len(rest) // 512)
        bits = np.zeros(blocks * 512, bool)
        bits[: len(more)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        per_block = np.bitwise_count(words).reshape(blocks, 8).sum(axis=1, dtype=np.uint64)
        out.append(((rest & np.uint32((1 << width) - 1)).astype(kind), words,
                    np.concatenate((np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)))))
        if not more.any():
            return out
        rest = rest[more] >> np.uint32(width)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int = 8) -> bytes:
    levels = _levels(ids, width)
    out = io.BytesIO()
    out.write(_HEAD.pack(MAGIC, width, len(levels), len(doc_ids), len(ids)))
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.cumsum([0, *lengths]).astype("<u8").tobytes())
    for chunks, words, ranks in levels:
        out.write(struct.pack("<Q", len(chunks)))
        for a in (chunks, words, ranks):
            out.write(a.tobytes())
    return out.getvalue()


class Reader:
    """Random access to the tokens of one packed file."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, n_levels, n_docs, self.n_tokens = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        own, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(own, null)]
        self.first = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // 512)
            self.levels.append((take("u1" if self.width <= 8 else "<u2", n), take("<u8", blocks * 8),
                                take("<u8", blocks + 1).astype(np.int64)))

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, word = at >> 9, at >> 6
        out = ranks[block]
        for k in range(7):  # whole words of the block before the position's own
            w = (block << 3) + k
            out = out + np.where(w < word, np.bitwise_count(words[np.minimum(w, len(words) - 1)]), 0)
        own = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return out + np.bitwise_count(own)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions, in any order."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_tokens):
            raise IndexError("no such token")
        out = np.zeros(len(at), np.uint32)
        slot, shift = np.arange(len(at)), 0
        for chunks, words, ranks in self.levels:
            if not len(at):
                break
            out[slot] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            on = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            slot, at = slot[on], self._rank(words, ranks, at[on])
            shift += self.width
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of [start, end): one rank a level finds where the run begins there."""
        out = np.zeros(end - start, np.uint32)
        slot, a, z, shift = np.arange(end - start), start, end, 0
        for chunks, words, ranks in self.levels:
            if a >= z:
                break
            out[slot] |= chunks[a:z].astype(np.uint32) << np.uint32(shift)
            octets = words[a >> 6: (z + 63) >> 6].view(np.uint8)
            on = np.unpackbits(octets, bitorder="little")[a & 63: (a & 63) + z - a].astype(bool)
            slot, a = slot[on], int(self._rank(words, ranks, np.array([a]))[0])
            z = a + len(slot)
            shift += self.width
        return out


# -- files --------------------------------------------------------------------
def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


class Library:
    """Ids by the tokenizers library, each distinct unit (see `bpe.units`) encoded once while it is remembered."""

    def __init__(self, path: str, memo: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = bpe.Memo(memo)
        # one character of a byte-level entry stands for one byte; an added token is its own text
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.bytes_of = np.array([len(added[i].encode()) if i in added else len(self.tokenizer.id_to_token(i) or "")
                                  for i in range(size)])

    def _spaced(self, units: list[str], run: int = 1000) -> list[bytes]:
        """Ids of units that follow a space or begin with a line feed. Runs of units are handed over as one text
        (nothing is merged over their borders), and its ids are cut where the bytes of a unit end."""
        out: list[bytes] = []
        whole = [u if u[:1] == "\n" else " " + u for u in units]
        runs = [whole[k:k + run] for k in range(0, len(whole), run)]
        texts = ["".join(r) for r in runs]
        for r, text, e in zip(runs, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(u.encode()) for u in r])
            cut = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cut - 1], wanted):
                raise ValueError("the vocabulary's entries do not keep the bytes of the text")
            data = ids.tobytes()
            at = [0, *(4 * cut).tolist()]
            out += [data[a:z] for a, z in zip(at, at[1:])]
        return out

    def _others(self, units: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        return bpe.encode_texts(texts, self.memo, self._spaced, self._others)


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    """One tokenizer for each Python worker."""
    return Library(path)


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 0, width: int = 8,
                file_tokens: int = 2_000_000) -> DataFrame:
    """Write the ids of all texts, `end_id` after each, in ascending doc_id (nulls first,
    equal ids by text hash) as files of about `file_tokens` tokens.

    Returns one row per file: path, first_id, first_hash, part, seq, n_docs, n_tokens.
    A document is never split over files. Files are put in place under their
    final name in one step, so a task that runs again replaces them with the same bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        out_fs, out_base = _open(folder)
        ids, held, first = [], 0, None
        doc_ids: list[int | None] = []
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            name = f"{out_base}/part-{part:06d}-{seq:06d}.dac"
            tmp = f"{out_base}/.{uuid.uuid4().hex}"
            flat = np.frombuffer(b"".join(ids), "<u4")
            with out_fs.open_output_stream(tmp) as f:
                f.write(pack(doc_ids, [len(x) // 4 for x in ids], flat, width))
            if out_fs.get_file_info(name).type == pafs.FileType.NotFound:
                out_fs.move(tmp, name)
            else:  # an earlier attempt of this task wrote the same bytes
                out_fs.delete_file(tmp)
            row = [name, first[0], first[1], part, seq, len(doc_ids), len(flat)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              ["path", "first_id", "first_hash", "part", "seq", "n_docs", "n_tokens"])

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for key, x in zip(keys, library(tokenizer).encode_all(b.column(2).to_pylist())):
                first = first or key
                doc_ids.append(key[0])
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= file_tokens:
                    yield flush()
                    seq, ids, doc_ids, held, first = seq + 1, [], [], 0, None
        if doc_ids:
            yield flush()

    ordered = (docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("h"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h")))
    return ordered.mapInArrow(run, "path string, first_id long, first_hash long, part int, seq int, n_docs long, "
                                   "n_tokens long")


def manifest(files: DataFrame) -> DataFrame:
    """`files` with `base`: tokens of all files before. One small row per file goes through the window."""
    w = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "part", "seq").rowsBetween(
        Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the files in `manifest` form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    r = Reader(f.read())
                ids = memoryview(r.span(0, r.n_tokens).astype("<u4").tobytes())  # one file is bounded
                sums = [zlib.crc32(ids[4 * a:4 * z]) for a, z in zip(r.first[:-1].tolist(), r.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.doc_ids, pa.int64()), pa.array(r.first[:-1] + base), pa.array(np.diff(r.first)),
                     pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "base").repartition(parts, "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all texts of `docs(doc_id, text, ...)` and read the documents back from the files.

    A null text is an empty one: its only id is the end id. Repeated rows stay
    repeated; an empty table writes no file and gives no rows."""
    folder = scratch(docs.sparkSession, "dac")
    files = stage(write_files(docs, folder, tokenizer), "dac-files")
    return read_documents(stage(manifest(files), "dac-manifest"), folder)
