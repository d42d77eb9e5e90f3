import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import EDGE, documents, sf_rows
from touchline.llm import bpe, dac, tokens
from touchline.llm.queries import QUERIES

CODEC = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "ß", "日本", "😀", "1", "23", "!!", "\x1c", "\xa0", " ", "the",
          "ing", " of", "\r\n", "aaaa", "===", " \n", " x", "<|endoftext|>", "tion"]


def same(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_merges_are_exact(text):
    assert same(text)
    assert CODEC.decode(np.frombuffer(CODEC.encode(text), "<u4").tolist()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_library_ids_of_units_are_those_of_the_text(text):
    got, = dac.library(dac.TOKENIZER).encode_all([text])
    assert np.frombuffer(got, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ab" * 20_000, "=-" * 20_000, "x" * 40_000, " " * 30_000, "é" * 20_000])
def test_very_long_pieces(text):
    assert same(text)


def test_bpe_query_matches_tiktoken(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, sf).collect()}
    rows = sf_rows(sf, "documents", "doc_id, coalesce(text, '')")
    assert len(got) == len(rows)
    for d, t in rows:
        ids = np.array(TIKTOKEN.encode_ordinary(t), "<u4")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_edges(spark):
    df = documents(spark, EDGE)
    got = tokens.decode(tokens.encode(df)).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, *_ in EDGE)
    out = tokens.with_ids(df)
    assert out.columns == [c for c in df.columns if c != "ids"] + ["ids", "n_tokens"]
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(t) for _, t, *_ in EDGE)
    assert tokens.round_trip_digests(documents(spark, [])).count() == 0
    assert tokens.with_ids(documents(spark, [])).count() == 0


@pytest.mark.parametrize("width", [4, 8, 12])
def test_codes_give_random_access(width):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 60_000, 20_000)
    ids[rng.random(20_000) < 0.5] %= 7
    r = dac.Reader(dac.pack([1, None], [15_000, 5_000], ids.astype(np.uint32), width))
    at = rng.integers(0, 20_000, 5_000)
    assert (r.get(at) == ids[at]).all() and (r.span(777, 19_001) == ids[777:19_001]).all()
    assert r.span(5, 5).size == 0 and r.doc_ids == [1, None] and r.first.tolist() == [0, 15_000, 20_000]
    with pytest.raises(IndexError):
        r.get(np.array([20_000]))


def check_files(df_rows, got):
    """got: rows of the query; df_rows: (doc_id, text)."""
    order = sorted(df_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    rows = sorted(got, key=lambda r: r["start"])
    assert len(rows) == len(order) and [r["doc_id"] for r in rows] == [d for d, _ in order]
    at = 0
    sums = {}
    for d, t in order:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0]
        sums.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in rows:
        assert r["start"] == at
        sums[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]


def test_file_query_matches_library(spark, sf):
    check_files(sf_rows(sf, "documents", "doc_id, text"), QUERIES["op5_token_binary"](spark, sf).collect())


def test_file_edges(spark):
    check_files([(d, t) for d, t, *_ in EDGE], dac.encode_and_read(documents(spark, EDGE)).collect())
    assert dac.encode_and_read(documents(spark, [])).count() == 0


def test_small_files_hold_all(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5), "en", "s") for i in range(100)]
    files = dac.write_files(documents(spark, rows), f"file://{tmp_path}/dac", file_tokens=40).cache()
    assert files.count() > 5
    got = dac.read_documents(dac.manifest(files), f"file://{tmp_path}/dac").collect()
    check_files([(d, t) for d, t, *_ in rows], got)
