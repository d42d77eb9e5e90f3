"""Inputs shared by the tests: rows with nulls, empty and very long texts, repeats, clashing column names."""

from __future__ import annotations

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           # names that the operators use inside
           "row string, fp long, h long, block int, shard int, ids string, key int, score double, own_id long, grp string")
CLASH = ("r", 1, 2, 3, 4, "ids", 5, 0.5, 6, "g")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(d, t, lang, s, None if t is None else len(t), *CLASH) for d, t, lang, s in rows]
    return spark.createDataFrame(full, COLUMNS)


LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(30_000)) + ". mail a.b@c.org and +1 (523) 555-1055"
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "s"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "s"),  # repeated row
    (2, "The quick brown fox jumps over the lazy dog near the river bank.", None, None),  # equal text
    (3, None, "en", "s"),
    (4, "", "en", "s"),
    (5, " \t\n\r ", None, "s"),
    (None, "Der schnelle braune Fuchs springt.", "de", "s"),
    (None, None, None, None),
    (6, LONG, "en", "s"),
    (7, "x" * 300_000, "en", "s"),
    (8, "1" * 200_000, "fr", "s"),
    (9, "日本語 的 文本 😀   é", None, "s"),
    (10, "@", "es", "s"),
    (-11, "<|endoftext|> a\x1fb", "es", "s"),
]


def sf_rows(sf, name, columns="*"):
    import duckdb

    return duckdb.connect().sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()
