"""Personal data in whole texts: fixed patterns, and a skip-chain field beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import crf
from touchline.llm.common import small_batches

SAMPLE_NODES = 400  # documents with more candidate tokens are not learned from


def train(docs: DataFrame, sample_docs: int = 20_000) -> crf.Model:
    """Fit the field on a bounded sample: about `sample_docs` rows of `docs(doc_id, text)`, by a hash of
    doc_id, of which only those with candidate tokens count."""
    small_batches(docs.sparkSession)
    total = docs.count()
    if not total:
        return crf.fit([], [])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.where(F.col("doc_id").isNotNull() & (spot < sample_docs / total)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base = crf.base_spans(t or "")
                g = crf.graph(t) if t and crf._ANY.search(t) else None
                if g and 0 < len(g.core) <= SAMPLE_NODES:
                    flat = [f for f in g.feats]
                    out.append({"feats": flat, "edges": [list(e) for e in g.edges if e[2] == crf.CHAIN],
                                "labels": crf.known_labels(g, base), "hidden": crf.masked(t, base)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("feats", pa.list_(pa.list_(pa.int32()))), ("edges", pa.list_(pa.list_(pa.int32()))),
                ("labels", pa.list_(pa.int32())), ("hidden", pa.list_(pa.list_(pa.int32())))]))

    # features are made where the texts are; only they meet in one task
    got = rows.mapInArrow(run, "feats array<array<int>>, edges array<array<int>>, labels array<int>, hidden array<array<int>>"
                          ).limit(2 * sample_docs).toArrow()
    examples = sorted(got.to_pylist(), key=lambda r: (r["labels"], r["feats"]))
    graphs = [crf.Graph(feats=r["feats"], edges=[tuple(e) for e in r["edges"]]) for r in examples]
    return crf.fit(graphs, [r["labels"] for r in examples], [f for r in examples for f in r["hidden"]])


def spans_of(texts: list[str], model: crf.Model) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; a span is (start, kind, end) in code points."""
    out: list[tuple[list, list]] = []
    graphs, owners = [], []
    for k, t in enumerate(texts):
        base = crf.base_spans(t)
        out.append((base, []))
        if crf._ANY.search(t):
            g = crf.graph(t)
            if g.core:
                graphs.append(g)
                owners.append(k)
    if graphs:
        belief, at = model.marginals(graphs, [crf.labels(g, out[k][0]) for k, g in zip(owners, graphs)]), 0
        for k, g in zip(owners, graphs):
            found = crf.added_spans(texts[k], g, belief[at:at + len(g.core)], out[k][0])
            out[k] = (out[k][0], found)
            at += len(g.core)
    return out


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{crf.KINDS[kind]}:{a}:{z}" for a, kind, z in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind's name in brackets; overlapping spans as one,
    under the kind of the first."""
    merged: list[list[int]] = []
    for a, kind, z in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], z)
        else:
            merged.append([a, kind, z])
    out, at = [], 0
    for a, kind, z in merged:
        out += [text[at:a], f"[{crf.KINDS[kind].upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def find(docs: DataFrame, sample_docs: int = 20_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of `docs(doc_id, text, ...)`.

    The counts and the digest are of the pattern spans; `spans` lists these and the field's.
    A null text is an empty one (no spans). Repeated rows stay repeated; an empty table gives none."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = train(own, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = spans_of(b.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(listing(base).encode()).hexdigest() for base, _ in found])
            every = pa.array([listing(base + more) for base, more in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, digest, every],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                               "base_sha256 string, spans string")


def redacted(docs: DataFrame, sample_docs: int = 20_000) -> DataFrame:
    """All rows and columns of `docs`, with every span of `text` replaced by its kind; n_chars follows where there is
    such a column. A null text stays null. Repeated rows stay repeated; an empty table gives an empty one."""
    model = train(docs.select("doc_id", "text"), sample_docs)
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = spans_of([t or "" for t in texts], model)
            new = [t if t is None else redact(t, base + more) if base or more else t
                   for t, (base, more) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["row", "text"])

    kind = own.schema["row"].dataType.simpleString()
    out = own.mapInArrow(run, f"row {kind}, text string")
    cols = [F.col("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names]
    out = out.select(*cols)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType),
                                                   F.col("n_chars")))
    return out
