"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to shared storage and read it back: the lineage is cut there,
    and several readers share one computation. Survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id's text modulo `folds`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def held_out(doc_id: Column | str) -> Column:
    """Rows never learned from. A null id is neither held out nor learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


BATCH_ROWS = 50_000


def in_slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows. The JVM reads a part into one buffer outside its heap; its allocator gives
    freed buffers of tens of MB back late, so large batches add up beside the heap."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def columns_in_chunks(batches: Iterable[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of many small batches as arrays of about `rows` values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held = []
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
