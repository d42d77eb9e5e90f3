"""Season files: write, audit, scan and combine.

The reference reads one CSV per season from a folder, prints each file's
columns, concatenates them (missing columns become null) and writes the
combined table. Here every step is a Spark read / write; the number of jobs does
not depend on the number of files.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir

# Columns the tuned odds feed only has in odd seasons (so files differ in schema).
ODD_SEASON_ONLY = ["odds_over25", "odds_btts_yes"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def write_season_files(raw: DataFrame, root: str) -> str:
    """One CSV folder per season (header on) below `root`; even seasons lack ODD_SEASON_ONLY.

    Two partitioned writes (odd seasons with every column, even seasons
    without the odd-only ones), each one pass over the table."""
    odd = F.col("season") % 2 == 1
    even_cols = [c for c in raw.columns if c not in ODD_SEASON_ONLY]
    (raw.where(odd).withColumn("__season", F.col("season")).write.mode("overwrite")
     .partitionBy("__season").option("header", True).csv(f"{root}/odd"))
    (raw.where(~odd).select(*even_cols).withColumn("__season", F.col("season")).write.mode("overwrite")
     .partitionBy("__season").option("header", True).csv(f"{root}/even"))
    return root


WHOLE_FILE = 1 << 40  # bytes of one partition of a header read: a file is not split
GROUP = 64            # files of one header job


def _unsplit(spark: SparkSession) -> SparkSession:
    """A session whose scans read a file in one partition, whatever its length and the cluster's cores.

    The largest partition is the smaller one of `maxPartitionBytes` and the input's share of each of `minPartitionNum`
    partitions, which is the number of cores unless it is set."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.files.maxPartitionBytes", str(WHOLE_FILE))
    apart.conf.set("spark.sql.files.minPartitionNum", "1")
    return apart


def file_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, season, columns) of every file with a line below `root`: the names in its first line, quotes resolved.

    Each file is read with a limit of one line, which stops its task after the first buffer whatever the file's length, in one
    partition (by a setting of a session made for this read). A job reads a group of files, a task each. The driver holds the
    file list, as for any Spark read of these files, and their first lines."""
    apart = _unsplit(spark)
    paths = sorted(apart.read.option("recursiveFileLookup", True).text(root).inputFiles())
    rows = []
    for k in range(0, len(paths), GROUP):
        one = [apart.read.text(p).limit(1).select(F.lit(p).alias("path"), "value") for p in paths[k:k + GROUP]]
        rows += [(r["path"], next(csv.reader([r["value"]]), [])) for r in reduce(DataFrame.unionByName, one).collect()]
    return spark.createDataFrame(rows, "path STRING, columns ARRAY<STRING>").select(
        "path", F.regexp_extract("path", r"__season=(-?[0-9]+)", 1).cast("int").alias("season"), "columns")


def schema_audit(headers: DataFrame) -> DataFrame:
    """(column_name, n_files) - columns missing from some season's files show n_files < seasons."""
    return headers.select("season", F.explode("columns").alias("column_name")).groupBy(
        "column_name").agg(F.count_distinct("season").alias("n_files"))


def read_files(spark: SparkSession, paths: list[str], columns: Iterable[str], types: dict[str, str]) -> DataFrame:
    """One CSV read, with an explicit schema from the header, of all files that share it."""
    schema = ", ".join(f"`{c.replace('`', '``')}` {types.get(c, 'STRING')}" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
            .withColumn("source_file", F.col("_metadata.file_path")))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """S3: concatenate; a column missing from a file is null for its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_season_files(spark: SparkSession, root: str, types: dict[str, str]) -> DataFrame:
    """Every season file, combined by name: one read for each distinct header.

    The driver holds the file list, as it does for any Spark read of these files."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in file_headers(spark, root).orderBy("path").collect():
        by_header.setdefault(tuple(r["columns"]), []).append(r["path"])
    return union_by_name([read_files(spark, paths, columns, types) for columns, paths in sorted(by_header.items())])


def sink_combined(df: DataFrame, path: str) -> DataFrame:
    """Write the combined table as parquet partitioned by season, read it back."""
    df.drop("source_file").write.mode("overwrite").partitionBy("season").parquet(path)
    return df.sparkSession.read.parquet(path)


def shape_summary(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows, distinct columns of the files, number of seasons."""
    columns = headers.select(F.explode("columns").alias("c")).agg(F.count_distinct("c").alias("n_columns"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("season").alias("n_files"))
    return rows.crossJoin(columns).select("n_rows", "n_columns", "n_files")
