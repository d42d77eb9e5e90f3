"""Spark session settings used by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = 6  # jobs submitted at once

# Settings the results depend on. They are runtime SQL settings, so they are
# applied to whatever session the caller hands in (driver, tests, bench).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings for throughput at scale; applied only where the cluster left them unset.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot interprets methods of over 8,000 bytes for good; plans of many columns are generated in smaller ones instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SCALE_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
SHORT_LOOP = "2000"


@contextmanager
def short_loops(spark: SparkSession) -> Iterator[None]:
    """Plans of many columns run in small methods, called once a row. A generated loop is called once a partition, so HotSpot interprets
    it until it has run some 60,000 times: where many columns make it long, most of the time of a stage. A limit of the cluster's own stays."""
    ours = spark.conf.get(HUGE_METHOD, None) == SCALE_CONF[HUGE_METHOD]
    if ours:
        spark.conf.set(HUGE_METHOD, SHORT_LOOP)
    try:
        yield
    finally:
        if ours:
            spark.conf.set(HUGE_METHOD, SCALE_CONF[HUGE_METHOD])


def in_pool(work: Callable, items: Iterable, pool: int = POOL, session: SparkSession | None = None) -> list:
    """`work` for each item from a bounded pool of driver threads, results in the order of the items."""
    session = session or SparkSession.getActiveSession()
    with ThreadPoolExecutor(pool) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(session)(work), x) for x in items]]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    The cluster setting wins. A folder of our own is made only in a local session
    without one (tests, the bench), where the driver and the executor are one
    process; anywhere else a missing setting is an error, since executors
    could not read what others wrote to their own disks.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to storage that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="touchline-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "touchline") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TOUCHLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
