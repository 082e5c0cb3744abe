"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, leaving every other code point as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset (tests),
    a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    global _OWN
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    return _OWN


_OWN: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []
_REGISTERED = False


#: Whether Spark deletes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation beyond the
    tasks that were running on it. The table goes when the driver ends, or
    with `clear`. Shuffle files behind a written table serve nothing more, so
    Spark deletes them with the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    global _REGISTERED
    if not _REGISTERED:
        atexit.register(clear)
        _REGISTERED = True
    _WRITTEN.append((spark, path))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Partitions below which rows are dealt anew before work that is heavy for each row.
FEW_PARTITIONS = 32


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its few files would keep most of them idle.

    Tables of more partitions pass as they are, so this never shuffles a large
    table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_PARTITIONS) else df


def release(df: DataFrame) -> None:
    """Delete the table behind a `materialize` result that no later step reads."""
    files = df.inputFiles()
    for entry in list(_WRITTEN):
        if any(entry[1].split("://")[-1] in f for f in files):
            _delete(*entry)
            _WRITTEN.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Delete all tables behind `materialize` results.

    For long sessions, between queries: results not yet read need their tables.
    """
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept in this Python worker for its next tasks, in place of all that was kept before."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what earlier tasks kept in this Python worker.

    Spark hands workers on from one query to the next, so a task that needs
    much memory of its own asks for this first.
    """
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        return
