"""Helpers that several training-data operators use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


#: The folder for a local master without the setting.
LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a private folder serves a local master (tests); on a
    cluster that would be a machine-local folder, so its absence is an error there.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if LOCAL:
        return LOCAL[0]
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    LOCAL.append(tempfile.mkdtemp(prefix="blockloom-"))
    atexit.register(shutil.rmtree, LOCAL[0], ignore_errors=True)
    return LOCAL[0]


def session_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/blockloom-{spark.sparkContext.applicationId}"
    if path not in SESSIONS:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        SESSIONS.add(path)
    return path


SESSIONS: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Written(threading.local):
    """Tables that cut() wrote in this thread, in order, and those that the result of a pipeline's last stage reads."""

    def __init__(self) -> None:
        self.tables: list[str] = []
        self.held: list[str] = []


WRITTEN = Written()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a table in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that cut() has written; for callers that have stored all results that read them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, after which a worker holds no more memory than it needs while it waits for its next task."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return df.mapInArrow(frugal, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_crc32(text):
    """Unsigned CRC-32 of the UTF-8 text; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold(doc_id, folds: int = 5):
    """crc32 of the id written as text, modulo ``folds``; a null id falls in fold 1, so it never is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))
