"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of a few narrow columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch. The JVM holds a few batches a task outside its heap, and Python as much again.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    Cuts the lineage so that a lost executor costs the tasks it ran and no earlier stage, and lets the later
    joins start from two plain scans, which adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.staged_path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows are within the bound, else as it is. df should be staged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of the driver's values, sent as Arrow.

    A list of rows would be read by Python workers of another kind than the operators', which each executor then holds
    beside those.
    """
    return spark.createDataFrame(pa.table(columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by BATCH_BYTES, if they are not bounded closer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    at = spark.conf.get(key, "64m").removesuffix("b")
    if not at.isdigit() or int(at) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _release() -> None:
    """Gives freed memory of this process back to the system; later stages of the executor need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def _forget() -> None:
    """Drops the model that this worker process holds."""
    _MODEL[:] = [None, None]
    _release()


def tidy(run: Callable[[Iterator], Iterator], models: bool = False) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or mapInPandas, which gives freed memory back when its partition ends.

    models: run asks for a model(). Others first drop the one that an earlier operator left in their worker.
    """

    def wrapped(it: Iterator) -> Iterator:
        if not models:
            _forget()
        try:
            yield from run(it)
        finally:
            _release()

    return wrapped


def tidy_groups(run: Callable[[object, pa.Table], pa.Table]) -> Callable[[object, pa.Table], pa.Table]:
    """tidy() for applyInArrow: run takes a key and a table, or two tables."""

    def wrapped(a, b):  # Spark tells the kinds apart by the number of arguments
        if _MODEL[0] is not None:
            _forget()
        try:
            return run(a, b)
        finally:
            _release()

    return wrapped


_MODEL: list = [None, None]


def model(key: object, build: Callable[[], object]) -> object:
    """What build() makes for key, kept until another key comes: a worker process holds one model of any operator."""
    if _MODEL[0] != key:
        _forget()
        _MODEL[:] = [key, build()]
    return _MODEL[1]
