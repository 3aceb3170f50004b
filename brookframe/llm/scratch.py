"""Written intermediate tables in the folder that the cluster names in spark.checkpoint.dir.

Cutting lineage with a written Parquet table keeps a job alive when executors are lost and lets
a column of hashes be read many times without being computed again.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch at most while a table is written (Spark bounds a batch by 64 MB too).
BATCH_ROWS = 1000

_OPEN: list["Scratch"] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder of our own only in local mode, where it is unset (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="brookframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def release() -> None:
    """Give freed memory back to the system; arrays that are gone otherwise still count for the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def lean(step):
    """A step for mapInArrow that releases memory when its task ends; Python workers live longer than tasks."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            release()

    return run


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A folder of written tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []
        _OPEN.append(self)

    def write(self, df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, path: str | None = None) -> DataFrame:
        """Write df and return it as read back; the shuffle files behind it may then go.

        batch_rows: rows of an Arrow batch at most meanwhile. path: a folder that stays, instead of one of the scratch's own.
        """
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        schema, usual = df.schema, self.spark.conf.get(key)
        to = path or f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        if not 0 < int(usual) <= batch_rows:
            self.spark.conf.set(key, str(batch_rows))
        try:
            df.write.option("compression", "zstd").parquet(to)
        finally:
            self.spark.conf.set(key, usual)
        del df
        release()
        self.spark.sparkContext._jvm.System.gc()
        written = self.spark.read.schema(schema).parquet(to)
        if not path:
            self.paths.append((written, to))
        return written

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df, path in list(self.paths):
            if any(df is x for x in written):
                delete(self.spark, path)
                self.paths.remove((df, path))

    def close(self) -> None:
        delete(self.spark, self.root)
        self.paths = []


@contextmanager
def disposable() -> Iterator[None]:
    """Delete, at the end of the block, the tables of all operators called in it; their results must have been written by then."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for s in [s for s in _OPEN if s not in before]:
            s.close()
            _OPEN.remove(s)


@atexit.register
def _close_all() -> None:
    for s in _OPEN:
        try:
            s.close()
        except Exception:  # the session has ended before the interpreter
            return
