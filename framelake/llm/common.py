"""Shared storage for intermediate tables, and table helpers used by several operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
            root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Workspace:
    """A folder of its own under the shared root for the tables that one operator call writes.

    Written tables cut lineage and survive lost executors. ``drop`` removes a
    table that no later plan reads; the folder goes with the application, as
    results that are read late may lie in it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        files, target = self._files(self.path)
        files.mkdirs(target)
        files.deleteOnExit(target)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stage(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        """Write ``df`` as Parquet and return the table read again."""
        df.write.mode(mode).option("compression", "zstd").parquet(self.at(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.at(name))

    def _files(self, path: str) -> tuple:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _delete(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = 16 << 20) -> Iterator[None]:
    """Within it, plans that are run hand Python batches of at most so many bytes: for rows that may hold long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and other tasks' processes need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when its partition is done, ``forget`` is called and memory released."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            release_memory()

    return wrapped
