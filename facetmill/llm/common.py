"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import BROADCAST_ROWS, scratch, shared_dir, small, stored, table  # noqa: F401

def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text, so is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Spark's names of file systems and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "gcs": "gs"}


def file_system(path: str):
    """pyarrow's file system for a path as Spark has it, and the path inside it."""
    from pyarrow import fs

    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":  # Spark also writes file:/folder
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def open_output(path: str):
    """A writable stream at a path of any file system that pyarrow knows; the parent is created."""
    store, at = file_system(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)


def open_input(path: str):
    store, at = file_system(path)
    return store.open_input_file(at)


def give_back() -> None:
    """Return freed memory of this process to the system, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a function over batches: Python workers live on after a task, so what it freed is given back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return wrapped


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most, for the actions inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, those aside that Spark cannot hash (maps, variants): puts rows that repeat a key in order."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has (capital letters do not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attempt_name(prefix: str) -> str:
    """A file name that no other attempt of the same task shares; manifests name the attempt that won."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{prefix}-{c.partitionId():06d}-{c.taskAttemptId()}"
