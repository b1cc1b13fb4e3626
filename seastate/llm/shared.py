"""What the operators share: the shared folder, written intermediate tables and Arrow batch sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_FALLBACK = "file:///tmp/checkpoints/seastate"
#: Rows and bytes of an Arrow batch that holds whole texts; a longer text has a batch of its own.
TEXT_ROWS, TEXT_BYTES = 1000, 2 << 20

#: What this Python worker keeps between tasks: the caches of one operator.
_kept: dict[str, Any] = {}


def kept(name: str = "", make: Callable[[], Any] | None = None) -> Any:
    """The named object of this Python worker, made if it isn't there. All others go, so that workers that serve one operator after another hold the caches of one."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)  # to the system, not to this process's free lists
        if make is not None:
            _kept[name] = make()
    return _kept.get(name)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a local one if driver and executors are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when this Python process ends."""
    path = f"{shared_dir(spark)}/seastate-{uuid.uuid4().hex}/{tag}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = table_path(prepare(spark), tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by way of Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that materialize() has written and that nothing reads any more."""
    for table in tables:
        for path in {f.rsplit("/", 2)[0] for f in table.inputFiles()}:
            if (spark, path) in _written:
                _written.remove((spark, path))
                remove(spark, path)


def release() -> None:
    """Delete all tables that materialize() has written in this process and that are still there."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # this session has ended; its folder's owner cleans up
            continue


atexit.register(release)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> None:
    """Hold Arrow batches to a few whole texts, by rows and by bytes, so that a Python worker's memory stays bounded. Both stay set in the session, as plans read them when they run."""
    prepare(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def pieces(batches: Iterable[pa.RecordBatch], column: int = 0, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose values of one string or binary column have at most so many bytes, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch) or at == len(batch) == 0:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end
