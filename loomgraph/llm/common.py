"""Helpers shared by the training-data operators: Arrow passes, materialised tables, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of variable-length columns handled at once inside an Arrow pass (a larger row is alone); they bound what
#: a Python worker holds besides the batch itself.
SLICE_ROWS, SLICE_BYTES = 1024, 4_000_000
#: Bytes of an Arrow batch between the JVM and Python, as Spark bounds only its rows by default; a larger row is alone.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: What an entry of a cache takes besides its key's characters.
ENTRY_BYTES = 150
_HELD: dict[str, object] = {}
_CACHES: list[weakref.ref] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            wide = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32
            offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + batch.num_rows + 1] if batch.num_rows else np.zeros(1, wide)
            total += np.diff(offsets)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and ``size`` bytes of texts; a row of more bytes is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(_sizes(batch))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Empty this worker's caches at the end of a task: idle workers wait with their model only, as several wait while few run."""
    _CACHES[:] = [known for known in _CACHES if known() is not None]
    for known in _CACHES:
        if (cache := known()) is not None:
            cache.reset()
    _give_back()


def held(name: str, build: Callable):
    """What ``build`` makes, kept in this worker under ``name``. A worker keeps one model at a time, whichever operator's;
    the memory of the one before goes back to the system."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[name] = build()
    return _HELD[name]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, in a session that sets no bound of its own."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to slices of Arrow batches; only the columns of ``df`` reach Python."""

    def run(batches):
        for part in slices(batches, rows, size):
            out = fn(part)
            if out is not None:
                yield out
        forget()

    return in_arrow(df, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The tables of the ``scratch`` that this thread is in, if it is in one.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread's ``materialise`` writes inside are deleted at the end, but for those that ``keep`` has been asked
    for; other threads' tables are their own."""
    paths: list[str] = []
    token = _WRITTEN.set(paths)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in paths:
            drop(spark, path)


def materialise(df: DataFrame, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing.
    Inside ``scratch`` the table goes at its end, unless it is to be kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    if (paths := _WRITTEN.get()) is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class BoundedCache(dict):
    """A dict that computes what is missing; emptied back to its fixed part beyond ``limit`` entries or ``size`` bytes, by
    the keys' lengths and ``ENTRY_BYTES`` an entry for the objects and the dict's own slots."""

    def __init__(self, compute: Callable, limit: int, fixed: dict | None = None, size: int = 32_000_000):
        super().__init__(fixed or {})
        self._compute, self._limit, self._fixed, self._size, self._used = compute, limit, fixed or {}, size, 0
        _CACHES.append(weakref.ref(self))

    def reset(self) -> None:
        self.clear()
        self.update(self._fixed)
        self._used = 0

    def __missing__(self, key):
        value = self._compute(key)
        self.make_room(1, len(key))
        self[key] = value
        return value

    def make_room(self, n: int, size: int = 0) -> bool:
        """Whether entries had to go for ``n`` more of ``size`` bytes."""
        size += n * ENTRY_BYTES
        full = len(self) + n > self._limit + len(self._fixed) or self._used + size > self._size
        if full:
            self.reset()
        self._used += size
        return full
