"""Session plumbing that the text operators share: shipped code, staged tables, and batches cut to size."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shipping import ship  # noqa: F401
from ..staging import stage, unstage  # noqa: F401


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: the session's number, or that of the input's splits if it has more."""
    named = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(named, df._jdf.queryExecution().toRdd().getNumPartitions())


def cut(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the named text column each (one row at least)."""
    rows = batch.num_rows
    if not rows:
        return
    offsets = _offsets(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < rows:
        end = at + 1
        while end < rows and offsets[end + 1] - offsets[at] <= most:
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _offsets(array: pa.Array):
    import numpy as np

    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    got = np.frombuffer(array.buffers()[1], dtype=kind, count=array.offset + len(array) + 1)
    return got[array.offset :].astype(np.int64)


def text_bytes(array: pa.Array):
    """(bytes as uint8, offsets as int64 from 0) of a string array; nulls are empty."""
    import numpy as np

    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if array.null_count:
        # a null may still own bytes in the buffer
        sizes = np.diff(offsets)
        nulls = np.asarray(array.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        if sizes[nulls].any():
            keep = np.repeat(~nulls, sizes)
            data = data[keep]
            sizes = np.where(nulls, 0, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def pieces_of(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All batches, cut to size; before them and when they end, the worker gives its free memory back."""
    release()  # what the task before still held at its end
    try:
        for batch in batches:
            yield from cut(batch, column, most)
    finally:
        release()


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Workers are used again by later tasks: what they hold for nothing would add up."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def worker_env() -> None:
    """One thread for each worker: Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
