"""Helpers that several operators share: bounded Arrow slices, ASCII folding, word splitting."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an executor-side loop works on at once; longer single texts are a slice of their own.
SLICE_BYTES = 8 << 20
#: The same where each byte or word takes many bytes meanwhile.
SMALL_SLICE = 2 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower case; everything in ASCII that is neither digit nor letter becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch, unless the session names its own: ten thousand whole texts, Spark's usual batch, may be anything.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: clashing extra columns can't interfere."""
    bounded(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def bounded(spark: SparkSession) -> None:
    """Have batches of texts cut by bytes, on their way to Python as well as in it."""
    if spark.conf.get(_BATCH) == f"{64 << 20}b":  # Spark's own
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys that hold more than one in so many rows are joined by broadcast: there are fewer of them than this, whatever the data.
HOT = 1000


def attached(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``table``, a durable table of one row per key that counts its rows in ``count``.

    A key that holds a large part of all rows never meets one task: such keys are few and broadcast, the others shuffled.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HOT > total
    many = table.where(hot).drop(count)
    if many.isEmpty() or total < HOT * HOT:  # in a small table no key is a burden
        return rows.join(table.drop(count), keys)
    many = F.broadcast(many)
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(table.where(~hot).drop(count), keys))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds more than ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
        trim()


def trim() -> None:
    """Hand freed memory back: workers live on between stages, and their executor's limit counts what they keep."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array, table: bytes | None = None) -> tuple[bytes, np.ndarray]:
    """The column's UTF-8 bytes, one after the other, and n+1 offsets; null is empty. ``table`` maps single bytes."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = memoryview(data)[at[0] : at[-1]].tobytes() if data is not None else b""
    return (raw.translate(table) if table else raw), at - at[0]


def words_of(column: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """All words of the mapped texts, split at ASCII white space, and each text's first word (n+1 offsets)."""
    raw, at = text_bytes(column, table)
    n = len(at) - 1
    mapped = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(mapped)
    flat, starts = lists.flatten(), lists.offsets.to_numpy()
    starts = starts - starts[0]
    keep = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return before[starts], flat.filter(keep)
