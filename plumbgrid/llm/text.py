"""What the text operators share: the word definition, byte access to Arrow columns and a column picker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that part words: space and the five ASCII controls from tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def to_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding it; ``bytes.split()`` parts them at exactly ``GAP``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes at most in each piece (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash with those an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: What operators keep in a worker process between tasks, by owner: functions that let go of it.
CACHES: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def claim(owner: str) -> None:
    """Called in a worker before an operator's first batch.

    Spark reuses worker processes, so what another operator kept there is let go first and freed memory is returned to
    the system; otherwise idle tables would add up over the stages of a pipeline.
    """
    if _owner[0] == owner:
        return
    _owner[0] = owner
    for name, clear in CACHES.items():
        if name != owner:
            clear()
    trim()


def trim() -> None:
    """Return freed memory to the system; at the end of a task, as idle workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return
        pass
