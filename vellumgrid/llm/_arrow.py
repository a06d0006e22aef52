"""Arrow plumbing shared by the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under fixed internal names: ``columns(docs, id="doc_id", text="text")``.

    Anything else a caller's table carries, clashing names included, is dropped here.
    """
    return df.select(*[column(df, name).alias(alias) for alias, name in wanted.items()])


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and case-insensitive twins notwithstanding."""
    if df.columns.count(name) > 1:
        raise ValueError(f"column {name!r} occurs {df.columns.count(name)} times")
    return df[f"`{name.replace('`', '``')}`"]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``max_bytes`` of text (one longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(lengths):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)
    release()


def release() -> None:
    """Give freed memory back at the end of a task: workers live on, and the next task may run elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sha256_hex(binary: Column) -> Column:
    return F.sha2(binary, 256)
