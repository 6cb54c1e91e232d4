"""Helpers for functions over Arrow batches: bounded slices and vectorised gathers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20


#: What functions of this package remember in a worker, and the module that the last one belongs to.
REMEMBERED: list[Callable] = []
serving = ""


def remembered(most: int) -> Callable[[Callable], Callable]:
    """An lru_cache that is emptied once the worker serves another module."""

    def cached(f: Callable) -> Callable:
        REMEMBERED.append(own := functools.lru_cache(maxsize=most)(f))
        return own

    return cached


def begin(module: str) -> None:
    """Drops what the functions of another module left in this worker."""
    global serving
    if module != serving:
        for f in REMEMBERED:
            f.cache_clear()
        serving = module
        give_back()


def give_back() -> None:
    """Returns memory that is free in this worker to the system, for the JVM and other workers beside it."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function over batches or of tables, after which a worker keeps no free memory.

    Workers serve one stage after the other; what one stage took would else count against the next.
    """

    @functools.wraps(run)
    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    @functools.wraps(run)
    def of_table(table: pa.Table) -> pa.Table:
        begin(run.__module__)
        give_back()
        return run(table)

    @functools.wraps(run)
    def of_tables(table: pa.Table, other: pa.Table) -> pa.Table:
        begin(run.__module__)
        give_back()
        return run(table, other)

    if "Table" not in str(run.__annotations__.get("return")):
        return over_batches
    return of_table if run.__code__.co_argcount == 1 else of_tables


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in ``column``, or one row; nulls in it become empty."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    kind = batch.schema.field(at).type
    filled = pc.fill_null(batch.column(at), pa.scalar(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "", kind))
    batch = batch.set_column(at, pa.field(column, kind), filled)
    ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0]+1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) < 2**31) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``index`` of ``flat``, one after the other; ``flat`` holds runs of these sizes."""
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    return flat[spans(starts[index], sizes[index])]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
