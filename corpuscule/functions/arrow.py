"""Arrow UDFs that hold a slice of a batch at a time, whatever the size of the batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows are worked on in slices of about so many bytes, which bounds what a Python worker holds.
SLICE_BYTES = 1 << 20
#: Freed memory is given back after about so many bytes; workers live on through many stages.
TIDY_BYTES = 16 << 20


def slices(columns: tuple[pa.Array, ...], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, halved until they are; a longer row makes a range of its own."""
    most = most or SLICE_BYTES
    todo = [(0, len(columns[0]))]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and sum(c.slice(a, b - a).nbytes for c in columns) > most:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        elif b > a:
            yield a, b


def tidy() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def sliced(run: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """``run``, which makes an array from arrays row by row, as a UDF that hands it a slice at a time.

    What it makes of a slice leaves the worker before the next one is begun.
    """

    def work(columns: tuple[pa.Array, ...], held: list[int]) -> Iterator[pa.Array]:
        for a, b in slices(columns):
            out = run(*[c.slice(a, b - a) for c in columns])
            held[0] += out.nbytes + sum(c.slice(a, b - a).nbytes for c in columns)
            yield out
            del out
            if held[0] > TIDY_BYTES:
                tidy()
                held[0] = 0

    @F.arrow_udf(kind)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = [0]
        for batch in batches:
            yield from work((batch,), held)
            del batch

    @F.arrow_udf(kind)
    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held = [0]
        for batch in batches:
            yield from work(batch, held)
            del batch

    return lambda *columns: one(*columns) if len(columns) == 1 else more(*columns)
