"""Memory of Python workers, which live on from task to task and from stage to stage."""

from __future__ import annotations

import functools
import inspect


def give_back() -> None:
    """Return free memory of Arrow and of the C library to the system, where it can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work):
    """A function over batches or over one group that gives memory back at its end."""
    if inspect.isgeneratorfunction(work):
        @functools.wraps(work)
        def tidied(*args):
            try:
                yield from work(*args)
            finally:
                give_back()
    else:
        @functools.wraps(work)
        def tidied(*args):
            try:
                return work(*args)
            finally:
                give_back()
    tidied.__signature__ = inspect.signature(work)  # Spark reads from it whether a function takes the key of its group
    return tidied


def parts(batch, rows: int = 256):
    """A batch in slices of a few rows, so that results leave the worker before all of them exist."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
