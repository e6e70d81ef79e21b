"""What a Python worker remembers from task to task, for one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Say that the worker now works for ``name``, whose caches ``clear`` empties; those of other operators are emptied.

    Workers outlive the stages of a pipeline, and would else keep the caches
    of all of them.
    """
    if name in _held:
        return
    for other in list(_held):
        _held.pop(other)()
    _held[name] = clear
    give_back()


def give_back() -> None:
    """Return freed memory to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:  # where the C library knows how
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which an idle worker keeps no freed memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped
