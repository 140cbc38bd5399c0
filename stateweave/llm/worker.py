"""What the tasks of a Python worker share, and giving memory back between them."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def shared(build: Callable, *args: Hashable):
    """``build(*args)``, one for all tasks of a worker that ask for it; the first task that doesn't ask drops it."""
    key = (build.__module__, build.__qualname__, *args)
    _asked.add(key)
    if key not in _held:
        _held[key] = build(*args)
    return _held[key]


def prepared(make: Callable):
    """``make()``, after which what it didn't ask for is dropped: a tokenizer of the stage before takes no memory from this one."""
    _asked.clear()
    work = make()
    if gone := set(_held).difference(_asked):
        for key in gone:
            del _held[key]
        release()
    return work


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and one task's peak would add to the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
