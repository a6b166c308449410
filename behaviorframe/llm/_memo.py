"""A Python worker is used by one operator after another: only the current one keeps its memo."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Give free memory back to the system: the executor's JVM shares the machine with its workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called by an operator's worker code: what other operators have kept in this worker goes."""
    others = [k for k in _held if k != name]
    for other in others:
        _held.pop(other)()
    _held[name] = clear
    if others:
        trim()
