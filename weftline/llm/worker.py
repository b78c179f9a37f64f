"""Memory of Python workers: they live on from task to task, and so does what modules keep in them.

Only one operator's caches stay at a time: the first task of another one drops the others'. Memory that a task had goes
back to the system: Arrow takes it from the C library, which maps large blocks each by itself, and each task begins by
returning what is free.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_drops: dict[str, Callable[[], None]] = {}
_owner = ""


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Declares what a module keeps, by the function that drops it."""
    _drops[name] = drop


def _returned() -> None:
    """Free memory goes back to the system; the first time, the C library is told to map blocks from 1 MB by themselves."""
    global _set
    try:
        c = ctypes.CDLL(None)
        if not _set:
            _set = True
            pa.set_memory_pool(pa.system_memory_pool())
            c.mallopt(_MMAP_THRESHOLD, 1 << 20)
        c.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_MMAP_THRESHOLD = -3
_set = False


def owned_by(name: str) -> None:
    """Called as a task begins to work for an operator."""
    global _owner
    if name != _owner:
        for other, drop in _drops.items():
            if other != name:
                drop()
        if _owner:
            gc.collect()
        _owner = name
    _returned()
