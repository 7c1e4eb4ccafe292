"""What a Python worker keeps from task to task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[str, tuple[Any, Any]] = {}


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """The one object of its kind for a key, made where it isn't there.  It must not change results, only spare work."""
    if kind not in _held or _held[kind][0] != key:
        _held[kind] = key, make()
    return _held[kind][1]


def give_back() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where it knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)
