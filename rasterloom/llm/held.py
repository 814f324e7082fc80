"""The one thing that a Python worker keeps between tasks: a model, or a tokenizer with its memory.

Workers are reused by later stages, so what a stage kept goes when another one wants
to keep something, and its memory returns to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_now: dict[str, Any] = {}


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make()`` gave for this kind and key, made anew if the worker keeps anything else."""
    if _now.get("key") != (kind, key):
        if _now:
            _now.clear()
            gc.collect()
            _trim()
        _now["value"] = make()
        _now["key"] = (kind, key)
    return _now["value"]


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
