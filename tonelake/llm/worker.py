"""What a Python worker keeps between tasks.

This library's functions travel with each task by value, module globals included, so a cache in a
module global would start empty in every task and be sent along once filled. This one stays in the process.
"""

from __future__ import annotations

import ctypes
import sys
from types import ModuleType

import pyarrow as pa


def kept() -> dict:
    """This process's own cache."""
    return sys.modules.setdefault("_tonelake_kept", ModuleType("_tonelake_kept")).__dict__


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = kept().get("trim")
    if trim is None:
        trim = kept()["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc alone has it
    trim(0)
