"""Matrix products of Python workers."""

from __future__ import annotations

import ctypes
import functools
from pathlib import Path

import numpy as np

_SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@functools.cache
def one_thread() -> bool:
    """Let this process multiply by one thread: tasks already fill the cores, and threads that wait for small products cost more than they save.

    Whether numpy's own OpenBLAS was found; another library is left as it is, which only costs time.
    """
    found = False
    for path in Path(np.__file__).parent.parent.joinpath("numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))  # the one that numpy has loaded
        for name in _SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                found = True
                break
    return found
