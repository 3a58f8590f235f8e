"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return what this process has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work):
    """work on Arrow batches, after which its worker gives back what it no longer needs."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run
