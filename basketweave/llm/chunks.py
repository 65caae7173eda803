"""Worker-side caches for work that depends on one white-space-free chunk of text alone."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable

import pyarrow as pa

#: Entries of one cache generation in a worker; two generations are held.
GENERATION = 300_000
#: Longer chunks are worked out each time instead of being held.
LONGEST_HELD = 64

_SHARED: dict = {}
_USED: set = set()


def worker_value(key, make: Callable):
    """A value made once in each Python worker and kept across its tasks, until a task that doesn't ask for it ends."""
    _USED.add(key)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def end_task() -> None:
    """Give what the ended task and those before it have left back to the system: workers are used again by other steps."""
    for key in set(_SHARED) - _USED:
        del _SHARED[key]
    _USED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class ChunkCache:
    """Two tiers: a fixed table, then two generations of what this worker met; misses are made in one call."""

    def __init__(self, make_all: Callable[[list[str]], Iterable], table: dict | None = None, generation: int = GENERATION):
        self.make_all, self.table, self.generation = make_all, table or {}, generation
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, chunks: Iterable[str]) -> dict:
        """A value for each of the distinct ``chunks``."""
        found, missing = {}, []
        table, young, old = self.table, self.young, self.old
        for c in chunks:
            v = table.get(c)
            if v is None:
                v = young.get(c)
                if v is None:
                    v = old.get(c)
                    if v is None:
                        missing.append(c)
                        continue
                    young[c] = v
            found[c] = v
        if missing:
            for c, v in zip(missing, self.make_all(missing)):
                found[c] = v
                if len(c) <= LONGEST_HELD:
                    young[c] = v
        if len(young) > self.generation:
            self.old, self.young = young, {}
        return found
