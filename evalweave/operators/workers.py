"""What Python workers keep between tasks."""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same map over batches; a worker, which outlives its tasks, gives memory back at the end of each."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return whole
