"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from netmine.session import cut, delete, saved, shared_folder, table

__all__ = ["cut", "delete", "pieces", "saved", "shared_folder", "table"]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of few rows, so that a worker holds little besides the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
