"""Helpers for operators that must leave the JVM: Arrow batches in small slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows handled at a time in a Python worker. Bounds memory; has no influence on results.
SLICE_ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = SLICE_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sliced(batches, rows):
            yield f(piece)

    return run
