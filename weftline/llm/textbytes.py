"""Texts in Arrow batches as byte strings, for the operators that work in numpy.

A batch holds at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows and
begins a new one at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless
set), so a run of very long texts still fits a worker. Nothing is set here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


#: Rows that a worker makes features or answers of at a time.
ROWS = 128


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch a few rows at a time, without a copy."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for x in column:
        yield b"" if not x.is_valid else x.as_buffer().to_pybytes()
