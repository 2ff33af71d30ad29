"""Arrow batches in small parts: what Python holds at a time depends on neither the table nor Spark's batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are Python objects at a time.
AT_ONCE = 128


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[dict[str, list]]:
    """The batches' columns as lists of few rows. A batch is let go before the next one is read."""
    while (batch := next(batches, None)) is not None:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
            del part
            yield columns
        del batch


def lists_in_parts(arrays: Iterator[pa.Array], rows: int = AT_ONCE) -> Iterator[list]:
    """The same for the arrays of one column."""
    while (array := next(arrays, None)) is not None:
        for at in range(0, len(array), rows):
            yield array.slice(at, rows).to_pylist()
        del array
