"""Arrow batches for Python code inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a batch that Python takes up at a time: texts as Python's strings, and what is made of them, are held for these only.
SLICE = 256


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)
